import base64
import hashlib
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, cube_mix, decontam, html_crf, quality, sharding, warc

PAGES = "page_id long, url string, html string, payload string, sha long"


def pages(spark, prose):
    rows = [(1, "http://a/1", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://a/3", None), (4, "u", ""), (5, "bad\r\nurl", prose(1, 4000)), (None, "n", "<p>one</p>"), (7, "é", "<p>é — ü</p>"), (2, "again", "<p>one</p>"), (None, "m", "only null"), (None, "m", "only null")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


def test_warc_round_trip(spark, prose):
    df = pages(spark, prose)
    base = common.shared_dir(spark) + "/warc-test"
    manifest = warc.write_archives(spark, df, base)
    got = warc.read_archives(spark, manifest, with_payload=True).collect()
    want = []
    for r in df.collect():
        body = (r.html or "").encode()
        same = [x.page_id for x in df.collect() if (x.html or "").encode() == body and x.page_id is not None]
        ref = max(same) if same and r.page_id != max(same) and len(same) + sum(x.page_id is None and (x.html or "").encode() == body for x in df.collect()) > 1 else None
        want.append((r.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if ref is not None else "response", ref))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {(r.html or "").encode() for r in df.collect()}
    # each archive starts with its dictionary, and a record can be read alone
    for m in manifest.collect():
        path = m.archive.removeprefix("file://")
        with open(path, "rb") as f:
            assert struct.unpack("<I", f.read(4))[0] == warc.DICT_MAGIC
        fields, _ = warc.read_record(m.archive, m.offset)
        assert fields.get("X-Page-ID") == (None if m.page_id is None else str(m.page_id))


def test_warc_least_payload_and_empty_table(spark, prose):
    base = common.shared_dir(spark) + "/warc-test2"
    got = warc.read_archives(spark, warc.write_archives(spark, pages(spark, prose), base, least=11)).collect()
    assert {r.record_type for r in got} == {"response"}
    assert warc.read_archives(spark, warc.write_archives(spark, pages(spark, prose).limit(0), base + "e")).count() == 0


def test_lookup_table_is_even_and_stable():
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(names, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 1009 * 0.25
    heavy = Counter(sharding.lookup_table(names, 1009, [2, 1, 1, 1, 1, 1, 1]))
    assert abs(heavy[0] / heavy[1] - 2) < 0.05
    for bad in (([], 11), (["a", "a"], 11), (["a"], 12), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(spark, corpus):
    got = sharding.place(corpus, fallback="text", shards=("x", "y", "z"), size=101, into="label")
    assert got.columns == [c for c in corpus.columns if c != "label"] + ["label"] and got.count() == corpus.count()
    by = {}
    for r in got.collect():
        if r.doc_id is not None:
            assert by.setdefault(r.doc_id, r.label) == r.label
    table = sharding.lookup_table(("x", "y", "z"), 101)
    slots = {r.doc_id: r.s for r in corpus.select("doc_id", sharding.slot(F.col("doc_id"), 101).alias("s")).collect()}
    assert all(("x", "y", "z")[table[slots[i]]] == s for i, s in by.items())
    assert sharding.place(corpus.limit(0)).count() == 0


def brute_hits(docs, bench):
    import re

    rule = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: rule.findall((t or "").encode().lower())
    windows = {}
    for i, t in bench:
        w = split(t)
        for p in range(max(len(w) - 12, 1 if w else 0)):
            windows.setdefault(tuple(w[p : p + 13]), set()).add(i)
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if items := windows.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= items
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_decontamination_agrees_with_brute_force(spark, corpus, prose, most):
    passage = prose(2, 60)
    bench = [(1, passage), (2, passage[:150] + " other"), (3, "One, two; THREE"), (4, None), (5, ""), (6, prose(77, 30)), (7, "tail"), (None, "word"), (3, "é à")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    docs = corpus.unionByName(spark.createDataFrame([(40, "x " + prose(77, 30).upper() + " y")], "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = decontam.find(docs, b, most).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = brute_hits(rows, bench)
    assert sorted((tuple(r) for r in got), key=str) == want
    kept = decontam.clean(docs, b, most)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[-1]), key=str)


def test_decontamination_of_empty_tables(spark, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r.n_hit, r.contaminated) for r in decontam.find(corpus, none).collect()} == {(0, False)}
    assert decontam.find(corpus.limit(0), none).count() == 0


def test_quality_measures(spark, corpus, prose):
    import re

    extra = spark.createDataFrame([(50, "a\nb\na\n\n \na"), (51, "# $ ok\n" + prose(3, 60)), (52, "x y z w v u t s r q x y z w v u t s " * 3)], "doc_id long, text string")
    docs = corpus.unionByName(extra, allowMissingColumns=True)
    want = []
    for r in docs.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at = {}
        for p in range(len(w) - 7):
            at.setdefault(tuple(w[p : p + 8]), []).append(p)
        hit = {p + j for v in at.values() if len(v) > 1 for p in v for j in range(8)}
        want.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)))
    got = quality.judge(docs).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge(docs.limit(0)).count() == 0


def test_cube_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 900, 500).astype(float)
    p = np.full(500, 0.37)
    q = cube_mix.flight(p, size, np.random.default_rng(2))
    assert abs((q * size).sum() - (p * size).sum()) < 1e-6 * size.sum() and abs(q.sum() - p.sum()) < 1e-6
    assert ((q > 0) & (q < 1)).sum() <= 2
    same = cube_mix.flight(np.full(9, 0.5), np.full(9, 4.0), np.random.default_rng(3))
    assert abs(same.sum() - 4.5) < 1e-9
    assert set(np.unique(cube_mix.land(q, size))) <= {0.0, 1.0}


def test_mix_targets_and_balance(spark):
    rows = [(k, " ".join(["w"] * (1 + (k * 7) % 50)), ("a", "b", "c", None)[min(k % 6, 3)], "x") for k in range(1200)]
    df = spark.createDataFrame([*rows, (5000, None, "a", "x"), (5001, "", "zero", "x")], "doc_id long, text string, source string, p string")
    got = cube_mix.mix(df, block=64).toPandas()
    assert len(got) == len(df.toPandas()) and (got.taken <= 2 * got["size"]).all()
    sizes = got.groupby("source", dropna=False)["size"].sum()
    names = sorted([s for s in sizes.index if isinstance(s, str)]) + [None]
    s = [float(sizes[n] if n else sizes[sizes.index.isna()].iloc[0]) for n in names]
    w, cap = [(3, 1, 2)[k % 3] for k in range(len(s))], [2 * x for x in s]
    target, left, free = [0.0] * len(s), 1.5 * sum(s), set(range(len(s)))
    while True:
        unit = left / sum(w[k] for k in free)
        over = [k for k in free if w[k] * unit > cap[k] + 1e-9]
        if not over:
            break
        for k in over:
            target[k] = cap[k]
            left -= cap[k]
            free.remove(k)
    for k in free:
        target[k] = w[k] * unit
    for name, t in zip(names, target, strict=True):
        own = got[got.source.isna()] if name is None else got[got.source == name]
        assert np.allclose(own.target, t)
        assert abs(own.taken.sum() - t) <= max(50, 0.01 * t)
    again = cube_mix.mix(df, block=64).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert cube_mix.mix(df.limit(0)).count() == 0


def test_apply_mix_repeats_rows(spark, corpus):
    out = cube_mix.apply_mix(corpus)
    assert out.columns == corpus.columns
    taken = {(r.doc_id, r.part): 0 for r in cube_mix.mix(corpus).collect()}
    for r in cube_mix.mix(corpus).collect():
        taken[r.doc_id, r.part] += r.copies
    got = Counter((r.doc_id, r.part) for r in out.select("doc_id", F.xxhash64("text").alias("part")).collect())
    assert dict(got) == {k: v for k, v in taken.items() if v}


def test_html_blocks_and_entities():
    page = "<html><head><title>t</title><script>var a='</p><p>no</p>';</script></head><body><p>A &amp; B&nbsp;c<br>d <b>e<p>f  g\n h</p><!-- <p>x</p> --><div>i<div>j</div>k</div><a href='>'>l</a> 1 < 2</body>"
    assert [b.text for b in html_crf.blocks(page)] == ["A & B c d e", "f g h", "i", "j", "k", "l 1 < 2"]
    assert html_crf.blocks("") == [] and html_crf.blocks("plain")[0].text == "plain"
    assert html_crf.blocks("<p>cut off <a href=\"x")[0].text == "cut off"


def test_html_missing_end_tags_lose_no_text():
    text = lambda page: [b.text for b in html_crf.blocks(page)]
    page = "<html><head><title>x</title><meta charset=utf-8><style>a</style>{}<article><h1>One</h1><p>Two.</article>"
    for start in ("<body>", "", "<noscript><img></noscript>", "</head><body>"):
        got = html_crf.blocks(page.format(start))
        assert [b.text for b in got] == ["One", "Two."] and not any("head" in b.above for b in got)
    assert text("<head>plain<p>next")[-2:] == ["plain", "next"]
    for tag in ("svg", "select", "object", "noscript", "template", "iframe", "math"):
        assert text(f"<article><p>One</p><{tag} class='c'><p>Two</p></article><p>Three") == ["One", "Two", "Three"], tag
    assert text("<p>One</p><svg><path/><p>Two</p><svg><text>no</text><title/></svg><p>Three</p>") == ["One", "Two", "Three"]
    assert text("<p>a</p><noscript><p>no</p></noscript><select><option>no</select><svg><style/><text>no</text></svg><p>b</p>") == ["a", "b"]
    assert text("<p>For <math><mi>x</mi><mo>=</mo><mn>2</mn></math> see <object data=f><b>file</b></object> here</p>") == ["For x=2 see file here"]
    assert text("<svg>" * 20_000 + "end") == ["end"]


def test_html_field_on_held_out_pages():
    field = html_crf.train(html_crf.labelled_pages(200, 1))
    wrong = total = 0
    for page, labels in html_crf.labelled_pages(80, 999):
        got = field.decode(html_crf.features(html_crf.blocks(page)))
        assert len(got) == len(labels)
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong <= 0.02 * total
    # Viterbi is the best of all labellings
    feats = html_crf.features(html_crf.blocks(html_crf.labelled_pages(1, 5)[0][0]))[:9]
    s = field.scores(feats)

    def value(y):
        return field.start[y[0]] + sum(s[i] for i, v in enumerate(y) if v) + sum(field.pairs[a, b] for a, b in zip(y[:-1], y[1:], strict=True))

    best = max((tuple(m >> i & 1 for i in range(len(feats))) for m in range(1 << len(feats))), key=value)
    assert abs(value(best) - value(tuple(int(v) for v in field.decode(feats)))) < 1e-9


def test_html_extraction(spark):
    page = "<body><nav><ul><li><a href=/>home</a></li></ul></nav><div class=\"ad\">Buy now. Cheap.</div><article><h1>Title here</h1><p>First of all, this is text. It goes on.</p><p>Second one.</p></article><section class=\"comments\"><p>I like it. So much.</p></section><footer>&copy; me</footer></body>"
    df = spark.createDataFrame([(1, "u", page, 0), (2, None, None, 0), (None, "v", "", 0), (1, "u", page, 0)], "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in html_crf.extract(df).collect()), key=str)
    text = "Title here First of all, this is text. It goes on. Second one."
    assert got == sorted([(1, "u", text, len(text)), (2, None, "", 0), (None, "v", "", 0), (1, "u", text, len(text))], key=str)
    assert html_crf.extract(df.limit(0)).count() == 0
    assert html_crf.extract(df, with_blocks=True).where("page_id = 1").first().blocks[0].content is False


def test_sharding_query_agrees_with_a_table_filled_slot_by_slot(spark, tmp_path, prose):
    """The whole query against an independent fill: every shard walks its own order, one claim a turn."""
    from tessera.llm import queries

    spark.createDataFrame([(k * 7919, prose(k, 3), "c") for k in range(400)] + [(None, "a", "c"), (None, None, "c"), (5, None, "c")], "doc_id long, text string, shard string").write.parquet(f"{tmp_path}/documents.parquet")
    size, names = sharding.SIZE, sharding.SHARDS
    walks = []
    for name in names:
        d = hashlib.sha256(name.encode()).digest()
        first, step = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        walks.append(iter([(first + k * step) % size for k in range(size)]))
    owner = {}
    while len(owner) < size:
        for name, walk in zip(names, walks, strict=True):
            for at in walk:
                if at not in owner:
                    owner[at] = name
                    break
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    want = [(r.doc_id, owner[r.k % size]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", key.alias("k")).collect()]
    assert sorted((tuple(r) for r in queries.op2_sharding(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_clashing_columns_are_kept(spark, prose):
    from tessera.llm import jaccard_rtree

    rows = [(k, prose(k, 30), k, k + 1, k + 2, "x", {"a": k}, k) for k in range(6)] + [(3, prose(3, 30), 9, 9, 9, "y", {"b": 1}, 9), (None, prose(3, 40), 1, 1, 1, "z", {}, 1), (-1, prose(3, 40), 1, 1, 1, "z", {}, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot long, id long, h long, source string, part map<string,long>, n long")
    key = lambda d: sorted(str(r) for r in d.collect())
    assert key(sharding.place(df).drop("shard")) == key(df)
    kept = jaccard_rtree.keep_first(df)
    assert kept.columns == df.columns and kept.count() == 7
    got = cube_mix.apply_mix(df)
    assert got.columns == df.columns and {str(r) for r in got.collect()} <= {str(r) for r in df.collect()}
    taken = Counter((r.doc_id, r.part) for r in cube_mix.mix(df).collect() for _ in range(r.copies))
    assert Counter((r.doc_id, r.x) for r in got.select("doc_id", F.xxhash64("text").alias("x")).collect()) == taken


def test_decontamination_of_words_alike_under_weak_hashes(spark):
    t = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    swapped = t.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, t + swapped), (2, swapped + t)], "doc_id long, text string")
    bench = spark.createDataFrame([("i", t + swapped)], "item_id string, text string")
    for most in (1 << 20, 100):
        assert {r.doc_id: r.n_hit for r in decontam.find(docs, bench, most).collect()} == {1: 1, 2: 0}


def test_html_pages_by_hand():
    """Pages that no template makes: unseen names, no frame, deep nesting."""
    field = html_crf.default_field()
    text = lambda page: field.extract(page)[0]
    assert text("<p>Only this paragraph stands here. It is short.</p>") == "Only this paragraph stands here. It is short."
    assert text("Bare text page without any tags. It goes on.") == "Bare text page without any tags. It goes on."
    page = "<body><div class='qx1'><a href=/>Home</a> <a href=/b>Blog</a></div><article><h1>Rivers</h1><p>A river flows. It ends in the sea.</p><p>Some rivers are long.</p></article><div id='{}'><p>I like it. So much.</p></div><div class='qx2'>&copy; Someone</div>"
    for name in ("disqus", "talk", "zz9"):
        assert text(page.format(name)) == "Rivers A river flows. It ends in the sea. Some rivers are long."
    assert text("<div>" * 30_000 + "Deep text. It is here." + "</div>" * 30_000) == "Deep text. It is here."


def test_html_query_against_a_slow_decoder(spark, tmp_path):
    """The whole query against the best of all labellings, block by block."""
    from tessera.llm import queries

    pages_ = [p for p, _ in html_crf.labelled_pages(60, 77)]
    pages_ = [p for p in pages_ if 0 < len(html_crf.blocks(p)) <= 13][:12]
    spark.createDataFrame([*enumerate(pages_), (99, None)], "page_id long, html string").withColumn("url", F.lit("u")).write.parquet(f"{tmp_path}/pages.parquet")
    field, want = html_crf.default_field(), {99: ""}
    for i, p in enumerate(pages_):
        found = html_crf.blocks(p)
        s = field.scores(html_crf.features(found))
        best = max(
            (tuple(m >> j & 1 for j in range(len(found))) for m in range(1 << len(found))),
            key=lambda y, s=s: field.start[y[0]] + sum(s[j] for j, v in enumerate(y) if v) + sum(field.pairs[a, b] for a, b in zip(y[:-1], y[1:], strict=True)),
        )
        want[i] = " ".join(b.text for b, v in zip(found, best, strict=True) if v)
    assert {r.page_id: r.text for r in queries.op3_html_extraction(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("most", [common.MOST_BROADCAST, 200])
def test_item_ids_of_any_characters(spark, prose, most):
    passage, other = prose(70, 20), prose(71, 20)
    bench = spark.createDataFrame([("a\0b", passage), ("c", other), ('q"[,', passage), (None, other)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"{passage} and {other}"), (2, "clean words")], "doc_id long, text string")
    got = {r.doc_id: (r.n_items, r.items, r.digest) for r in decontam.find(docs, bench, most).collect()}
    assert got[1][:2] == (3, sorted(["a\0b", "c", 'q"[,'])) and got[2][:2] == (0, []) and all(d and len(d) == 40 for _, _, d in got.values())
