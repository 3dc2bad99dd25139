import hashlib

import numpy as np
import pytest

from tessera.llm import common, repeats, substring_lsm, suffix_bwt, textnum


def order(i):
    return float("inf") if i is None else i


def brute(rows, units, span):
    first = {}
    split = [units(t or "") for _, t in rows]
    for (i, _), u in zip(rows, split, strict=True):
        for p in range(len(u) - span + 1):
            key = tuple(u[p : p + span])
            first[key] = min(first.get(key, order(i)), order(i))
    for (i, _), u in zip(rows, split, strict=True):
        gone = np.zeros(len(u), bool)
        for p in range(len(u) - span + 1):
            if first[tuple(u[p : p + span])] < order(i):
                gone[p : p + span] = True
        yield i, u, gone


def words_of(rows, span):
    out = [(i, len(u), int(g.sum()), hashlib.sha256(b" ".join(w for w, x in zip(u, g, strict=True) if not x)).hexdigest()) for i, u, g in brute(rows, lambda t: t.encode().split(), span)]
    return sorted(out, key=str)


def bytes_of(rows, span):
    out = []
    for i, u, g in brute(rows, lambda t: list(t.encode()), span):
        runs = int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum())
        out.append((i, len(u), int(g.sum()), runs, hashlib.sha256(bytes(b for b, x in zip(u, g, strict=True) if not x)).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("batches", [1, 3])
def test_words_agree_with_brute_force(spark, corpus, batches):
    got = substring_lsm.remove_repeats(spark, corpus, batches=batches, max_runs=1).collect()
    assert sorted((tuple(r) for r in got), key=str) == words_of(rows_of(corpus), 50)


def test_bytes_agree_with_brute_force(spark, corpus):
    got = suffix_bwt.remove_repeats(spark, corpus, shard=3000).collect()
    assert sorted((tuple(r) for r in got), key=str) == bytes_of(rows_of(corpus), 50)


def test_texts_are_returned(spark, prose):
    passage = prose(1, 60)
    df = spark.createDataFrame([(1, passage), (2, "before " + passage + " after")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in substring_lsm.remove_repeats(spark, df, with_text=True).collect()} == {1: passage, 2: "before after"}
    kept = {r.doc_id: bytes(r.kept).decode() for r in suffix_bwt.remove_repeats(spark, df, with_text=True).collect()}
    assert kept[1] == passage and kept[2] in ("before after", "before  after", "beforeafter", "before after ", "before")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, blob string")
    assert substring_lsm.remove_repeats(spark, df).count() == 0
    assert suffix_bwt.remove_repeats(spark, df).count() == 0


def test_index_is_incremental(spark, prose):
    """A batch added later gives what all at once would, also after a compaction."""
    passage = prose(1, 70)
    docs = [(k, prose(10 + k, 30) + " " + (passage if k % 2 else prose(50 + k, 70)) + " " + prose(90 + k, 20)) for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = substring_lsm.FingerprintIndex(spark, common.Scratch(spark, "t"), max_runs=1)
    for k in range(0, 12, 3):
        index.add(df.where(f"doc_id >= {k} AND doc_id < {k + 3}"))
        assert len(index.runs) == 1
    assert index.entries().count() > 0


def test_merge_is_the_sorted_order():
    """Interleave refinement of shards gives the order and the common prefixes of all suffixes."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(1, 3, n).astype(np.uint16) for n in (20, 31, 7, 25, 40)]
    depth, shards, orders, at = 12, [], [], 0
    for part in (texts[:2], texts[2:4], texts[4:]):
        symbols = np.concatenate([np.append(t, 0) for t in part]).astype(np.uint16)
        ends = np.cumsum([len(t) + 1 for t in part])
        o = suffix_bwt.shard_order(symbols, ends, depth)
        shards.append(suffix_bwt.transform(symbols, ends, o))
        orders.append(o + at)
        at += len(symbols)
    z, block = suffix_bwt.merge(shards, depth)
    place = np.empty(len(z), np.int64)
    place[np.argsort(z, kind="stable")] = np.concatenate(orders)
    suffixes = []
    for t in texts:
        s = [*t.tolist(), 0]
        suffixes += [tuple((s[i:] + [0] * depth)[:depth]) for i in range(len(s))]
    got = [suffixes[p] for p in place]
    full = [(b, s) for b, s in zip(block, got, strict=True) if 0 not in s]
    assert [s for _, s in full] == sorted(s for _, s in full)
    same = {}
    for b, s in full:
        assert same.setdefault(b, s) == s
    assert len(set(same.values())) == len(same)


def test_windows_and_hashes():
    buf = np.frombuffer(b"ab cd ab cd", np.uint8)
    words = textnum.Words(buf, np.array([0, 11]))
    h = words.hashes()
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    w = textnum.Spans(h).windows(2)
    assert w[0] == w[2] != w[1]
    x = np.array([5, 3, 9, 3, 8, 1, 7], np.uint64) << np.uint64(40)
    assert textnum.anchors(x, 3).tolist() == [1, 1, 3, 5, 5]
    s, e = textnum.union_length(np.array([5, 0, 3]), np.array([9, 4, 5]))
    assert (s.tolist(), e.tolist()) == ([0], [9]) or (s.tolist(), e.tolist()) == ([0, 3], [4, 9])


def test_rows_of_negative_ids():
    """Packed rows stand in the order of signed ids."""
    columns = [np.array([-9, -5, -5, 0, 3, 3, 8]), np.array([1, 2, 4, 1, 1, 6, 2], np.uint16)]
    ids, tags = np.array([3, -5, 8, -9, -7, 0]), np.array([6, 4, 2, 1, 1, 1], np.uint16)
    assert repeats.rows_of(columns, ids, tags) == [(5, 6), (2, 3), (6, 7), (0, 1), (1, 1), (3, 4)]


def test_results_of_batches_are_those_of_all_at_once(spark, prose):
    """Spans of batches added one by one, also by a second index on the same folder, with compactions in between."""
    passage = prose(1, 70)
    docs = [(k, prose(10 + k, 30) + " " + (passage if k % 2 else prose(50 + k, 70)) + " " + prose(90 + k, 20)) for k in range(12)] + [(12, passage + " " + prose(10, 60)), (13, prose(99, 30) + " " + passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    scratch = common.Scratch(spark, "t")
    folder, spans = scratch.path("index"), {}
    for k in range(0, 14, 3):
        index = substring_lsm.FingerprintIndex(spark, folder, max_runs=2)  # opened anew each time
        batch = df.where(f"doc_id >= {k} AND doc_id < {k + 3}")
        for r in index.spans(df.where(f"doc_id < {k + 3}"), batch, scratch).collect():
            for i, _, a, b in zip(*common.unpack(bytes(r.blob)), strict=True):
                spans.setdefault(int(i), set()).update(range(int(a), int(b)))
        assert 1 <= len(index.runs) <= 2
    assert {i: len(x) for i, x in spans.items()} == {i: n for i, _, n, _ in words_of(docs, 50) if n}
    assert substring_lsm.FingerprintIndex(spark, folder).entries().count() > 0
    import os

    assert len([f for f in os.listdir(folder.removeprefix("file://")) if f.startswith("run-")]) == len(index.runs)


@pytest.mark.parametrize("op,want", [(suffix_bwt, bytes_of), (substring_lsm, words_of)])
def test_without_hashes_the_same_is_removed(spark, corpus, op, want):
    got = op.remove_repeats(spark, corpus, by_hash=False).collect()
    assert sorted((tuple(r) for r in got), key=str) == want(rows_of(corpus), 50)


@pytest.mark.parametrize("op,want", [(suffix_bwt, bytes_of), (substring_lsm, words_of)])
def test_many_rows_without_an_id(spark, prose, op, want):
    """Null ids and repeated ids that share a passage: each row keeps its own text."""
    passage = prose(1, 60)
    rows = [(None, f"{prose(100 + k, 6)} {passage} {prose(5000 + k, 4)}") for k in range(1500)] + [(5, passage), (7, passage + " a"), (7, "b " + passage)]
    got = op.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == want(rows, 50)


def test_thue_morse_words_are_not_removed(spark, prose):
    t = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    swapped, words = t.translate(str.maketrans("ab", "ba")), prose(4, 49)
    rows = [(1, f"{t}{swapped} {words}"), (2, f"{swapped}{t} {words}"), (3, f"{t}{swapped} {words}")]
    got = substring_lsm.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == words_of(rows, 50)


def test_spans_of_wide_rules(spark, corpus):
    """Runs of more than 255 windows."""
    got = suffix_bwt.remove_repeats(spark, corpus, rule=repeats.Windows("bytes", 300, 16)).collect()
    assert sorted((tuple(r) for r in got), key=str) == bytes_of(rows_of(corpus), 300)


def test_runs_merge_in_order():
    rng = np.random.default_rng(3)
    parts = []
    for n in (50, 1, 70):
        g, c, c2 = rng.integers(0, 4, n).astype(np.uint32), rng.integers(0, 3, n).astype(np.uint64), rng.integers(0, 2, n).astype(np.uint64)
        o = np.lexsort((c2, c, g))
        parts.append([g[o], c[o], c2[o], rng.integers(0, 9, n)])
    g, c, c2, d, run = repeats.merge_runs(parts)
    rows = sorted((int(a), int(b), int(x), int(y), k) for k, p in enumerate(parts) for a, b, x, y in zip(*p, strict=True))
    assert sorted(zip(g.tolist(), c.tolist(), c2.tolist(), d.tolist(), run.tolist(), strict=True)) == rows
    assert [r[:3] for r in zip(g.tolist(), c.tolist(), c2.tolist(), strict=True)] == [r[:3] for r in rows]


def test_rows_without_id_are_dealt_evenly():
    """200,000 rows of one id, or none, and unlike texts: no bucket has over twice its share."""
    rng = np.random.default_rng(3)
    for doc in (repeats.NULL_ID, 17):
        n = np.bincount(repeats.doc_bucket(np.full(200_000, doc, np.int64), rng.integers(0, 1 << 63, 200_000).astype(np.uint64), 64), minlength=64)
        assert n.min() > 0 and n.max() < 2 * 200_000 / 64
    packed = repeats.by_doc(0, 64, np.full(1000, 5, np.int64), rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert len(packed) == 64


def test_anchors_don_t_depend_on_the_batch():
    """Grams that differ in low bits only have the same least one in a short batch and at the head of a long one."""
    rng = np.random.default_rng(4)
    for w in (1, 2, 3, 7, 17, 34):
        grams = (rng.integers(0, 6, 400) + (1 << 40)).astype(np.uint64)
        got = textnum.anchors(grams, w)
        want = [p + int(np.argmin(grams[p : p + w])) for p in range(len(grams) - w + 1)]
        assert got.tolist() == want
        assert textnum.anchors(grams[:w], w).tolist() == want[:1] and len(textnum.anchors(grams[: w - 1], w)) == 0
