"""Token alignment, stored token ids and whitening against brute force on small fixtures."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import common, queries, token_alignment, token_store, units, whitening

WORD, BYTE, PIECE = (str(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))

#: Where cutting could go wrong: white space of all kinds, contractions, combining marks, special tokens, marks, other scripts.
PARTS = ["J\u030c", "TH\u0331", "<|EndOfText|>", "WORD", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", " ", " ", "　", "\u0085", "a", "word", "Été", "naïve", "é", "≠", "́", "'s", "'", "’s", "don't", ".", ",", "...", "(", "<|endoftext|>", "<|startoftext|>", "<|end", "|>", "1", "2024", "3.14", "中文", "ＡＢ", "🙂", "ﬁ", "Σας", "İ", "ß", "—", "​", "<0x0A>", "</s>", "_", "x" * 40, "\x00", "#", "²", "×"]
texts = st.lists(st.sampled_from(PARTS), max_size=25).map("".join) | st.text(max_size=40)


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return Tokenizer.from_file(WORD), a, SentencePieceProcessor(model_file=PIECE)


def clean(t):
    return t.encode("utf-8", "ignore").decode()


@settings(max_examples=400, deadline=None, derandomize=True)
@given(st.lists(texts, max_size=4))
def test_units_give_the_ids_of_whole_texts(tokenizers, several):
    several = [clean(t) for t in several]
    ids, ends = token_store.token_ids(pa.array(several, pa.string()), WORD)
    got = [ids[a:b].tolist() for a, b in itertools.pairwise([0, *ends.tolist()])]
    assert got == [e.ids for e in tokenizers[0].encode_batch(several, add_special_tokens=False)]
    pair = token_alignment._pair(BYTE, PIECE)
    distinct, places, begins = units.units(pa.array(several, pa.string()))
    first, second, bad = pair.memo(distinct)
    for k, t in enumerate(several):
        own = places[begins[k] : begins[k + 1]]
        if t and not bad[0][own].any():
            assert units.ragged(*first, own)[0].tolist() == tokenizers[1].encode(" " + t, add_special_tokens=False).ids
            assert units.ragged(*second, own)[0].tolist() == tokenizers[2].encode(t)


def test_units_of_nulls_and_slices():
    col = pa.array(["skip", None, "", "one two", " "], pa.string()).slice(1)
    distinct, places, begins = units.units(col)
    distinct = distinct.to_pylist()
    assert [[distinct[u] for u in places[a:b]] for a, b in itertools.pairwise(begins)] == [[" "], [" "], [" one", " two"], ["  "]]
    distinct, places, begins = units.units(pa.array([], pa.string()))
    assert not len(distinct) and not len(places) and list(begins) == [0]


def test_crossed_pieces():
    assert units.crossed(["a,"]) and units.crossed(["x▁y"]) and not units.crossed(["▁▁", "▁a", ",a", "中,", "ab", "'s"])


@pytest.fixture(scope="module")
def docs(spark, prose):
    random.seed(5)
    rows = [(k, prose(k % 7, 30 + 20 * (k % 3)) + "\nIt's “quoted”, don't, 3.14 naïve été.") for k in range(40)]
    rows += [(100 + k, "".join(random.choice(PARTS) for _ in range(60))) for k in range(40)]
    rows += [(None, "no id here"), (None, "no id here"), (None, None), (7, "another text of an id"), (7, "another text of an id"), (200, None), (201, ""), (202, " "), (203, "literal ▁ mark"), (204, prose(3, 6000)), (205, "x" * 30000), (-3, "aaaaaaaaaaaaaaaaaaa" * 20)]
    data = [(i, None if t is None else clean(t), "b", 1, "u", 2) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, block string, n_a int, units string, start long").repartition(5)


def test_stored_ids_are_those_of_the_library(spark, docs, tokenizers):
    manifest = token_store.write_tokens(spark, docs, common.Scratch(spark, "t").path("ids"), WORD, file_ids=4000)
    got = [tuple(r) for r in token_store.read_tokens(spark, manifest).collect()]
    rows = [(r.doc_id, tuple(tokenizers[0].encode(r.text or "", add_special_tokens=False).ids + [2])) for r in docs.select("doc_id", "text").collect()]
    assert manifest.count() > 3 and manifest.agg({"n_ids": "sum"}).first()[0] == sum(len(x) for _, x in rows)
    places = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in places] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for _, start, n, _ in places:
        assert start == at
        at += n
    assert collections.Counter((r[0], r[2], r[3]) for r in got) == collections.Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in rows)


def test_any_id_is_read_by_its_place(tmp_path):
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 200), (511, 256), (512, 1 << 32), (513, 70_000), (20_000, 49_408)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        ends = np.array([n // 3, n // 3, n], np.int64)
        (tmp_path / "x.dac").write_bytes(token_store.encoded(ids, [None, -4, 9], ends))
        with token_store.TokenFile(f"file://{tmp_path}/x.dac") as f:
            f.check()
            assert len(f) == n and f.documents()[0] == [None, -4, 9] and f.documents()[1].tolist() == ends.tolist()
            assert f.span(0, n).tolist() == ids.tolist()
            for i in rng.integers(0, n, min(n, 60)) if n else ():
                j = int(rng.integers(i, n + 1))
                assert f[int(i)] == ids[i] and f.span(int(i), j).tolist() == ids[i:j].tolist()
            with pytest.raises(IndexError):
                f[n]
    assert len(token_store.levels(np.array([1 << 31], np.uint32))) == 4
    raw = bytearray((tmp_path / "x.dac").read_bytes())
    raw[-1] ^= 1
    (tmp_path / "x.dac").write_bytes(raw)
    with token_store.TokenFile(f"file://{tmp_path}/x.dac") as f, pytest.raises(ValueError, match="checksum"):
        f.check()


def test_reading_one_id_doesn_t_read_the_file(tmp_path):
    ids = np.arange(200_000, dtype=np.uint32) % 49_408
    (tmp_path / "x.dac").write_bytes(token_store.encoded(ids, [1], np.array([len(ids)])))
    with token_store.TokenFile(f"file://{tmp_path}/x.dac") as f:
        read, own = [], f._bytes
        f._bytes = lambda at, n: read.append(n) or own(at, n)
        assert f[123_456] == ids[123_456] and sum(read) < 200


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, extra string")
    manifest = token_store.write_tokens(spark, none, common.Scratch(spark, "t").path("ids"), WORD)
    assert manifest.count() == 0 and token_store.read_tokens(spark, manifest).count() == 0
    assert token_alignment.align(spark, none, BYTE, PIECE).count() == 0
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def alignment(rows, tokenizers):
    _, a, b = tokenizers
    spell, count, found = token_alignment.byte_of_char(), collections.Counter(), []
    for i, t in rows:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        sizes = [bytes(spell[c] for c in a.id_to_token(k)) for k in ids[0]], [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids[1]]
        if not t or not b"".join(sizes[0]) == b"".join(sizes[1]) == (" " + t).encode():
            found.append((i, 0, 0, [], []))
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in sizes]
        groups, p, q = [], 0, 0
        for e in sorted({*ends[0]} & {*ends[1]}):
            u, v = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append((ids[0][p:u], ids[1][q:v]))
            p, q = u, v
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        count.update({*links})
        found.append((i, len(ids[0]), len(ids[1]), groups, links))
    top = collections.Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    text = lambda g: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
    return [(i, n, m, len(g), len(k), sum(count[x] == top[x[0]] for x in k), sum(count[x] for x in k), hashlib.sha256(text(g).encode()).hexdigest() if n else "") for i, n, m, g, k in found]


@pytest.mark.parametrize("most_pairs", [1 << 20, 60, 0])
def test_alignment_agrees_with_brute_force(spark, docs, tokenizers, most_pairs):
    got = token_alignment.align(spark, docs, BYTE, PIECE, block_bytes=3000, most_pairs=most_pairs).collect()
    want = alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], tokenizers)
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert any(r.n_links > r.n_a for r in got) and any(r.groups_sha256 == "" for r in got)


@pytest.mark.parametrize(("n", "d"), [(300, 64), (40, 7), (500, 3)])
def test_whitening_agrees_with_numpy(spark, n, d):
    rng = np.random.default_rng(n)
    own = (rng.normal(size=(n, d)) * rng.uniform(0.2, 2, d) + rng.normal(size=d)).astype(np.float32)
    rows = [(k, v.tolist(), 1, "v") for k, v in enumerate(own)] + [(1000, own[0].tolist(), 2, "v"), (None, own[1].tolist(), 2, "v"), (1, own[2].tolist(), 1, "v")]
    rows += [(2001, None, 1, "v"), (2002, [None, *own[0][1:].tolist()], 1, "v"), (2003, [float("nan"), *own[0][1:].tolist()], 1, "v"), (2004, [float("inf"), *own[0][1:].tolist()], 1, "v"), (2005, [-0.0] * d, 1, "v")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, vector string").repartition(4)
    got = whitening.whiten(df, tile=5, rows=50)
    kept = [(i, np.floor(256 * np.array(v, np.float64)) + 0) for i, v, _, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    mean = fit.mean(0)
    cov = (fit - mean).T @ (fit - mean) / len(fit)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    found = got.collect()
    assert len(found) == len(kept) * len(e)
    sums = [int(x) for x in fit.sum(0)]
    want = collections.Counter()
    have = collections.Counter()
    for i, x in kept:
        deviation = sum((len(fit) * int(c) - s) ** 2 for c, s in zip(x, sums, strict=True))
        want.update((i, k + 1, len(fit), deviation, round(abs(float((x - mean) @ u[:, k] / e[k] ** 0.5)), 7)) for k in range(len(e)))
    have.update((r.vec_id, r.component, r.n, int(r.deviation), round(abs(r.whitened), 7)) for r in found)
    assert have == want
    assert all(abs(r.explained / (e[r.component - 1] / np.trace(cov)) - 1) < 1e-9 and r.identity_error < 1e-9 for r in found)
    signs = {k: {round(float(r.whitened / ((dict(kept)[r.vec_id] - mean) @ u[:, k - 1] / e[k - 1] ** 0.5))) for r in found if r.component == k and r.vec_id == 5} for k in range(1, len(e) + 1)}
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_vectors_without_variance(spark):
    flat = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in whitening.whiten(flat).collect()} == {(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)}
    line = spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.component): r.whitened for r in whitening.whiten(line).collect()} == {(1, 1): -1.0, (2, 1): 1.0, (1, 2): None, (2, 2): None}
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [0.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")).collect()


def test_deviation_beyond_64_bits(spark):
    far = spark.createDataFrame([(1, [0.0, 3.0e9]), (2, [2.0, -3.0e9])], "vec_id long, embedding array<double>")
    x = [(0, 768_000_000_000), (512, -768_000_000_000)]
    want = {i + 1: sum((2 * c - (p + q)) ** 2 for c, p, q in zip(v, *x, strict=True)) for i, v in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(far).collect()} == want and want[1] > 1 << 63


def test_registered_queries(spark):
    sf = "/root/testdata/sf0.001"
    out = queries.queries()["op12_embedding_whitening"](spark, sf)
    assert dict(out.dtypes)["deviation"] == "bigint"
    assert queries.queries()["op13_token_output"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
