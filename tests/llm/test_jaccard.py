import numpy as np
import pytest

from tessera.llm import common, jaccard_rtree
from tessera.llm.components import components


def brute(rows, percent=80):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    n = len(rows)
    parent = list(range(n))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), float("inf")), float("inf") if i is None else i)
    return sorted(((i, len(s), None if least[find(k)] == float("inf") else int(least[find(k)])) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_join_agrees_with_brute_force(spark, corpus):
    got = [tuple(r) for r in jaccard_rtree.join(corpus).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == brute([(r.doc_id, r.text) for r in corpus.collect()])


def test_chains_of_near_copies(spark, prose):
    """Texts that are linked only through one another, and a group of many near copies."""
    words = prose(1, 400).split()
    rows = []
    for k in range(40):
        w = list(words)
        for j in range(k):
            w[j * 10] = f"new{j}"
        rows.append((100 - k, " ".join(w)))
    rows += [(200 + k, " ".join([*words[:200], f"only{k}", *words[201:300]])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard_rtree.join(df).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == brute(rows)


def test_forest_finds_all_pairs_within_the_bound():
    rng = np.random.default_rng(3)
    n = 300
    cell = np.sort(rng.integers(0, 6, n)).astype(np.int64)
    points = rng.integers(0, 4, (n, jaccard_rtree.GROUPS)).astype(np.uint8)
    points[1::2] = points[::2]
    points[1::2, :3] += rng.integers(0, 3, (n // 2, 3)).astype(np.uint8)
    size = points.sum(1).astype(np.int64)
    label = rng.integers(0, 50, n)
    forest = jaccard_rtree.Forest(cell, points, size, label)
    got = {(int(a), int(b)) for x, y in forest.join(80, most=64) for a, b in zip(x, y, strict=True)}
    want = set()
    for a in range(n):
        for b in range(a + 1, n):
            bound = int(np.minimum(points[a], points[b]).sum())
            if cell[a] == cell[b] and label[a] != label[b] and 180 * bound >= 80 * (size[a] + size[b]):
                want.add((a, b))
    assert got == want and want


def test_keep_first_keeps_one_of_each(spark, corpus):
    kept = jaccard_rtree.keep_first(corpus)
    assert kept.columns == corpus.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    ids = [i for i, _ in rows]
    assert {1, 4, 6, 7, 9, 13} <= set(ids) and not {2, 3, 10, 11, 14} & set(ids)
    worded = [(i, t) for i, t in rows if t and t.strip()]
    assert len(worded) == len(set(worded)) and ids.count(15) == 2  # two unlike texts have this id


def test_keep_first_decides_by_row(spark, prose):
    """Distinct texts without an id or under one id all stay, once each; a near copy goes even if its id leads a component of its own."""
    copied = prose(40, 120)
    near = copied.rsplit(" ", 2)[0]
    rows = [(None, prose(50 + k, 60)) for k in range(6)] + [(None, prose(50, 60)), (7, prose(60, 60)), (7, prose(61, 60)), (7, prose(60, 60))]
    rows += [(1, copied), (8, near), (8, prose(62, 60)), (None, copied), (9, None), (9, None), (None, ""), (None, None)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long")
    want = {*rows} - {(8, near), (None, copied)}
    got = [(r.doc_id, r.text) for r in jaccard_rtree.keep_first(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_rtree.join(df).count() == 0
    assert jaccard_rtree.keep_first(df).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 19])
def test_components_of_a_path_and_a_star(spark, few):
    edges = [((k * 7) % 31, (k * 7 + 7) % 31) for k in range(30)] + [(149, 100 + k) for k in range(49)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.k: r.l for r in components(df, common.Scratch(spark, "t"), few=few).collect()}
    assert got == {k: 0 for k in range(31)} | {100 + k: 100 for k in range(50)}


@pytest.mark.parametrize("percent", [50, 80])
def test_rounds_and_chunks_agree_with_brute_force(spark, prose, percent):
    """Distributed components, cells in chunks, one proposal at first; other thresholds."""
    words = prose(21, 60).split()
    rows = []
    for k in range(24):
        w = list(words)
        for j in range(k % 6):
            w[(k * 7 + j * 9) % 60] = f"new{k}x{j}"
        rows.append((k, " ".join(w[: 60 - k % 5])))
    rows += [(100, " ".join(f"w{j}" for j in range(14))), (101, " ".join([*(f"w{j}" for j in range(10))])), (102, " ".join(f"w{j}" for j in range(4, 14)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard_rtree.join(df, percent=percent, few=0, chunk=3, most=1).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == brute(rows, percent)


def test_thue_morse_words_are_not_linked(spark):
    """Two different words that cancel out under a polynomial modulo 2**64."""
    t = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    swapped = t.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, t + swapped), (2, swapped + t), (3, t), (4, swapped)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_rtree.join(df).collect()} == {k: k for k in (1, 2, 3, 4)}


def test_folded_points_bound_the_overlap():
    rng = np.random.default_rng(8)
    for n, m in ((30, 40), (700, 800), (5000, 6100)):
        both = rng.integers(0, 2**64, n // 2, dtype=np.uint64)
        sets = [np.concatenate((both, rng.integers(0, 2**64, k - len(both), dtype=np.uint64))) for k in (n, m)]
        points = []
        for x in sets:
            e = int(jaccard_rtree.power_of(np.array([len(x)]))[0])
            points.append(np.bincount((x >> np.uint64(64 - e)).astype(np.int64), minlength=1 << e).astype(np.uint8)[None])
        least = min(p.shape[1] for p in points)
        p, q = (jaccard_rtree.fold(v, (v.shape[1] // least).bit_length() - 1) for v in points)
        assert p.sum() == n and q.sum() == m and np.minimum(p, q).sum() >= len(both)


def test_unlike_sets_that_share_half_a_key(spark, corpus):
    """With few bits in the first half of the keys most sets share one; classes and components stay what they are."""
    want = sorted((tuple(r) for r in jaccard_rtree.join(corpus).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    for mask in (7, 0):
        got = jaccard_rtree.join(corpus, mask=mask)
        assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == want
