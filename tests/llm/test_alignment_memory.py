"""What a worker holds of a block while it counts pairs and adds up documents."""

import collections
import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tessera.llm import common, token_alignment

N_UNITS, N_PLACES = 3000, 1_500_000


class Rows:
    """Stands for a table: keeps the function over Arrow batches."""

    def mapInArrow(self, f, schema):
        self.run = f
        return self

    def groupBy(self, *_):
        return self

    agg = groupBy


def block(number: int):
    """Rows of by_block() for one block with lost units, a null, an empty and a very long document, and its parts."""
    rng = np.random.default_rng(number)
    ends = np.append(np.sort(rng.choice(np.arange(1, N_PLACES // 2), 2000, replace=False)), N_PLACES)
    places = rng.zipf(1.3, N_PLACES) % N_UNITS
    places[: ends[0]] = 0
    ids, null, some = np.arange(len(ends)) + 10_000 * number, np.zeros(len(ends), bool), np.ones(len(ends), bool)
    null[5], some[6] = True, False
    lost = np.zeros(N_UNITS, bool)
    lost[[2990, 2995]] = True
    docs = zstandard.ZstdCompressor(level=1).compress(common.pack(ids, null, some, ends.astype(np.int64), np.ascontiguousarray(places.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).ravel()))
    pairs = [None if lost[k] else np.unique(rng.integers(0, 500, k % 4 + 1)).tolist() for k in range(N_UNITS)]
    groups = [None if lost[k] else f"{k}|{k + number}" for k in range(N_UNITS)]
    sums = {name: rng.integers(0, 1 << 20, N_UNITS) for name in token_alignment._SUMS}
    units = pa.table({"unit": pa.array(np.arange(N_UNITS), pa.int32()), "pairs": pa.array(pairs, pa.list_(pa.int64())), "groups": groups} | {k: pa.array(v, mask=lost) for k, v in sums.items()})
    order, blobs = rng.permutation(N_UNITS), [docs]
    for own in (order[: N_UNITS // 3], order[N_UNITS // 3 :]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, units.schema) as out:
            out.write_table(units.take(pa.array(np.sort(own))))
        blobs.append(sink.getvalue().to_pybytes())
    own = [places[i:j] for i, j in zip(np.append(0, ends[:-1]), ends, strict=True)]
    return [pa.record_batch([pa.array([number]), pa.array([x], pa.binary())], ["block", "blob"]) for x in blobs], (ids, null, some, lost, own, pairs, groups, sums)


def run(step):
    both = [block(k) for k in (1, 2)]
    rows = Rows()
    step(rows)
    tracemalloc.start()
    try:
        out = list(rows.run(iter([x for batches, _ in both for x in batches])))
        return pa.Table.from_batches(out).to_pylist(), [parts for _, parts in both], tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("held", [1 << 18, 1000])
def test_documents_of_a_block_are_added_up_some_at_a_time(spark, monkeypatch, held):
    monkeypatch.setattr(token_alignment, "MOST_HELD", held)
    got, blocks, peak = run(token_alignment.documents)
    want = []
    for ids, null, some, lost, own, _, groups, sums in blocks:
        for k, places in enumerate(own):
            whole = some[k] and not lost[places].any()
            row = {"doc_id": None if null[k] else int(ids[k])} | {name: int(v[places].sum()) if whole else 0 for name, v in sums.items()}
            want.append(row | {"groups_sha256": hashlib.sha256(";".join(groups[p] for p in places).encode()).hexdigest() if whole else ""})
    assert got == want and len({bool(r["groups_sha256"]) for r in got}) == 2
    assert peak < 24 * N_PLACES


@pytest.mark.parametrize("held", [1 << 18, 1000])
def test_pairs_of_a_block_are_counted_some_documents_at_a_time(spark, monkeypatch, held):
    monkeypatch.setattr(token_alignment, "MOST_HELD", held)
    got, blocks, peak = run(token_alignment.pair_counts)
    want = collections.Counter()
    for _, _, some, lost, own, pairs, _, _ in blocks:
        for k, places in enumerate(own):
            if some[k] and not lost[places].any():
                want.update({p for u in np.unique(places) for p in pairs[u]})
    have = collections.Counter()
    for r in got:
        have[r["pair"]] += r["n"]
    assert have == want
    assert peak < 24 * N_PLACES
