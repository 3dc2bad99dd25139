"""Windows of texts are looked at few at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.llm import repeats


class Docs:
    """Stands for the documents, and runs the step on a batch here."""

    def __init__(self, spark, batch):
        self.sparkSession, self.batch = spark, batch

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return list(run(iter([self.batch])))


def test_windows_take_little_memory(spark):
    r = np.random.default_rng(1)
    texts = [r.integers(97, 123, 20_000, dtype=np.uint8).tobytes().decode() for _ in range(50)]
    docs = Docs(spark, pa.record_batch([pa.array(range(50), pa.int64()), pa.array(texts)], ["doc_id", "text"]))
    tracemalloc.start()
    rows = repeats.fingerprints(docs, repeats.Windows("bytes", 50, 16), 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in rows) and peak < 40e6, peak
