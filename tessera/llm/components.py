"""Connected components of a graph of 64-bit nodes.

Up to FEW edges one task joins them: 8 MB, whatever the size of the corpus. Beyond that by least labels with pointer
jumping, where no task holds a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FEW = 1 << 19


def join_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least labels of all edges of a partition: hooks on the least neighbour and halves paths until nothing moves."""
    parts = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches if len(b)]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts, 1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        for x in (a, b, label[a], label[b]):  # the nodes and the heads they point to
            np.minimum.at(new, x, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[label])], ["k", "l"])


def components(edges: DataFrame, scratch: common.Scratch, most_rounds: int = 60, few: int = FEW) -> DataFrame:
    """k, l: for each node of edges (a, b) the least node that it reaches. Every round is written to the shared folder.

    A round takes the least label of the neighbours by a partial aggregate (no neighbour lists), then the label of that
    label, so chains halve. Raises if the rounds run out.
    """
    if edges.count() <= few:
        return scratch.keep(edges.select("a", "b").coalesce(1).mapInArrow(join_few, "k long, l long"), "labels")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.keep(both, "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("l"), F.lit(True).alias("moved")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("k").alias("b"), "l"), "b").groupBy(F.col("a").alias("k")).agg(F.min("l").alias("m"))
        hop = labels.select(F.col("k").alias("h"), F.col("l").alias("hl"))
        new = labels.join(near, "k").select("k", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        new = new.join(hop, new["l"] == hop["h"]).select("k", F.least("l", "hl").alias("l"), (F.least("l", "hl") < F.col("was")).alias("moved"))
        last, labels = labels, scratch.keep(new, "labels")
        scratch.drop_table(last)
        if labels.where("moved").isEmpty():
            return labels.select("k", "l")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
