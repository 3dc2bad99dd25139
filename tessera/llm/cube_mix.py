"""Mixing sources to target weights by the cube method.

Every document of a source is taken target / source_size times: the whole part for certain, the fraction as an
inclusion probability. The probabilities move through the null space of two constraints, the source's tokens and its
number of documents: with three documents in hand there is a direction that changes neither total, and a random step
along it rounds one of them. Blocks of a source fly at once and leave two documents each; these fly again, block by
block of blocks, until at most two documents a source are left, which are rounded with the least error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 8192
WORDS = r"[^\x20\x09-\x0D]+"
#: Sources up to which the table of targets is broadcast (under 100 bytes each).
MOST_SOURCES = 100_000
_EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved until two at most are fractions; keeps sum(p) and sum(p * size)."""
    p = p.tolist()
    size = size.tolist()
    dice = rng.random(len(p) + 8).tolist()
    hand: list[int] = []
    n = 0
    for k in range(len(p)):
        if _EPS < p[k] < 1 - _EPS:
            hand.append(k)
        while len(hand) == 3:
            a, b, c = hand
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = 1e300
            for i, d in zip(hand, u, strict=True):
                if d > 0:
                    up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
                elif d < 0:
                    up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
            move = up if dice[n % len(dice)] * (up + down) < down else -down
            n += 1
            for i, d in zip(hand, u, strict=True):
                p[i] += move * d
            rest = [i for i in hand if _EPS < p[i] < 1 - _EPS]
            if len(rest) == 3:  # rounding kept all inside
                nearest = min(hand, key=lambda i: min(p[i], 1 - p[i]))
                p[nearest] = float(round(p[nearest]))
                rest.remove(nearest)
            hand = rest
    return np.array([float(round(x)) if x <= _EPS or x >= 1 - _EPS else x for x in p])


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the fractions left, three at most, with the least error in tokens, then in documents."""
    at = np.flatnonzero((p > 0) & (p < 1))
    best = min((tuple(int(m >> i & 1) for i in range(len(at))) for m in range(1 << len(at))), key=lambda x: (abs(sum((v - p[i]) * size[i] for v, i in zip(x, at, strict=True))), abs(sum(v - p[i] for v, i in zip(x, at, strict=True))), x))
    out = p.copy()
    out[at] = best
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target: shares by weight, held at `most` times a source's size, the excess shared again."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weighed = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("cap") / F.col("w"))
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    lam = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    weighed = weighed.withColumn("lam", lam)
    lam = F.min(F.when(F.col("lam") <= F.col("level"), F.struct(F.col("level"), F.col("lam")))).over(Window.partitionBy())["lam"]
    target = F.least(F.col("cap"), F.coalesce(lam, F.lit(float("inf"))) * F.col("w"))
    return weighed.withColumn("target", target).select("source", "source_size", "n_docs", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 20240229, block: int = BLOCK) -> DataFrame:
    """doc_id, part (tells apart rows of one id), source, size, source_size, target, copies, taken for every row of docs.

    Null texts have size 0; sizes of 0 are taken 0 times. A null source is a source, the last. Equal rows may get
    different numbers of copies; reruns agree. An empty table gives no rows. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    common.tuned(spark)
    scratch = common.Scratch(spark, "mix")
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("part"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"))
    sizes = scratch.keep(sizes, "sizes")
    goals = scratch.keep(targets(sizes, weights, share, most), "targets")
    if goals.count() <= MOST_SOURCES:
        goals = F.broadcast(goals)
    rows = sizes.join(goals, sizes.source.eqNullSafe(goals.source), "left").drop(goals.source)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + F.lit(_EPS))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, whole).otherwise(0).cast("int"))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.greatest(ratio - whole, F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("dice", F.xxhash64(F.lit(seed), "doc_id", "part"))
    rows = rows.withColumn("blocks", F.ceil(F.col("n_docs") / block)).withColumn("block", F.pmod(F.col("dice"), F.col("blocks")))
    order = ["size", "dice", "doc_id", "part"]

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=[False, True, True, True], kind="stable", ignore_index=True)  # large ones first: small ones are left to land
        rng = np.random.default_rng([seed, int(pdf["dice"].iloc[0]) & 0xFFFFFFFF, len(pdf)])
        p, size = pdf["p"].to_numpy(), pdf["size"].to_numpy().astype(float)
        p = flight(p, size, rng)
        pdf["p"] = land(p, size) if int(pdf["blocks"].iloc[0]) == 1 else p
        return pdf

    done: list[DataFrame] = [rows.where(F.col("p") <= _EPS).withColumn("p", F.lit(0.0))]
    left = rows.where(F.col("p") > _EPS)
    most_blocks = goals.agg(F.max(F.ceil(F.col("n_docs") / block))).first()[0] or 1
    while True:
        flown = left.groupBy("source", "block").applyInPandas(fly, left.schema)
        flown = scratch.keep(flown, "flown")
        whole_ones = (F.col("p") == 0) | (F.col("p") == 1)
        done.append(flown.where(whole_ones))
        if most_blocks <= 1:
            break
        left = flown.where(~whole_ones).withColumn("blocks", F.ceil(F.col("blocks") / (block // 2))).withColumn("block", F.pmod(F.col("block"), F.col("blocks")))
        most_blocks = -(-most_blocks // (block // 2))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("copies") + F.col("p").cast("int")).cast("int")
    return out.select("doc_id", "part", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, **rules) -> DataFrame:
    """Rows of docs as often as the mix takes them. Copies of rows of one id and text are shared out among these, in an order by their other columns."""
    part, n, copies, rows, each = common.fresh(docs, "part", "n", "copies", "rows", "each")
    mixed = mix(docs, **rules).groupBy("doc_id", "part").agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
    mixed = mixed.select(F.col("doc_id").alias(each), F.col("part").alias(part), copies, rows)
    own = docs.join(mixed, docs["doc_id"].cast("long").eqNullSafe(mixed[each]) & (F.xxhash64(docs["text"]) == mixed[part])).drop(each)
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    one = own.where(F.col(rows) == 1).withColumn(n, F.lit(1))
    several = own.where(F.col(rows) > 1).withColumn(n, F.row_number().over(Window.partitionBy("doc_id", part).orderBy(F.xxhash64(others), others)))
    both = one.unionByName(several).withColumn(each, F.floor((F.col(copies) + F.col(rows) - F.col(n)) / F.col(rows)).cast("int"))
    taken = both.where(F.col(each) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(each))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
