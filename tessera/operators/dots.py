"""Dots: candidates per cell from pixels, gates as expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import kernels

KEY = ["tile_x", "tile_y", "cell_id"]


def red_gate(cfg: Config) -> Column:
    """The first gate that a red candidate fails, null if none."""
    return (
        F.when(~F.col("area").between(cfg.red_min_area, cfg.red_max_area), "area").when(F.col("circularity") < cfg.red_min_circ, "circularity").when(F.col("solidity") < cfg.red_min_solidity, "solidity")
        .when(F.col("ring").isNull(), "ring_empty").when(F.col("mean_a") - F.col("ring") < cfg.red_min_contrast, "contrast")
    )


def black_gate(cfg: Config) -> Column:
    """The first gate that a black candidate fails, null if none."""
    c = F.col
    contrast = c("ring") - c("mean_l")
    on = lambda limit, test: test if limit > 0 else F.lit(False)  # noqa: E731  a limit of 0 switches a gate off
    tinted = on(cfg.black_max_median_chroma, c("median_chroma") > cfg.black_max_median_chroma) | on(cfg.black_max_p90_chroma, c("p90_chroma") > cfg.black_max_p90_chroma) | on(cfg.black_max_chroma, c("chroma") > cfg.black_max_chroma)
    return (
        F.when(~c("area").between(cfg.black_min_area, cfg.black_max_area), "area").when(on(cfg.black_max_radius, c("radius") > cfg.black_max_radius), "radius").when(c("circularity") < cfg.black_min_circ, "circularity")
        .when(c("solidity") < cfg.black_min_solidity, "solidity").when(on(cfg.black_p20_l_max, c("p20_l") > cfg.black_p20_l_max), "p20_l").when(c("ring").isNull(), "ring_empty").when(contrast < cfg.black_min_contrast, "contrast")
        .when(c("ring") < cfg.black_min_ring_l, "ring_l").when(tinted & (c("mean_l") > cfg.black_very_dark_l), "chroma+bright").when(tinted & (contrast < cfg.black_very_dark_contrast), "chroma+lowcontrast")
    )


def gated(candidates: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Candidates with the gate they fail."""
    return candidates.withColumn("gate", F.when(F.col("dot_type") == "cep17", red_gate(cfg)).otherwise(black_gate(cfg)))


def accepted(candidates: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Dots that pass all gates."""
    return gated(candidates, cfg).where("gate IS NULL").select(*KEY, "dot_type", "y", "x", "radius", "area", "solidity", "score")


def detect(patches: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Candidates of each cell, in tile coordinates. patches: tile_x, tile_y, cell_id, y0, x0, height, width, rgb and nucleus as binary.

    One row a cell, so Arrow batches hold small patches only; nothing is shuffled. Candidates follow from a patch's content,
    so those of equal patches of a batch are found once.
    """
    schema = "tile_x long, tile_y long, cell_id long, " + kernels.CANDIDATE
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            unlike: dict[tuple, int] = {}
            which = np.array([unlike.setdefault(p, len(unlike)) for p in zip(pdf["height"], pdf["width"], pdf["rgb"], pdf["nucleus"], strict=True)], int)
            patches = [(np.frombuffer(rgb, np.uint8).reshape(h, w, 3), np.frombuffer(own, np.uint8).reshape(h, w) > 0) for h, w, rgb, own in unlike]
            found = kernels.candidates_of(patches, cfg)
            rows = pd.DataFrame([r for own in found for r in own], columns=names[len(KEY) :])
            size = np.array([len(own) for own in found], int)
            n = size[which]
            out = rows.take(np.repeat((size.cumsum() - size)[which] - (n.cumsum() - n), n) + np.arange(n.sum())).reset_index(drop=True)
            cell = {c: np.repeat(pdf[c].to_numpy(), n) for c in (*KEY, "y0", "x0")}
            out = out.assign(**{c: cell[c] for c in KEY}, y=out["y"] + cell["y0"], x=out["x"] + cell["x0"])[names]
            out["ring"] = out["ring"].astype(object).where(out["ring"].notna(), None)
            yield out

    return patches.select("tile_x", "tile_y", "cell_id", "y0", "x0", "height", "width", "rgb", "nucleus").mapInPandas(run, schema)
