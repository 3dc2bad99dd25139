"""From paired tiles to the case report (survey 3.4 b-i).

A tile goes through the core mask, and background tiles leave before any segmenter sees them; the others are masked and
fused, cells are found on the fused image and nuclei on the second slide, cells at the slide's edge go, enlarged cells
are matched with nuclei, and dots are counted in the nuclei that a cell won.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Config
from .functions import kernels
from .operators import cells as C
from .operators import dots, grid, matching, spatial
from .sources import images

KEY = ["tile_x", "tile_y"]
#: Pixels, from whole tiles, that make a batch of rows.
ROWS = 1 << 16


def segmented(tiles: DataFrame, segmenter: Callable[[], Callable[[np.ndarray], np.ndarray]], cfg: Config = Config()) -> DataFrame:
    """Label planes of tiles (K9), the segmenter made once a task (F1 F3). tiles: x, y, height, width, data. Adds labels (int32)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = segmenter()
        for pdf in batches:
            out = [kernels.segment_windows(np.frombuffer(d, np.uint8).reshape(h, w, 3), predict, cfg.tile_size, cfg.overlap, cfg.window_iomin).astype(np.int32).tobytes() for h, w, d in zip(pdf["height"], pdf["width"], pdf["data"], strict=True)]
            yield pdf.assign(labels=out)[["x", "y", "height", "width", "labels"]]

    return tiles.select("x", "y", "height", "width", "data").mapInPandas(run, "x long, y long, height int, width int, labels binary")


def core_masks(ihc: DataFrame, core: Callable[[], Callable[[np.ndarray], np.ndarray]], cfg: Config = Config()) -> DataFrame:
    """Core masks of the first slide's tiles (K1 K2): x, y, height, width, core, core_px. core makes a predictor of window batches, once a task.

    Windows have the side of a tile, 1024 at most, so that none is filled up for the most part.
    """
    masks = images.predict_masks(ihc, core, side=min(1024, cfg.tile_size), batch=cfg.batch_size, finish=lambda m: kernels.clean_core(m, cfg.close_kernel, cfg.min_fragment))
    return masks.withColumnsRenamed({"mask": "core", "mask_px": "core_px"})


def overlays(ihc: DataFrame, dish: DataFrame, cores: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The image that cells are found on (K3-K6): both slides masked by the core and fused. Only tiles of `cores` are read: x, y, height, width, data."""
    side = lambda t, c: t.select("x", "y", F.col("data").alias(c)).hint("merge")  # noqa: E731  plain tiles pack so small that Spark would broadcast them
    df = cores.select("x", "y", "height", "width", "core").join(side(ihc, "ihc"), ["x", "y"]).join(side(dish, "dish"), ["x", "y"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                core = np.frombuffer(t.core, np.uint8).reshape(t.height, t.width)
                first, second = (kernels.masked(np.frombuffer(d, np.uint8).reshape(t.height, t.width, 3), core, cfg.background_fill, cfg.mask_blur_sigma) for d in (t.ihc, t.dish))
                out.append(kernels.fused(second, first, cfg.overlay_alpha).tobytes())
            yield pdf.assign(data=out)[["x", "y", "height", "width", "data"]]

    return df.mapInPandas(run, images.TILE)


def cell_planes(planes: DataFrame, flags: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Label planes of cells without those at the slide's edge (P6), and the planes they're matched on, with cells enlarged (K11): adds matching.

    flags: x, y, edge_top, edge_bottom, edge_left, edge_right of the tiles.
    """
    df = planes.join(flags.select("x", "y", "edge_top", "edge_bottom", "edge_left", "edge_right").hint("merge"), ["x", "y"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            labels, grown = [], []
            for t in pdf.itertuples(index=False):
                a = np.frombuffer(t.labels, np.int32).reshape(t.height, t.width)
                if cfg.clear_border_cells:
                    a = kernels.without_edges(a, t.edge_top, t.edge_bottom, t.edge_left, t.edge_right)
                labels.append(a.tobytes())
                grown.append(kernels.enlarged(a, cfg.enlarge_area_factor).tobytes())
            yield pdf.assign(labels=labels, matching=grown)[["x", "y", "height", "width", "labels", "matching"]]

    return df.mapInPandas(run, "x long, y long, height int, width int, labels binary, matching binary")


def label_pixels(planes: DataFrame, labels: str = "labels", core: str | None = None) -> DataFrame:
    """Labelled pixels in long form, background left out: tile_x, tile_y, y, x, label, and core (0 or 1) where its column is named."""
    extra = [core] if core else []

    names = ["tile_x", "tile_y", "y", "x", "label", *(["core"] if core else [])]

    def pixels(t: dict) -> tuple[np.ndarray, ...]:
        shape = int(t["height"]), int(t["width"])
        a = np.frombuffer(t[labels], np.int32).reshape(shape)
        y, x = np.nonzero(a)
        out = np.full(len(y), t["x"], np.int64), np.full(len(y), t["y"], np.int64), y.astype(np.int32), x.astype(np.int32), a[y, x].astype(np.int64)
        return (*out, (np.frombuffer(t[core], np.uint8).reshape(shape)[y, x] > 0).astype(np.int32)) if core else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts, n = [], 0
            for t in pdf.to_dict("records"):
                parts.append(pixels(t))
                n += len(parts[-1][0])
                if n >= ROWS:
                    yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True)))
                    parts, n = [], 0
            if n:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    return planes.select("x", "y", "height", "width", labels, *extra).mapInPandas(run, "tile_x long, tile_y long, y int, x int, label long" + (", core int" if core else ""))


def match(cell_pixels: DataFrame, nucleus_pixels: DataFrame, cfg: Config = Config(), widest: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Instances of cells and nuclei, candidates and one-to-one matches, each made once. widest: as in matching.reach_pairs."""
    from .session import checkpointed

    ihc, dish = checkpointed(C.region_props(cell_pixels)), checkpointed(C.region_props(nucleus_pixels))
    reach = matching.with_reach(ihc, cfg.elastic_expand_factor, cfg.elastic_min_reach)
    pairs = matching.candidates(matching.overlap_pairs(cell_pixels, nucleus_pixels), matching.reach_pairs(reach, dish, widest), ihc, dish)
    pairs = checkpointed(pairs)
    return ihc, dish, pairs, checkpointed(matching.greedy(pairs))


def patches(dish: DataFrame, planes: DataFrame, matches: DataFrame, pad: int = 2, cores: DataFrame | None = None, cfg: Config = Config()) -> DataFrame:
    """The patch of each matched cell (K12 K13): the box of its nuclei in the DISH tile, and which pixels are its own.

    With cores (x, y, core) the tile is masked first. A tile's matches travel with it as one array, bounded by the tile.
    """
    own = matches.groupBy(*KEY).agg(F.collect_list(F.struct("cell_id", "dish_id")).alias("pairs"))
    df = dish.select(F.col("x").alias("tile_x"), F.col("y").alias("tile_y"), "height", "width", "data").join(planes.select(F.col("x").alias("tile_x"), F.col("y").alias("tile_y"), "labels").hint("merge"), KEY).join(own.hint("merge"), KEY)
    none = F.lit(None).cast("binary")
    df = df.withColumn("core", none) if cores is None else df.join(cores.select(F.col("x").alias("tile_x"), F.col("y").alias("tile_y"), "core").hint("merge"), KEY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                rgb = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, 3)
                if t.core is not None:
                    rgb = kernels.masked(rgb, np.frombuffer(t.core, np.uint8).reshape(t.height, t.width), cfg.background_fill, cfg.mask_blur_sigma)
                labels = np.frombuffer(t.labels, np.int32).reshape(t.height, t.width)
                owner = np.zeros(int(labels.max(initial=0)) + 1, np.int64)
                for p in t.pairs:
                    owner[p["dish_id"]] = p["cell_id"]
                cells, rows = owner[labels], []
                for c in np.unique(cells[cells > 0]):
                    y, x = np.nonzero(cells == c)
                    y0, x0 = max(0, int(y.min()) - pad), max(0, int(x.min()) - pad)
                    box = (slice(y0, int(y.max()) + pad + 1), slice(x0, int(x.max()) + pad + 1))
                    part = np.ascontiguousarray(rgb[box])
                    rows.append((t.tile_x, t.tile_y, int(c), y0, x0, *part.shape[:2], part.tobytes(), (cells[box] == c).astype(np.uint8).tobytes()))
                yield pd.DataFrame(rows, columns=["tile_x", "tile_y", "cell_id", "y0", "x0", "height", "width", "rgb", "nucleus"])

    return df.mapInPandas(run, "tile_x long, tile_y long, cell_id long, y0 int, x0 int, height int, width int, rgb binary, nucleus binary")


def merged_dots(candidates: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Accepted dots, near ones of a cell as one; of equals the first as found."""
    found = dots.gated(candidates, cfg).where("gate IS NULL").select(*KEY, "cell_id", "dot_type", "y", "x", "radius", "area", "solidity", "score", F.col("blob").alias("dot_id"))
    return spatial.merge_dots(found, {"her2": cfg.black_merge, "cep17": cfg.red_merge})


def facts(ihc: DataFrame, pairs: DataFrame, matches: DataFrame, candidates: DataFrame, cfg: Config = Config(), out_of_bounds: DataFrame | None = None) -> DataFrame:
    """The cell table: dots merged, counted per cell, and finalized (M3)."""
    return cell_table(ihc, pairs, matches, merged_dots(candidates, cfg), cfg, out_of_bounds)


def cell_table(ihc: DataFrame, pairs: DataFrame, matches: DataFrame, found: DataFrame, cfg: Config = Config(), out_of_bounds: DataFrame | None = None) -> DataFrame:
    """facts() from dots that are merged already."""
    nuclei = matches.groupBy(*KEY, "cell_id").agg(F.count("*").alias("n_nuclei"))
    lost = matching.drop_outs(pairs, matches).withColumn("drop_out", F.lit(True))
    df = ihc.select(*KEY, F.col("id").alias("cell_id"), F.col("cx").alias("centroid_x"), F.col("cy").alias("centroid_y"), F.lit(True).alias("is_her2_positive"))
    df = df.join(C.dot_counts(found), [*KEY, "cell_id"], "left").join(nuclei, [*KEY, "cell_id"], "left").join(lost, [*KEY, "cell_id"], "left")
    if out_of_bounds is not None:
        df = df.join(out_of_bounds.select(*KEY, "cell_id", F.lit(True).alias("out_of_bounds")), [*KEY, "cell_id"], "left")
    else:
        df = df.withColumn("out_of_bounds", F.lit(False))
    df = df.fillna(0, ["her2_dot_count", "cep17_dot_count", "n_nuclei"]).fillna(False, ["drop_out", "out_of_bounds"]).withColumn("blue_region_count", F.col("n_nuclei").cast("int"))
    return C.finalize(df, cfg)


def case_cells(tile_cells: DataFrame, tiles: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Tile-local cells to the case's: owned by a core, without ghosts, numbered 1..N."""
    return spatial.renumber(spatial.dedup_ghosts(grid.owned(tile_cells, tiles), cfg.ghost_distance))


@dataclass(frozen=True)
class TileFacts:
    """What a case's tiles give: tile-local cells, all dots, and what they came from."""

    cells: DataFrame
    dots: DataFrame
    cores: DataFrame
    planes: DataFrame
    nuclei: DataFrame
    matches: DataFrame


def tile_facts(ihc: DataFrame, dish: DataFrame, segmenter: Callable[[], Callable[[np.ndarray], np.ndarray]], cfg: Config = Config(), core: Callable[[], Callable[[np.ndarray], np.ndarray]] = kernels.whole_core, nucleus_segmenter: Callable | None = None, flags: DataFrame | None = None) -> TileFacts:
    """Facts of paired tiles (M1 M2 M3), off-population cells and their dots included (O1 O2).

    core: a predictor of tissue, by default all is tissue; tiles without any give no rows, and no segmenter runs on them
    (P5). nucleus_segmenter: another segmenter for the second slide. flags: edge flags of the tiles, by default from
    their grid. Cells that only touch nuclei outside the core are out of bounds (P8 P9); dots are counted on the masked
    second slide, those of the off-population on the slide itself.
    """
    from .session import checkpointed

    if flags is None:
        flags = grid.geometry(ihc.select("x", "y"), cfg.tile_size, cfg.overlap)
    cores = checkpointed(core_masks(ihc, core, cfg).where("core_px > 0"))  # models run once
    planes = checkpointed(cell_planes(segmented(overlays(ihc, dish, cores, cfg), segmenter, cfg), flags, cfg))
    seen = dish.join(cores.select("x", "y"), ["x", "y"], "left_semi")
    nuclei = checkpointed(segmented(seen, nucleus_segmenter or segmenter, cfg))
    cell_pixels, core_pixels = label_pixels(planes, "matching"), label_pixels(nuclei.join(cores.select("x", "y", "core").hint("merge"), ["x", "y"]), core="core")
    _, stains, pairs, matches = match(cell_pixels, core_pixels, cfg)
    dropped = C.inside_core(core_pixels, cfg.core_min_inside).where("NOT kept").select(*KEY, F.col("label").alias("dish_id"))
    cells = C.region_props(label_pixels(planes))
    outside = C.out_of_bounds(cells.select(*KEY, F.col("id").alias("cell_id")), pairs.where("reach_only = 0"), dropped)
    # merging reads candidates many times, and cells and dots both need what it gives
    merged = lambda p: checkpointed(merged_dots(checkpointed(dots.detect(p, cfg)), cfg))
    found = merged(patches(dish, nuclei, matches, cores=cores, cfg=cfg))
    own = checkpointed(cell_table(cells, pairs, matches, found, cfg, outside))
    lone = C.off_population(stains, matches, own)
    most = own.groupBy(*KEY).agg(F.max("cell_id").alias("most"))
    alone = lone.join(most, KEY, "left").select(*KEY, "cell_id", (F.col("cell_id") - F.coalesce("most", F.lit(0))).alias("dish_id"))
    others = merged(patches(dish, nuclei, alone))
    off = lone.join(C.dot_counts(others), [*KEY, "cell_id"], "left").fillna(0, ["her2_dot_count", "cep17_dot_count"])
    off = C.finalize(off.withColumns({"n_nuclei": F.lit(1), "drop_out": F.lit(False), "out_of_bounds": F.lit(False), "blue_region_count": F.lit(1)}), cfg)
    return TileFacts(own.unionByName(off), all_dots(found, others), cores, planes, nuclei, matches)


def all_dots(own: DataFrame, others: DataFrame) -> DataFrame:
    """Dots of matched cells and of the off-population as one table (O2)."""
    return own.withColumn("off_population", F.lit(False)).unionByName(others.withColumn("off_population", F.lit(True)))


def tile_cells(ihc: DataFrame, dish: DataFrame, segmenter: Callable[[], Callable[[np.ndarray], np.ndarray]], cfg: Config = Config(), **options) -> DataFrame:
    """The cells of tile_facts()."""
    return tile_facts(ihc, dish, segmenter, cfg, **options).cells


def run(ihc: DataFrame, dish: DataFrame, output: str, segmenter: Callable[[], Callable[[np.ndarray], np.ndarray]], cfg: Config = Config(), resume: bool = False, core: Callable[[], Callable[[np.ndarray], np.ndarray]] = kernels.whole_core, nucleus_segmenter: Callable | None = None) -> DataFrame:
    """A case from two sets of tiles (x, y, height, width, data) to its report and summary below `output`; returns the case's cells.

    With resume, tiles stored under this configuration aren't done again. core, nucleus_segmenter: as in tile_facts().
    """
    from .operators import summary
    from .schemas import CELLS
    from .streaming import incremental

    spark = ihc.sparkSession
    tiles = ihc.select("x", "y").join(dish.select("x", "y"), ["x", "y"], "left_semi")
    plan = grid.geometry(tiles, cfg.tile_size, cfg.overlap)
    names = [c.split()[0] for c in CELLS.split(", ")]

    def process(todo: DataFrame) -> DataFrame:
        pick = lambda t: t.join(todo, ["x", "y"], "left_semi")
        return tile_cells(pick(ihc), pick(dish), segmenter, cfg, core=core, nucleus_segmenter=nucleus_segmenter, flags=plan).select(*names)

    if resume:
        local = incremental.resume(spark, tiles, process, f"{output}/tiles", cfg.fingerprint(), CELLS.replace("tile_x long, tile_y long, ", ""))
    else:
        local = process(tiles)
    out = case_cells(local, plan, cfg)
    out.write.mode("overwrite").parquet(f"{output}/cells")
    out = spark.read.parquet(f"{output}/cells")
    summary.write_report(out, f"{output}/report")
    spark.createDataFrame([(line,) for line in summary.summary_text(out, cfg).split("\n")], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/summary")
    return out
