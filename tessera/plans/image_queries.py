"""Registered queries over images, label planes and instances that are painted from rows of the given tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import pipeline
from ..config import Config
from ..functions import kernels
from ..operators import cells as C
from ..functions import pixels as P
from ..operators import components, contours, instances, matching, pairing
from ..sources import images
from . import adapters as D
from .adapters import view
from .queries import pixels, query

_PX = f"px AS ({D.PIXELS_DUCK})"
SIDE = 64
#: Side of the tissue square by the row's number; a square of 20 has fewer pixels than a fragment must.
_TISSUE = (0, 20, 30, 40)
_AT = ((3, 3), (3, 17), (17, 3), (17, 17))


def painted(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both slides' tiles of 64 x 64 pixels, one a row: x is 64 times the key. Tissue of a side by the key, up to four cells in it, a nucleus in every other one, and one outside the tissue."""

    def paint(k: int) -> tuple[np.ndarray, np.ndarray]:
        ihc, dish = np.full((SIDE, SIDE, 3), 255, np.uint8), np.full((SIDE, SIDE, 3), 255, np.uint8)
        y, x, s = 4 + k % 5, 4 + k % 7, _TISSUE[k % 4]  # closing fills gaps to the edge of fewer pixels
        ihc[y : y + s, x : x + s] = (200, 170, 140)
        dish[y : y + s, x : x + s] = (200, 180, 180)
        for i, (dy, dx) in enumerate(_AT[: 1 + k % 3] if s > 20 else ()):
            ihc[y + dy : y + dy + 8, x + dx : x + dx + 8] = (90, 60, 40)
            if (k + i) % 2 == 0:
                dish[y + dy + 1 : y + dy + 7, x + dx + 1 : x + dx + 7] = (120, 120, 160)
        dish[54:60, 54:60] = (120, 120, 160)
        return ihc, dish

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (pdf["k"].iloc[i : i + 256] for pdf in batches for i in range(0, len(pdf), 256)):  # 24 kB a tile and slide
            both = [paint(int(k)) for k in part]
            yield pd.DataFrame({"x": part * SIDE, "y": 0, "height": SIDE, "width": SIDE, "ihc": [a.tobytes() for a, _ in both], "dish": [b.tobytes() for _, b in both]})

    k = rows.select(F.col(key).cast("long").alias("k"))
    made = k.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k").mapInPandas(run, "x long, y long, height int, width int, ihc binary, dish binary")
    return tuple(made.select("x", "y", "height", "width", F.col(c).alias("data")) for c in ("ihc", "dish"))


def brown_core():
    """Tissue is what is darker than the slide's background and browner than blue."""
    return lambda windows: ((windows[..., 2] < 200) & (windows[..., 0] > windows[..., 2])).astype(np.uint8)


def dark_cells():
    return kernels.threshold_segmenter(0.8, 20)


def stained_nuclei():
    return kernels.threshold_segmenter(0.5, 20)


CASE = Config(tile_size=SIDE, overlap=0)
_PAINT = "k AS (SELECT CAST(s_suppkey AS BIGINT) AS k, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 20 WHEN 2 THEN 30 ELSE 40 END AS s, 1 + s_suppkey % 3 AS c FROM supplier), live AS (SELECT * FROM k WHERE s * s >= 550)"


def _case(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ihc, dish = painted(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey")
    alone = {f"edge_{c}": F.lit(True) for c in ("top", "bottom", "left", "right")}
    return ihc, dish, ihc.select("x", "y").withColumns(alone)


@query(f"""WITH {_PAINT}, v AS (SELECT *, floor(CAST(200 AS FLOAT) * CAST(0.35 AS FLOAT) + CAST(200 AS FLOAT) * CAST(0.65 AS FLOAT)) AS r FROM k)
SELECT k * 64 AS x, CASE WHEN s * s >= 550 THEN s * s ELSE 0 END AS core_px, s * s < 550 AS background, CASE WHEN s * s >= 550 THEN c ELSE 0 END AS n_cells, CASE WHEN s * s >= 550 THEN 64 * c ELSE 0 END AS cell_px FROM v""")
def core_mask_case(spark, sf_dir):
    """Core pixels of every tile, and the cells found on the fused image of those that have any."""
    ihc, dish, flags = _case(spark, sf_dir)
    cores = pipeline.core_masks(ihc, brown_core, CASE)
    live = cores.where("core_px > 0")
    planes = pipeline.cell_planes(pipeline.segmented(pipeline.overlays(ihc, dish, live, CASE), dark_cells, CASE), flags, CASE)
    found = C.region_props(pipeline.label_pixels(planes)).groupBy(F.col("tile_x").alias("x")).agg(F.count("*").alias("n_cells"), F.sum("area").alias("cell_px"))
    out = cores.select("x", "core_px", (F.col("core_px") == 0).alias("background")).join(found, "x", "left")
    return out.select("x", "core_px", "background", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), F.coalesce("cell_px", F.lit(0)).alias("cell_px"))


@query(f"""WITH {_PAINT}, own AS (SELECT k, i, (k + i) % 2 = 0 AS nucleus FROM live, unnest(range(0, 4)) AS u(i) WHERE i < c),
r AS (SELECT *, count_if(nucleus) OVER (PARTITION BY k) AS others FROM own)
SELECT k * 64 AS tile_x, true AS is_her2_positive, CASE WHEN nucleus THEN 1 ELSE 0 END AS n_nuclei, CASE WHEN NOT nucleus AND others > 0 THEN 'drop_out' ELSE '' END AS exclusion_reason, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY ALL
UNION ALL SELECT k * 64, false, 1, '', 1 FROM live""")
def painted_case(spark, sf_dir):
    """Cells of a whole case by what became of them: a cell with a nucleus of its own, one that lost all in reach to others, and the nucleus outside the tissue."""
    ihc, dish, flags = _case(spark, sf_dir)
    found = pipeline.tile_cells(ihc, dish, dark_cells, CASE, core=brown_core, nucleus_segmenter=stained_nuclei, flags=flags)
    return found.groupBy("tile_x", "is_her2_positive", F.col("n_nuclei").cast("int").alias("n_nuclei"), "exclusion_reason").agg(F.count("*").alias("n"))


def planes_of(px: DataFrame, height: int, width: int) -> DataFrame:
    """Label planes from long-form pixels: x, y, height, width, labels. A tile's pixels are one group, bounded by the tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cells in pdf["cells"]:
                a = np.zeros((height, width), np.int32)
                for p in cells:
                    a[p["y"], p["x"]] = p["label"]
                out.append(a.tobytes())
            yield pdf.assign(height=height, width=width, labels=out)[["x", "y", "height", "width", "labels"]]

    own = px.groupBy(F.col("tile_x").alias("x"), F.col("tile_y").alias("y")).agg(F.collect_list(F.struct("y", "x", F.col("label").cast("int").alias("label"))).alias("cells"))
    return own.mapInPandas(run, "x long, y long, height int, width int, labels binary")


@query(f"""WITH {_PX}, few AS (SELECT tile_x, y, x, CASE WHEN v > 0.12 THEN label ELSE 0 END AS label FROM px), own AS (SELECT * FROM few WHERE label > 0),
reach AS (SELECT tile_x, median(sqrt(n / pi())) * (sqrt(CAST(6 AS DOUBLE)) - 1) AS d FROM (SELECT tile_x, label, count(*) AS n FROM own GROUP BY ALL) a GROUP BY tile_x),
near AS (SELECT f.tile_x, f.y, f.x, o.label, (f.y - o.y) * (f.y - o.y) + (f.x - o.x) * (f.x - o.x) AS d2 FROM few f JOIN own o USING (tile_x)),
least AS (SELECT tile_x, y, x, min(d2) AS d2 FROM near GROUP BY ALL)
SELECT n.tile_x, n.y, n.x, min(n.label) AS label FROM near n JOIN least USING (tile_x, y, x, d2) JOIN reach r ON r.tile_x = n.tile_x AND sqrt(n.d2) <= r.d GROUP BY ALL""")
def enlarged_labels(spark, sf_dir):
    """Label planes of the embeddings with every label grown to six times the typical area."""
    px = pixels(spark, sf_dir).withColumn("label", F.when(F.col("v") > 0.12, F.col("label")).otherwise(0))
    planes = planes_of(px, 8, 8)
    flags = planes.select("x", "y").withColumns({f"edge_{c}": F.lit(False) for c in ("top", "bottom", "left", "right")})
    grown = pipeline.cell_planes(planes, flags, Config(enlarge_area_factor=6.0, clear_border_cells=False))
    return pipeline.label_pixels(grown, "matching").select("tile_x", "y", "x", "label")


#: Instances of 97 tiles, a rectangle with holes an event.
_INSTANCES = """SELECT CAST(user_id % 97 AS BIGINT) AS tile_x, event_id AS id, CAST(event_id * 37 % 600 AS INT) AS y0, CAST((event_id * 91 + user_id) % 600 AS INT) AS x0, CAST(8 + event_id % 23 AS INT) AS h, CAST(8 + user_id % 29 AS INT) AS w FROM {events}"""
_PAIRS = f"""e AS ({_INSTANCES}), p AS (SELECT tile_x, id, y0 + a AS y, x0 + b AS x FROM (SELECT *, unnest(range(0, w)) AS b FROM (SELECT *, unnest(range(0, h)) AS a FROM e) q) r WHERE ((a * w + b) * 7 + id) % 5 <> 0),
n AS (SELECT tile_x, id, count(*) AS area FROM p GROUP BY ALL),
pairs AS (SELECT a.tile_x, a.id AS hi, b.id AS lo, CAST(count(*) AS BIGINT) AS pixels FROM p a JOIN p b ON a.tile_x = b.tile_x AND a.y = b.y AND a.x = b.x AND a.id <> b.id JOIN n s ON s.tile_x = a.tile_x AND s.id = a.id JOIN n t ON t.tile_x = b.tile_x AND t.id = b.id
  WHERE s.area > t.area OR (s.area = t.area AND a.id < b.id) GROUP BY a.tile_x, a.id, b.id, t.area HAVING count(*) >= 0.25 * t.area)"""


def painted_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            area, data = [], []
            for i, h, w in zip(pdf["id"], pdf["h"], pdf["w"], strict=True):
                bits = (np.arange(h * w) * 7 + i) % 5 != 0
                area.append(int(bits.sum()))
                data.append(np.packbits(bits).tobytes())
            yield pdf.assign(tile_y=0, area=area, bits=data)[["tile_x", "tile_y", "id", "area", "y0", "x0", "h", "w", "bits"]]

    return view(spark, sf_dir, _INSTANCES).mapInPandas(run, instances.INSTANCE)


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def instance_pairs(spark, sf_dir):
    return instances.overlaps(painted_instances(spark, sf_dir), 0.25).drop("tile_y")


@query(f"""WITH RECURSIVE {_PAIRS}, o AS (SELECT tile_x, id, row_number() OVER (PARTITION BY tile_x ORDER BY area DESC, id) AS r FROM n),
t AS (SELECT o.tile_x, o.id, o.r, coalesce(list(p.hi) FILTER (WHERE p.hi IS NOT NULL), []) AS above FROM o LEFT JOIN pairs p ON p.tile_x = o.tile_x AND p.lo = o.id GROUP BY ALL),
g(tile_x, r, kept) AS (SELECT DISTINCT tile_x, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM o UNION ALL SELECT g.tile_x, t.r, CASE WHEN list_has_any(t.above, g.kept) THEN g.kept ELSE list_append(g.kept, t.id) END FROM g JOIN t ON t.tile_x = g.tile_x AND t.r = g.r + 1)
SELECT tile_x, unnest(kept) AS id FROM (SELECT tile_x, arg_max(kept, r) AS kept FROM g GROUP BY tile_x) z""")
def instance_suppression(spark, sf_dir):
    return instances.suppress(painted_instances(spark, sf_dir), 0.25).select("tile_x", "id")


@query("""WITH s AS (SELECT o_orderkey AS slide, 100 + o_custkey % 900 AS h, 50 + o_orderkey % 1500 AS w FROM orders)
SELECT slide, CAST(a * 512 AS BIGINT) AS y, CAST(b * 512 AS BIGINT) AS x, CAST(least(512, h - a * 512) AS BIGINT) AS h, CAST(least(512, w - b * 512) AS BIGINT) AS w
FROM (SELECT slide, h, w, a, unnest(range(0, CAST(ceil(w / 512.0) AS BIGINT))) AS b FROM (SELECT *, unnest(range(0, CAST(ceil(h / 512.0) AS BIGINT))) AS a FROM s) p) q""")
def window_list(spark, sf_dir):
    """The windows without overlap of images of any size, as predict_masks() deals them."""
    rows = view(spark, sf_dir, "SELECT o_orderkey AS slide, 100 + o_custkey % 900 AS h, 50 + o_orderkey % 1500 AS w FROM {orders}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(s, *window) for s, h, w in zip(pdf["slide"], pdf["h"], pdf["w"], strict=True) for window in images.window_list(h, w, 512)]
            yield pd.DataFrame(out, columns=["slide", "y", "x", "h", "w"])

    return rows.mapInPandas(run, "slide long, y long, x long, h long, w long")


@query(f"WITH {_PX} SELECT tile_x, tile_y, label AS cell_id, round(avg(x), 6) AS centroid_x, round(avg(y), 6) AS centroid_y, true AS is_her2_positive FROM px WHERE label > 0 GROUP BY tile_x, tile_y, label")
def seed_cells(spark, sf_dir):
    """A positive cell for every label."""
    found = C.seed_cells(pixels(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("centroid_x", "centroid_y")})


@query(f"""WITH f AS ({D.FACTS}), r AS (SELECT cell_id, her2_dot_count, blue_region_count, out_of_bounds AS excluded FROM f WHERE cell_id % 3 = 0)
SELECT f.cell_id, f.is_her2_positive, coalesce(r.her2_dot_count, 0) AS her2_dot_count, coalesce(r.blue_region_count, 0) AS blue_region_count, coalesce(r.excluded, false) AS excluded FROM f LEFT JOIN r USING (cell_id)""")
def enriched_cells(spark, sf_dir):
    """All cells with the results of those that have some."""
    cells = view(spark, sf_dir, D.FACTS)
    results = cells.where("cell_id % 3 = 0").select("cell_id", "her2_dot_count", "blue_region_count", F.col("out_of_bounds").alias("excluded"))
    return C.enrich(cells.select("cell_id", "is_her2_positive"), results, ["cell_id"])


_CLAIMS = f"m AS (SELECT tile_x, tile_y, min(cell_id) AS cell_id, dot_id % 400 AS dish_id FROM ({D.DOTS}) q WHERE dot_id % 3 > 0 GROUP BY tile_x, tile_y, dot_id % 400)"


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    dots = view(spark, sf_dir, D.DOTS).withColumn("dish_id", F.col("dot_id") % 400)
    return dots, dots.where("dot_id % 3 > 0").groupBy("tile_x", "tile_y", "dish_id").agg(F.min("cell_id").alias("cell_id"))


@query(f"WITH {_CLAIMS} SELECT d.tile_x, d.tile_y, d.dot_id, m.cell_id FROM ({D.DOTS}) d JOIN m ON m.tile_x = d.tile_x AND m.tile_y = d.tile_y AND m.dish_id = d.dot_id % 400")
def dot_owners(spark, sf_dir):
    """Dots of claimed nuclei with the cell that claimed them."""
    dots, claims = _claims(spark, sf_dir)
    return C.dot_owners(dots.drop("cell_id"), claims).select("tile_x", "tile_y", "dot_id", "cell_id")


@query(f"WITH {_CLAIMS} SELECT DISTINCT tile_x, tile_y, dish_id FROM m")
def matched_nuclei(spark, sf_dir):
    return matching.matched_nuclei(_claims(spark, sf_dir)[1])


@query(f"WITH {_PX} SELECT tile_x, y, x, CASE WHEN r >= g AND r >= b THEN 0 WHEN g >= b THEN 1 ELSE 2 END AS class FROM px")
def best_classes(spark, sf_dir):
    """The class of the largest of three scores a pixel, the first of equals."""
    return pixels(spark, sf_dir).select("tile_x", "y", "x", P.best_class(F.array("r", "g", "b")).alias("class"))


@query(f"WITH {_PX} SELECT tile_x, CAST(sum(g) AS BIGINT) AS r, CAST(sum(b) AS BIGINT) AS g, CAST(sum(r) AS BIGINT) AS b FROM px GROUP BY tile_x")
def modality_merge(spark, sf_dir):
    """Three planes as the channels of one image, summed up by tile."""
    merged = pixels(spark, sf_dir).select("tile_x", P.rgb_merge(F.col("g"), F.col("b"), F.col("r")).alias("m")).select("tile_x", "m.*")
    return merged.groupBy("tile_x").agg(*[F.sum(c).alias(c) for c in "rgb"])


@query("""SELECT CAST(p_partkey AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CASE WHEN p_partkey % 3 = 0 THEN p_name || '-overlay' ELSE p_name END AS data, p_partkey % 3 <> 0 AS blank FROM part""")
def blank_tiles(spark, sf_dir):
    """Every tile's overlay, or its raw crop where none was drawn."""
    raw = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.col("p_name").alias("data"))
    return pairing.with_blanks(raw, raw.where("x % 3 = 0").withColumn("data", F.concat("data", F.lit("-overlay"))), raw)


@query("SELECT p_partkey, row_number() OVER (ORDER BY md5('42-' || CAST(p_partkey AS VARCHAR))) <= floor((SELECT count(*) FROM part) * 0.2) AS validation FROM part")
def validation_split(spark, sf_dir):
    """A fifth of the parts, exactly, by a hash rank."""
    return pairing.split(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), F.col("p_partkey"), 0.2)


@query("SELECT p_partkey, CAST(c AS INT) AS copy FROM part, unnest(range(0, 4)) AS u(c)")
def augmented_rows(spark, sf_dir):
    """Each part as itself and three times more."""
    return pairing.augmented(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), 3)


#: Embeddings as tiles of 8 x 8 pixels, 25 in a row, of one slide; set pixels are those above a level.
_SET = f"{_PX}, q AS (SELECT CAST(tile_x // 25 * 8 + y AS INT) AS y, CAST(tile_x % 25 * 8 + x AS INT) AS x, v FROM px)"
_NEAR = "(VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) AS d(dy, dx)"


def slide_masks(spark: SparkSession, sf_dir: str, level: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = pdf["vec_id"]
            yield pd.DataFrame({"x": k % 25 * 8, "y": k // 25 * 8, "height": 8, "width": 8, "mask": [(np.asarray(e, float) > level).astype(np.uint8).tobytes() for e in pdf["embedding"]]})

    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").mapInPandas(run, "x long, y long, height int, width int, mask binary")


@query(f"""WITH RECURSIVE {_SET}, s AS (SELECT y, x, CAST(y AS BIGINT) * 200 + x AS p FROM q WHERE v > 0.15), e AS (SELECT a.p AS a, b.p AS b FROM s a, {_NEAR} JOIN s b ON b.y = a.y + dy AND b.x = a.x + dx),
r(p, c) AS (SELECT p, p FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.p)
SELECT c // 200 AS py, c % 200 AS px, CAST(count(*) AS BIGINT) AS area FROM (SELECT p, min(c) AS c FROM r GROUP BY p) z GROUP BY c""")
def slide_components(spark, sf_dir):
    """Components of the whole slide across the seams of its tiles."""
    return components.components(slide_masks(spark, sf_dir, 0.15))


@query(f"""WITH RECURSIVE {_SET}, s AS (SELECT y, x FROM q WHERE v <= -0.03), ends AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM q),
r(y, x) AS (SELECT s.y, s.x FROM s, ends WHERE s.y IN (y0, y1) OR s.x IN (x0, x1) UNION SELECT s.y, s.x FROM r, {_NEAR} JOIN s ON s.y = r.y + dy AND s.x = r.x + dx)
SELECT CAST(x - x % 8 AS BIGINT) AS x, CAST(y - y % 8 AS BIGINT) AS y, CAST(count_if(v <= -0.03 AND NOT EXISTS (SELECT 1 FROM r WHERE r.y = q.y AND r.x = q.x)) AS BIGINT) AS filled_px FROM q GROUP BY ALL""")
def slide_holes(spark, sf_dir):
    """Pixels by tile that filling the slide's holes sets."""
    return components.filled(slide_masks(spark, sf_dir, -0.03)).select("x", "y", "filled_px")


@query(f"""WITH {_PX}, s AS (SELECT tile_x, y, x, label FROM px WHERE label > 0)
SELECT a.tile_x, a.y, a.x, a.label FROM s a LEFT JOIN s b ON b.tile_x = a.tile_x AND b.label = a.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL HAVING count(b.x) < 4""")
def boundary_pixels(spark, sf_dir):
    """Outlines of the labels of the embeddings' planes."""
    return contours.boundary_pixels(pixels(spark, sf_dir).select("tile_x", "tile_y", "y", "x", "label")).drop("tile_y")


@query("SELECT n_nationkey AS id, n_name AS layer FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 3 = 0)")
def present_layers(spark, sf_dir):
    """Layers of which there is a slide."""
    layers = view(spark, sf_dir, "SELECT n_nationkey AS id, n_name AS layer FROM {nation}")
    return pairing.present(layers, view(spark, sf_dir, "SELECT s_nationkey AS id FROM {supplier} WHERE s_suppkey % 3 = 0"))


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 > 0)")
def foreign_keys(spark, sf_dir):
    """Keys that the list of allowed ones doesn't have."""
    return pairing.foreign(view(spark, sf_dir, "SELECT o_custkey AS k FROM {orders}"), view(spark, sf_dir, "SELECT c_custkey AS k FROM {customer} WHERE c_custkey % 5 > 0"), "k")


@query(f"""WITH {_PX}, b AS (SELECT tile_x, label, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, count(*) AS area FROM (SELECT * FROM px WHERE v > 0.16 AND label > 0) q GROUP BY ALL)
SELECT tile_x, row_number() OVER (PARTITION BY tile_x ORDER BY label) AS id, CAST(area AS BIGINT) AS area FROM b WHERE y0 > 0 AND x0 > 0 AND y1 < 8 AND x1 < 8""")
def inner_instances(spark, sf_dir):
    """Instances that touch no side of their tile, numbered anew."""
    return C.clear_border(C.region_props(pixels(spark, sf_dir).where("v > 0.16")), 8, 8).select("tile_x", "id", "area")
