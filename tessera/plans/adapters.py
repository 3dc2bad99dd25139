"""Tiles, cells, nuclei, dots and measurements derived from the test tables, for queries and their SQL.

Plain arithmetic that runs unchanged in Spark and DuckDB; {name} stands for a table. Not part of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AXIS = "(VALUES (0,0),(768,1),(1536,2),(2304,3),(2976,4)) AS axis(st, ix)"

#: One physical cell an event, absolute places.
FACTS = """
SELECT event_id AS cell_id, CAST((event_id * 7919) % 4000 AS DOUBLE) AS centroid_x, CAST((event_id * 104729 + user_id) % 4000 AS DOUBLE) AS centroid_y,
  event_type <> 'error' AS is_her2_positive, CAST(CASE WHEN user_id % 7 = 0 THEN 0 ELSE user_id % 13 END AS INT) AS her2_dot_count,
  CAST(CASE WHEN user_id % 7 = 0 THEN 0 ELSE (event_id * 13 + user_id) % 6 END AS INT) AS cep17_dot_count,
  CAST(CASE WHEN user_id % 7 = 0 THEN 0 ELSE 1 + event_id % 3 END AS INT) AS n_nuclei, CAST(CASE WHEN user_id % 7 = 0 THEN 0 ELSE 1 + event_id % 3 END AS INT) AS blue_region_count,
  user_id % 7 = 0 AND event_id % 2 = 0 AS drop_out, user_id % 7 = 0 AND event_id % 3 = 0 AS out_of_bounds
FROM {events}
"""

#: Detections: each cell in every tile that covers it, tile-local, with jitter.
DETECTIONS = f"""
SELECT t.x AS tile_x, t.y AS tile_y, p.cell_id, p.centroid_x + ((p.cell_id * 13 + t.c * 7 + t.r * 5) % 5 - 2) * CAST(0.75 AS DOUBLE) - t.x AS centroid_x,
  p.centroid_y + ((p.cell_id * 11 + t.c * 3 + t.r * 7) % 5 - 2) * CAST(0.75 AS DOUBLE) - t.y AS centroid_y,
  p.is_her2_positive, p.her2_dot_count, p.cep17_dot_count, p.blue_region_count, p.out_of_bounds AS excluded
FROM ({FACTS}) p JOIN (SELECT CAST(a.st AS BIGINT) AS x, CAST(b.st AS BIGINT) AS y, CAST(a.ix AS BIGINT) AS c, CAST(b.ix AS BIGINT) AS r
  FROM (SELECT * FROM {AXIS}) a CROSS JOIN (SELECT * FROM {AXIS}) b) t
ON p.centroid_x >= t.x AND p.centroid_x < t.x + 1024 AND p.centroid_y >= t.y AND p.centroid_y < t.y + 1024
"""

#: Cells and nuclei of 500 px blocks, tile-local: id, cy, cx, area.
IHC = """
SELECT gx - gx % 500 AS tile_x, gy - gy % 500 AS tile_y, id, CAST(gx % 500 AS DOUBLE) AS cx, CAST(gy % 500 AS DOUBLE) AS cy, area
FROM (SELECT event_id AS id, (event_id * 7919) % 4000 AS gx, (event_id * 104729 + user_id) % 4000 AS gy, 100 + user_id * 7 % 900 AS area FROM {events}) q
"""
DISH = """
SELECT gx - gx % 500 AS tile_x, gy - gy % 500 AS tile_y, id, CAST(gx % 500 AS DOUBLE) AS cx, CAST(gy % 500 AS DOUBLE) AS cy
FROM (SELECT o_orderkey AS id, (o_orderkey * 6151) % 4000 AS gx, (o_orderkey * 91193 + o_custkey) % 4000 AS gy FROM {orders}) q
"""

#: Dots of 50 cells a block: dot_id is their order.
DOTS = """
SELECT (event_id * 31) % 8 * 500 AS tile_x, (event_id * 17) % 8 * 500 AS tile_y, user_id % 50 AS cell_id, CASE WHEN event_id % 3 = 0 THEN 'cep17' ELSE 'her2' END AS dot_type, event_id AS dot_id,
  CAST((event_id * 7919) % 40 AS DOUBLE) / 2 AS y, CAST((event_id * 104729) % 40 AS DOUBLE) / 2 AS x, CAST(1 + event_id % 5 AS DOUBLE) AS radius, CAST(3 + event_id % 40 AS INT) AS area,
  CAST(0.5 + (event_id % 10) / 20.0 AS DOUBLE) AS solidity, CAST((event_id * 37) % 101 AS DOUBLE) AS score
FROM {events}
"""

#: Candidate blobs with all that the gates look at.
BLOBS = """
SELECT CAST(user_id AS BIGINT) AS tile_x, CAST(0 AS BIGINT) AS tile_y, event_id AS cell_id, CAST(event_id % 300 AS INT) AS area, CAST((event_id * 7) % 120 AS DOUBLE) / 10 AS radius,
  CAST((event_id * 11) % 140 AS DOUBLE) / 100 AS circularity, CAST((event_id * 13) % 101 AS DOUBLE) / 100 AS solidity, CAST((event_id * 17) % 70 AS DOUBLE) AS mean_l,
  CAST((event_id * 19) % 60 AS DOUBLE) AS mean_a, CAST((event_id * 23) % 60 AS DOUBLE) AS p20_l, CAST((event_id * 29) % 40 AS DOUBLE) AS median_chroma, CAST((event_id * 31) % 50 AS DOUBLE) AS p90_chroma,
  CAST((event_id * 37) % 40 AS DOUBLE) AS chroma, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST((event_id * 41) % 100 AS DOUBLE) END AS ring
FROM {events}
"""

_PIXEL = """
SELECT CAST(vec_id AS BIGINT) AS tile_x, CAST(0 AS BIGINT) AS tile_y, CAST(floor(p / 8.0) AS INT) AS y, CAST(p % 8 AS INT) AS x, CAST(floor(abs(v) * 1000) AS BIGINT) % 256 AS r,
  CAST(floor(abs(v) * 3000) AS BIGINT) % 256 AS g, CAST(floor(abs(v) * 7000) AS BIGINT) % 256 AS b, CAST(floor(abs(v) * 50) AS BIGINT) % 4 AS label, CAST(floor(abs(v) * 90) AS BIGINT) % 3 AS label2, v
"""
PIXELS_SPARK = f"{_PIXEL} FROM (SELECT vec_id, p, CAST(e AS DOUBLE) AS v FROM {{embeddings}} LATERAL VIEW posexplode(embedding) AS p, e) q"
PIXELS_DUCK = f"{_PIXEL} FROM (SELECT vec_id, p, CAST(e AS DOUBLE) AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS p, unnest(embedding) AS e FROM {{embeddings}}) z) q"

#: Seconds of buckets of runs.
TIMINGS = "SELECT 'run' || CAST(l_linenumber AS VARCHAR(10)) AS label, l_returnflag || l_linestatus AS bucket, l_quantity AS t FROM {lineitem}"
BUCKETS = "(VALUES ('AF','A','MAIN'),('RF','B','MAIN'),('NF','B','BG'),('NO','C','OUTSIDE'),('AO','C','BG'),('RO','A','BG')) AS buckets(bucket, phase, arm)"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sql: str) -> str:
    """An adapter as a subquery of DuckDB."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """An adapter as a DataFrame."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql.replace("AS VARCHAR(10)", "AS STRING"), **used)
