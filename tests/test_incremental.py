from pyspark.sql import functions as F

from tessera.streaming import incremental as I

SCHEMA = "cell_id long"
TILES = [(0, 0), (768, 0), (0, 768), (768, 768)]


def tiles(spark, *at):
    return spark.createDataFrame(list(at) or TILES, "x long, y long")


def process(df):
    rows = df.where("x > 0").select(F.col("x").alias("tile_x"), F.col("y").alias("tile_y"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("cell_id"))
    return rows


def test_resume(spark, tmp_path):
    path = str(tmp_path / "t")
    assert I.stored(spark, path, "h1", SCHEMA).count() == 0
    I.save(process(tiles(spark, (0, 0), (768, 768))), tiles(spark, (0, 0), (768, 768)), path, "h1")
    done = I.completed(I.stored(spark, path, "h1", SCHEMA), tiles(spark))
    assert {tuple(r) for r in done.collect()} == {(0, 0), (768, 768)}  # a tile without cells is done too
    assert {tuple(r) for r in I.pending(tiles(spark), done).collect()} == {(768, 0), (0, 768)}
    assert I.stored(spark, path, "other", SCHEMA).count() == 0
    asked = []

    def counted(df):
        asked.append({tuple(r) for r in df.collect()})
        return process(df)

    out = I.resume(spark, tiles(spark), counted, path, "h1", SCHEMA)
    assert out.count() == 4 and asked == [{(768, 0), (0, 768)}]
    again = I.resume(spark, tiles(spark), counted, path, "h1", SCHEMA)
    assert again.count() == 4 and len(asked) == 1
    I.save(process(tiles(spark, (768, 0))).limit(1), tiles(spark, (768, 0)), path, "h1")
    assert I.resume(spark, tiles(spark), counted, path, "h1", SCHEMA).count() == 3  # replaced as a whole
    I.save(process(tiles(spark, (999999, 0))), tiles(spark, (999999, 0)), path, "h1")
    assert I.resume(spark, tiles(spark), counted, path, "h1", SCHEMA).count() == 3  # foreign tiles are ignored


def test_stream_of_tiles(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    for k, (x, y) in enumerate([*TILES, (768, 0)]):
        (src / f"{k}.csv").write_text(f"{x},{y}\n")
    arrivals = spark.readStream.schema("x long, y long").option("maxFilesPerTrigger", 2).csv(str(src))
    seen = []
    for _ in range(2):  # the second run finds nothing new
        I.run_stream(arrivals, process, out, str(tmp_path / "cp"), "h", SCHEMA, lambda b, n: seen.append(n)).awaitTermination(120)
    assert sum(seen) == 4 and len(seen) >= 3
    assert I.resume(spark, tiles(spark), process, out, "h", SCHEMA).count() == 4


def test_windowed_counts_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "a"), ("2024-01-01 11:00:00", "a"), ("2024-01-02 10:00:00", "b")], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type")
    rows.write.parquet(str(tmp_path / "e"))
    q = I.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 2] == sorted(r.n for r in I.windowed_counts(rows).collect())


def test_jobs():
    jobs = I.Jobs()
    a, new = jobs.submit("k")
    assert new and jobs.submit("k") == (a, False)
    jobs.publish(a, "cut", 1, 4)
    jobs.finish(a, tiles=4)
    b, new = jobs.submit("k")
    assert new and b != a and jobs.jobs[a]["status"] == "completed"


def test_a_broken_file_is_done_again(spark, tmp_path):
    path, at = tmp_path / "t", [(0, 0), (768, 0), (768, 768)]
    first = sorted(tuple(r) for r in I.resume(spark, tiles(spark, *at), process, str(path), "h", SCHEMA).collect())
    parts = sorted(path.glob("config_hash=h/tile_x=768/tile_y=0/*.parquet"))
    assert len(parts) == 1  # rows and marker together
    asked = []

    def counted(df):
        asked.append({tuple(r) for r in df.collect()})
        return process(df)

    whole = parts[0].read_bytes()
    for broken in (b"no parquet", whole[: len(whole) // 2], whole[:4] + bytes(40) + whole[44:]):
        (part,) = path.glob("config_hash=h/tile_x=768/tile_y=0/*.parquet")
        part.write_bytes(broken)
        for crc in part.parent.glob(".*.crc"):
            crc.unlink()
        spark.catalog.refreshByPath(str(path))
        again = sorted(tuple(r) for r in I.resume(spark, tiles(spark, *at), counted, str(path), "h", SCHEMA).collect())
        assert again == first and asked.pop() == {(768, 0)}
        (part,) = path.glob("config_hash=h/tile_x=768/tile_y=0/*.parquet")
        whole = part.read_bytes()


def test_a_tile_without_its_marker_is_done_again(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = process(tiles(spark, (768, 0))).withColumns({"marker": F.lit(False), "config_hash": F.lit("h")})
    rows.write.partitionBy("config_hash", *I.KEY).parquet(path)
    assert I.stored(spark, path, "h", SCHEMA).count() == 0
    assert I.resume(spark, tiles(spark, (768, 0)), process, path, "h", SCHEMA).count() == 2
