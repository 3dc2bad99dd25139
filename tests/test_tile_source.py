"""Tiles as a data source: tables, pushed conditions, streams that go on where they stopped, failing tiles, progress."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.kernels import window_starts
from tessera.sources import tiles
from tessera.streaming import progress


class BrokenSlide(tiles.ArraySlide):
    """A slide of which one tile can't be read."""

    def read(self, x, y, width, height):
        if (x, y) == (48, 32):
            raise OSError("the tile at 48, 32 is broken")
        return super().read(x, y, width, height)


@pytest.fixture
def slide(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 256, (90, 130, 3)).astype(np.uint8)
    np.save(tmp_path / "slide.npy", a)
    tiles.register(spark)
    return a, str(tmp_path / "slide.npy")


def load(reader, path, **options):
    return reader.format("slide_tiles").options(tile=32, overlap=16, tilesPerPartition=4, **options).load(path)


PLACES = [(x, y) for y in window_starts(90, 32, 16) for x in window_starts(130, 32, 16)]


def test_a_table_of_tiles(spark, slide):
    a, path = slide
    df = load(spark.read, path)
    rows = df.collect()
    assert [(r.x, r.y) for r in rows] == PLACES and df.rdd.getNumPartitions() == -(-len(PLACES) // 4)
    assert all(np.array_equal(np.frombuffer(r.data, np.uint8).reshape(32, 32, 3), a[r.y : r.y + 32, r.x : r.x + 32]) for r in rows)
    region = load(spark.read, path, region="10,20,64,32").collect()
    assert [(r.x, r.y) for r in region] == [(10, 20), (26, 20), (42, 20)]
    small = spark.read.format("slide_tiles").option("tile", 100).load(path).collect()
    assert len(small) == 2 and np.frombuffer(small[0].data, np.uint8).reshape(100, 100, 3)[90:].min() == 255
    for bad in ({"region": "0,0,10,10"}, {"region": "100,0,64,64"}):
        with pytest.raises(Exception, match="region must lie"):
            load(spark.read, path, **bad).collect()


def test_conditions_leave_out_places(spark, slide):
    _, path = slide
    df = tiles.load(spark, path, tile=32, overlap=16, tilesPerPartition=4)
    some = df.where((F.col("x") >= 32) & (F.col("x") < 64) & F.col("y").isin(0, 16))
    assert sorted((r.x, r.y) for r in some.collect()) == sorted(p for p in PLACES if 32 <= p[0] < 64 and p[1] in (0, 16)) and some.rdd.getNumPartitions() == 1
    assert df.count() == len(PLACES)  # also after a query with conditions
    assert df.where("x = 5").count() == 0 and df.where("x = 16 AND height > 40").count() == 0 and df.where("x + y = 16").count() == 2
    broken = tiles.load(spark, path, tile=32, overlap=16, opener="tests.test_tile_source:BrokenSlide")
    assert broken.where("x < 48 AND y < 48 AND y > 0").count() == 6
    with pytest.raises(Exception, match="48, 32 is broken"):
        broken.collect()


def test_a_stream_takes_its_tiles_in_bounded_batches_and_goes_on(spark, slide, tmp_path):
    _, path = slide
    out, state, check = (str(tmp_path / n) for n in ("out", "state", "check"))
    sizes = []

    def keep(df, batch):
        n = df.select("x", "y").persist()
        sizes.append(n.count())
        n.write.mode("append").parquet(out)
        n.unpersist()

    def start():
        return load(spark.readStream, path, maxTilesPerTrigger=10, state=state).writeStream.foreachBatch(keep).option("checkpointLocation", check).trigger(processingTime="0 seconds").start()

    query = start()
    for _ in range(100):
        if len(sizes) > 1:
            break
        progress.await_end(query, 0.2, most=0.2)
    query.stop()
    query = start()
    query.processAllAvailable()
    query.stop()
    got = [(r.x, r.y) for r in spark.read.parquet(out).collect()]
    assert sorted(set(got)) == sorted(PLACES) and max(sizes) <= 10
    assert len(got) == len(PLACES) or len(got) - len(PLACES) <= 10  # the batch that stop() broke off is done again
    with pytest.raises(Exception, match="needs the folder state"):
        load(spark.readStream, path, maxTilesPerTrigger=3).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2")).start().processAllAvailable()


def test_progress_is_published_and_a_failing_tile_ends_the_stream(spark, slide, tmp_path):
    _, path = slide
    for opener, name in (("tests.test_tile_source:BrokenSlide", "broken"), ("", "whole")):
        told = []
        listener = progress.Progress(lambda *x: told.append(x), len(PLACES), name=name)
        spark.streams.addListener(listener)
        try:
            stream = progress.counted(load(spark.readStream, path, maxTilesPerTrigger=7, state=str(tmp_path / f"s-{name}"), **({"opener": opener} if opener else {})))
            query = stream.writeStream.queryName(name).format("noop").option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(processingTime="0 seconds").start()
            if name == "broken":
                with pytest.raises(Exception, match="48, 32 is broken"):
                    progress.await_end(query, 0.2, most=60)
            else:
                query.processAllAvailable()
                assert progress.await_end(query, 0.1, most=0.2) == "running"
                query.stop()
            for _ in range(100):
                if listener.ended:
                    break
                progress.time.sleep(0.1)
        finally:
            spark.streams.removeListener(listener)
        assert told[0] == ("tiles", 0, len(PLACES), "tiles") and [t[1] for t in told] == sorted(t[1] for t in told) and listener.ended
        where = PLACES.index((48, 32))
        assert (listener.done == where // 7 * 7 and listener.error) if name == "broken" else (listener.done == len(PLACES) and not listener.error)
