"""Streams: replayed and repeated batches, positions out of order, frames with their last position."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from lodestar.operators.placemap import PlaceMap, Settings
from lodestar.streaming import streams
from pyspark.sql import functions as F

T = datetime(2024, 1, 1)
POSITION = "user long, ts timestamp, easting double, northing double"


def at(seconds):
    return T + timedelta(seconds=seconds)


def files(spark, folder, schema, *batches):
    """A stream that takes one file a batch, in the order given."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def collected(df, mode="append"):
    """Rows of each batch that the stream gives."""
    out = []
    checkpoint = df.sparkSession.conf.get("spark.checkpoint.dir") + f"/streams-{id(out)}-{np.random.default_rng().integers(1 << 60)}"
    df.writeStream.foreachBatch(lambda b, _: out.append([tuple(r) for r in b.collect()])).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return out


def features(images):
    return [(i, 10 * i + k, int(np.random.default_rng(100 * i + k).integers(-(2**63), 2**63))) for i in images for k in range(6)]


def test_ingest_and_localize_are_repeatable(spark, tmp_path):
    schema = "image_id long, kp_ind long, bits long"
    stream = files(spark, tmp_path / "in", schema, features([1, 2]), features([3]), features([4]))
    target = PlaceMap(spark, str(tmp_path / "map"), Settings(purge=False))
    target.add(spark.createDataFrame(features([0]), schema), spark.createDataFrame([(0, 5.0)], "image_id long, easting double"))
    streams.ingest(stream, target, str(tmp_path / "a"))
    assert target.batches == {"stream": 2} and target.stats().first().images == 5
    number = target.number
    streams.ingest(stream, target, str(tmp_path / "a"))  # nothing new
    streams.ingest(stream, target, str(tmp_path / "b"))  # a lost checkpoint: all batches come again
    assert target.number == number and target.table("postings").count() == 30
    asked = files(spark, tmp_path / "asked", schema, features([3]) + [(70, k, b) for _, k, b in features([0])], features([4]))
    for checkpoint in ("c", "d"):
        streams.localize(asked, target, str(tmp_path / "out"), str(tmp_path / checkpoint), 1)
        got = {(r.batch, r.query_id): (r.image_id, r.easting) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == {(0, 3): (3, None), (0, 70): (0, 5.0), (1, 4): (4, None)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_latest_positions_over_days_and_late_rows(spark, tmp_path):
    rows = files(spark, tmp_path / "p", POSITION, [(1, at(10), 1.0, 1.0), (2, at(5), 9.0, 9.0)], [(1, at(90000), 2.0, 2.0)], [(1, at(50), 3.0, 3.0), (2, at(6), 8.0, 8.0)])
    got = collected(streams.latest_positions(rows, "user"), "update")
    last = {}
    for batch in got:
        last |= {r[0]: r[1:] for r in batch}
    assert last == {1: (at(90000), 2.0, 2.0), 2: (at(6), 8.0, 8.0)}


@pytest.fixture
def joined(spark, tmp_path):
    def run(frames, positions):
        f = files(spark, tmp_path / "f", "user long, ts timestamp, image_id long", *frames)
        p = files(spark, tmp_path / "p", POSITION, *positions)
        return [sorted(b) for b in collected(streams.with_latest_position(f, p, "user"))]

    return run


def test_frames_take_the_last_position(joined):
    """Each batch holds a file of frames and one of positions."""
    frames = [[(1, at(5), 50), (1, at(11), 51), (3, at(1), 53), (None, at(1), 54)], [(1, at(12), 52), (1, at(30), 55)], [(1, at(31), 56), (3, at(2), 57)]]
    positions = [
        [(1, at(20), 2.0, 2.0), (1, at(10), 1.0, 1.0), (None, at(0), 0.0, 0.0)],  # out of order within the batch, one after its frames
        [(1, at(15), 7.0, 7.0), (1, at(30), 3.0, 3.0)],  # the first is late: a later one is known
        [(3, at(2), 4.0, 4.0)],
    ]
    got = joined(frames, positions)
    none = (None, None, None)
    assert [[(r[2], *r[3:]) for r in batch] for batch in got if batch] == [
        [(50, *none), (51, at(10), 1.0, 1.0), (53, *none)],
        [(52, at(20), 2.0, 2.0), (55, at(30), 3.0, 3.0)],
        [(56, at(30), 3.0, 3.0), (57, at(2), 4.0, 4.0)],
    ]


def test_utm_stream_and_finalise(spark, tmp_path):
    fixes = files(spark, tmp_path / "g", "latitude double, longitude double", [(51.0, 7.0)], [(-33.0, 18.5)])
    got = [r for b in collected(streams.utm_stream(fixes).select("zone", F.round("easting"), F.round("northing"))) for r in b]
    assert [r[0] for r in got] == [32, 34] and 359000 < got[0][1] < 361000 and 6300000 < got[1][2] < 6400000
    query = streams.to_memory(streams.utm_stream(fixes), "utm_points")
    query.awaitTermination()
    assert spark.table("utm_points").count() == 2 and not query.isActive
