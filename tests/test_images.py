"""Image files: round trips, crosses, and a sink whose batches may come again."""

import numpy as np
import pytest
from lodestar.sources import images
from lodestar.streaming import streams


def ppm(values):
    height, width, depth = values.shape
    return b"P%d # a comment\n%d %d\n255\n" % (5 if depth == 1 else 6, width, height) + values.astype(np.uint8).tobytes()


def test_round_trip(spark):
    rng = np.random.default_rng(2)
    color, gray = rng.integers(0, 256, (5, 7, 3)), rng.integers(0, 256, (4, 3, 1))
    wide = b"P5 2 1 1000\n" + np.array([3, 1000], ">u2").tobytes()
    files = spark.createDataFrame([("c", ppm(color)), ("g", ppm(gray)), ("w", wide), ("cut", ppm(color)[:-1]), ("png", b"\x89PNG"), ("null", None)], "path string, content binary")
    pixels = images.decoded(files)
    got = {(r.image, r.x, r.y): (r.r, r.g, r.b) for r in pixels.collect()}
    assert got == {("c", x, y): tuple(map(float, color[y, x])) for x in range(7) for y in range(5)} | {("g", x, y): (float(gray[y, x, 0]),) * 3 for x in range(3) for y in range(4)} | {("w", 0, 0): (3.0,) * 3, ("w", 1, 0): (1000.0,) * 3}
    back = {r.image: bytes(r.content) for r in images.encoded(pixels).collect()}
    assert np.array_equal(images.parsed(back["c"]), color) and images.parsed(back["w"])[0, 1].tolist() == [255] * 3
    assert np.array_equal(images.parsed({r.image: bytes(r.content) for r in images.encoded(pixels, ("g",)).collect()}["g"]), gray)
    with pytest.raises(ValueError, match="three"):
        images.encoded(pixels, ("r", "g"))


def test_crosses(spark):
    frames = spark.createDataFrame([(i, x, y, 1.0, 2.0, 3.0) for i in (1, 2) for x in range(4) for y in range(4)], "image int, x int, y int, r double, g double, b double")
    points = spark.createDataFrame([(1, 0.2, 1.4), (1, 0.0, 1.0), (1, 90.0, 90.0)], "image int, x double, y double")
    marked = {(r.image, r.x, r.y) for r in images.annotated(frames, points, reach=1).collect() if (r.r, r.g, r.b) == (255.0, 0.0, 0.0)}
    assert marked == {(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 1, 1)}
    assert images.annotated(frames, points.limit(0)).count() == 32


def test_replayed_batches_leave_the_same_files(spark, tmp_path):
    schema = "name string, content binary"
    for i, rows in enumerate(([("a.ppm", b"one"), ("b.ppm", b"two")], [("c.ppm", b""), ("none.ppm", None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for folder in (str(tmp_path / "out"), f"file://{tmp_path}/uri"):
        for checkpoint in "xy":  # the second has lost its checkpoint
            streams.write_frames(stream, folder, f"{folder}-{checkpoint}")
            where = tmp_path / folder.rsplit("/", 1)[1]
            assert {p.name: p.read_bytes() for p in where.iterdir() if not p.name.endswith(".crc")} == {"a.ppm": b"one", "b.ppm": b"two", "c.ppm": b""}
            log = spark.read.parquet(f"{folder}-log")
            assert sorted((r.batch, r["name"], r.bytes) for r in log.collect()) == [(0, "a.ppm", 3), (0, "b.ppm", 3), (1, "c.ppm", 0)]


def test_names_stay_in_the_folder(spark, tmp_path):
    for name in ("../x", "", ".hidden", None):
        bad = spark.createDataFrame([(name, b"x")], "name string, content binary")
        with pytest.raises(Exception, match="no file name"):
            images.write_files(bad, str(tmp_path)).collect()
    assert not list(tmp_path.iterdir())
