"""Image files as pixel tables and back, in the plain binary formats PGM and PPM, and a sink of one file an image."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The head of a file: kind, width, height and largest value, parted by blanks and comments.
_HEAD = re.compile(rb"(P[56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def parsed(content: bytes) -> np.ndarray | None:
    """Values (height, width, 1 or 3) of a PGM or PPM file of 8 or 16 bits; None where it is no such file or cut short."""
    head = _HEAD.match(content)
    if not head:
        return None
    depth, width, height, most = 1 if head[1] == b"P5" else 3, *(int(head[i]) for i in (2, 3, 4))
    kind = np.dtype(">u1" if most < 256 else ">u2")
    if not 0 < most < 65536 or len(content) - head.end() < width * height * depth * kind.itemsize:
        return None
    return np.frombuffer(content, kind, width * height * depth, head.end()).reshape(height, width, depth)


def decoded(files: DataFrame, image: str = "path", content: str = "content") -> DataFrame:
    """(image, x, y, r, g, b) of image files, gray ones with equal channels; files that do not parse give no rows."""
    kind = files.schema[image].dataType.simpleString()
    out = pa.schema([("x", pa.int32()), ("y", pa.int32()), *((c, pa.float64()) for c in "rgb")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = parsed(batch.column("content")[i].as_py() or b"")
                if values is None or not values.size:
                    continue
                height, width, depth = values.shape
                flat = values.reshape(-1, depth).astype(float)
                at = np.arange(height * width, dtype=np.int32)
                image_of = batch.column("image").take(pa.array(np.full(len(at), i)))
                columns = [pa.array(at % width), pa.array(at // width), *(pa.array(flat[:, c if depth == 3 else 0]) for c in range(3))]
                yield pa.RecordBatch.from_arrays([image_of, *columns], ["image", *out.names])

    rows = files.select(F.col(image).alias("image"), F.col(content).alias("content"))
    return rows.mapInArrow(run, f"image {kind}, x int, y int, r double, g double, b double")


def encoded(pixels: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """(image, content): frames (image, x, y, channels) as PGM of one channel or PPM of three, 8 bits.

    Values are rounded and cut to 0 to 255. A frame is as wide and high as its pixels reach;
    absent pixels and null values are 0. One frame is one file, so one task holds it.
    """
    if len(channels) not in (1, 3):
        raise ValueError("an image has one channel or three")

    def run(table: pa.Table) -> pa.Table:
        x, y = np.asarray(table.column("x")), np.asarray(table.column("y"))
        values = np.zeros((y.max() + 1, x.max() + 1, len(channels)), np.uint8)
        for i, c in enumerate(channels):
            values[y, x, i] = np.clip(np.rint(np.asarray(table.column(c).fill_null(0.0))), 0, 255)
        head = b"P%d\n%d %d\n255\n" % (5 if len(channels) == 1 else 6, values.shape[1], values.shape[0])
        return pa.table({"image": table.column("image").slice(0, 1), "content": pa.array([head + values.tobytes()], pa.binary())})

    kind = pixels.schema["image"].dataType.simpleString()
    rows = pixels.where("x is not null and y is not null").select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in channels])
    return rows.groupBy("image").applyInArrow(run, f"image {kind}, content binary")


def annotated(frames: DataFrame, points: DataFrame, mark: tuple[float, ...] = (255.0, 0.0, 0.0), reach: int = 2) -> DataFrame:
    """frames (image, x, y, r, g, b) with a cross of ``reach`` pixels each way at every point (image, x, y)."""
    arms = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for d in range(-reach, reach + 1) for dx, dy in {(d, 0), (0, d)}])
    crosses = points.select("image", "x", "y", F.explode(arms).alias("a")).select("image", (F.round("x").cast("int") + F.col("a.dx")).alias("x"), (F.round("y").cast("int") + F.col("a.dy")).alias("y")).distinct().withColumn("_on", F.lit(True))
    return frames.join(crosses, ["image", "x", "y"], "left").select("image", "x", "y", *[F.when(F.col("_on"), F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in zip("rgb", mark, strict=True)])


def write_files(images: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """(name, bytes): one file an image below ``folder``, a path or URI that all executors and pyarrow reach.

    A file is written beside its place and moved there, so readers see whole files, and
    writing the same images again leaves the same files. Names may not lead out of the
    folder. The rows come when the result is read; nothing is written before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        store, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)
        for batch in batches:
            names, sizes = batch.column("name").to_pylist(), []
            for own, data in zip(names, batch.column("content"), strict=True):
                if not own or "/" in own or own.startswith("."):
                    raise ValueError(f"{own!r} is no file name")
                store.create_dir(root, recursive=True)
                beside = f"{root}/.{own}.{uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(data.as_buffer())
                store.move(beside, f"{root}/{own}")
                sizes.append(len(data.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return images.where(F.col(content).isNotNull()).select(F.col(name).alias("name"), F.col(content).alias("content")).mapInArrow(run, "name string, bytes long")
