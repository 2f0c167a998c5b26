"""Pixel-table operators: masks, class tables, colour balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed class labels in order, and whether a pixel of the class is kept; 12 and above are dropped.
CLASSES = ("Sky", "Building", "Pole", "Road Marking", "Road", "Pavement", "Tree", "Sign", "Fence", "Vehicle", "Pedestrian", "Bike")
DROPPED = (0, 6, 9, 10, 11)


def class_mask(pixels: DataFrame, column: str = "class") -> DataFrame:
    """pixels with label and keep."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    known = F.col(column).between(0, len(CLASSES) - 1)
    return pixels.withColumns({"label": F.when(known, F.get(names, F.col(column))), "keep": known & ~F.col(column).isin(*DROPPED)})


def both_masks(pixels: DataFrame, *masks: Column) -> DataFrame:
    """Pixels under all masks."""
    out = pixels
    for m in masks:
        out = out.where(m)
    return out


def gray_world(pixels: DataFrame, by: str, channels: list[str]) -> DataFrame:
    """Channels scaled so that each one's mean in the image is the mean of all; an image is spread over tasks."""
    means = pixels.groupBy(by).agg(*[F.avg(c).alias(f"_{c}") for c in channels])
    grey = sum((F.col(f"_{c}") for c in channels[1:]), F.col(f"_{channels[0]}")) / len(channels)
    scaled = pixels.join(means, by).withColumns({c: F.when(F.col(f"_{c}") != 0, F.col(c) * grey / F.col(f"_{c}")).otherwise(F.col(c)) for c in channels})
    return scaled.drop(*[f"_{c}" for c in channels])


def gray_adjust(pixels: DataFrame, by: str, y: str, cr: str, cb: str, k: float = 4.0, alpha: float = 0.5) -> DataFrame:
    """gray = Y + k (mean Cr - mean Cb) (Cr - Cb) |Cr - Cb|**alpha."""
    means = pixels.groupBy(by).agg((F.avg(cr) - F.avg(cb)).alias("_m"))
    d = F.col(cr) - F.col(cb)
    return pixels.join(means, by).withColumn("gray", F.col(y) + k * F.col("_m") * d * F.pow(F.abs(d), F.lit(alpha))).drop("_m")


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma of three channels."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def remap(pixels: DataFrame, table: DataFrame, channels: list[str], edge: tuple[int, int] | None = None) -> DataFrame:
    """Frames (image, x, y, channels) seen through a table (x, y, sx, sy) of source places, bilinear.

    What lies outside a frame counts as 0, or with edge = (width, height) as the nearest
    border pixel. Places that no source pixel reaches are left out. The table has one row a
    pixel of a frame, whatever the number of frames; Spark broadcasts it if it is small.
    """
    taps = table
    for s, i, w in (("sx", "_ix", "_wx"), ("sy", "_iy", "_wy")):
        part = F.col(s) - F.floor(s)
        both = F.array(F.struct(F.floor(s).cast("int").alias("i"), (1 - part).alias("w")), F.struct((F.floor(s) + 1).cast("int").alias("i"), part.alias("w")))
        taps = taps.withColumn("_t", F.explode(both)).withColumns({i: F.col("_t.i"), w: F.col("_t.w")}).drop("_t")
    if edge:
        taps = taps.withColumns({c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(n - 1)) for c, n in zip(("_ix", "_iy"), edge, strict=True)})
    taps = taps.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("_ix").alias("x"), F.col("_iy").alias("y"), (F.col("_wx") * F.col("_wy")).alias("_w"))
    found = pixels.join(taps, ["x", "y"]).groupBy("image", F.col("_x").alias("x"), F.col("_y").alias("y"))
    return found.agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in channels])


def resize(pixels: DataFrame, factor: float, width: int, height: int, channels: list[str]) -> DataFrame:
    """Frames of width by height pixels scaled by a factor, bilinear between pixel centres."""
    w, h = max(1, round(width * factor)), max(1, round(height * factor))
    grid = pixels.sparkSession.range(w * h).select((F.col("id") % w).cast("int").alias("x"), F.floor(F.col("id") / w).cast("int").alias("y"))
    table = grid.select("x", "y", ((F.col("x") + 0.5) / F.lit(w / width) - 0.5).alias("sx"), ((F.col("y") + 0.5) / F.lit(h / height) - 0.5).alias("sy"))
    return remap(pixels, table, channels, (width, height))


def demosaic(pixels: DataFrame, value: str = "v") -> DataFrame:
    """(image, x, y, r, g, b) of raw frames whose even rows read r g r g and odd rows g b g b.

    A pixel keeps its own colour and takes each other one from the mean of that colour among
    its eight neighbours: every raw pixel is sent to the nine places around it.
    """
    parity = F.pmod("x", F.lit(2)) + 2 * F.pmod("y", F.lit(2))
    colour = F.element_at(F.array(*[F.lit(c) for c in "rggb"]), (parity + 1).cast("int"))
    near = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    sent = pixels.select("image", F.col("x").alias("_x"), F.col("y").alias("_y"), colour.alias("_c"), F.col(value).alias("_v"), F.explode(near).alias("_n"))
    sent = sent.select("image", (F.col("_x") + F.col("_n.dx")).alias("x"), (F.col("_y") + F.col("_n.dy")).alias("y"), "_c", "_v", ((F.col("_n.dx") == 0) & (F.col("_n.dy") == 0)).alias("_own"))
    sent = sent.withColumn("_at", colour).where((F.col("_c") != F.col("_at")) | F.col("_own"))
    out = sent.groupBy("image", "x", "y").agg(*[F.avg(F.when(F.col("_c") == c, F.col("_v"))).alias(c) for c in "rgb"], F.max("_own").alias("_own"))
    return out.where("_own").drop("_own")  # places beyond a border got no pixel of their own


def first_dimensions(pixels: DataFrame) -> DataFrame:
    """(image, width, height) of the first frame."""
    first = pixels.agg(F.min("image").alias("image"))
    return pixels.join(F.broadcast(first), "image").groupBy("image").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))
