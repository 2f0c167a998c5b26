"""Aggregated residual vectors over a codebook."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.exprs import sq_euclidean
from lodestar.operators.knn import few, nearest


def assigned(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Points with nearest center k; distances are rounded to 9 places before the minimum, ties go to the lower k."""
    return nearest(points, centers, lambda a, b: F.round(sq_euclidean(a, b), 9))


def encode(points: DataFrame, centers: DataFrame) -> DataFrame:
    """(image_id, k, pos, resid, n): sums of residuals and counts, for the centers that have points."""
    own = assigned(points, centers).join(few(centers), "k")
    long = own.select("image_id", "k", F.posexplode(F.zip_with("vec", "center", lambda x, c: x - c)).alias("pos", "r"))
    return long.groupBy("image_id", "k", "pos").agg(F.sum("r").alias("resid"), F.count(F.lit(1)).alias("n"))


def filled(encoded: DataFrame, centers: DataFrame) -> DataFrame:
    """Encoded rows of all centers; those without points are zero."""
    images = encoded.select("image_id").distinct()
    grid = images.crossJoin(F.broadcast(few(centers).select("k", F.posexplode("center").alias("pos", "_c")).drop("_c")))
    return grid.join(encoded, ["image_id", "k", "pos"], "left").fillna({"resid": 0.0, "n": 0})


def normalized(encoded: DataFrame, least: float = 1e-3, rows: bool = True) -> DataFrame:
    """(image_id, k, pos, v): each center's row over its norm (zero below ``least``), then all over the global norm; zero stays zero.

    rows: False leaves out the first step.
    """
    from pyspark.sql import Window

    out = encoded
    if rows:
        norm = F.sqrt(F.sum(F.col("resid") * F.col("resid")).over(Window.partitionBy("image_id", "k")))
        out = out.withColumn("_n", norm).withColumn("resid", F.when(F.col("_n") < least, 0.0).otherwise(F.col("resid") / F.col("_n")))
    whole = F.sqrt(F.sum(F.col("resid") * F.col("resid")).over(Window.partitionBy("image_id")))
    return out.withColumn("_g", whole).select("image_id", "k", "pos", F.when(F.col("_g") > 0, F.col("resid") / F.col("_g")).otherwise(0.0).alias("v"))


def flattened(normal: DataFrame) -> DataFrame:
    """(image_id, vec): entries ordered by center and position."""
    return normal.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "pos", "v"))), lambda t: t["v"]).alias("vec"))


def adapt(points: DataFrame, centers: DataFrame) -> DataFrame:
    """(k, pos, center): mean of the assigned points and the old center, halved; an empty center stays."""
    means = assigned(points, centers).select("k", F.posexplode("vec").alias("pos", "x")).groupBy("k", "pos").agg(F.avg("x").alias("m"))
    old = centers.select("k", F.posexplode("center").alias("pos", "c"))
    return old.join(means, ["k", "pos"], "left").select("k", "pos", F.coalesce((F.col("m") + F.col("c")) / 2, "c").alias("center"))


def rebase(encoded: DataFrame, old: DataFrame, new: DataFrame, sign: int = -1) -> DataFrame:
    """Residuals after the centers moved, assignments kept: sums change by sign * n * (new - old); -1 is exact."""
    moved = old.join(new.withColumnRenamed("center", "center2"), "k").select("k", F.posexplode(F.zip_with("center2", "center", lambda b, a: b - a)).alias("pos", "d"))
    return encoded.join(moved, ["k", "pos"]).select("image_id", "k", "pos", (F.col("resid") + sign * F.col("n") * F.col("d")).alias("resid"), "n")


def means(points: DataFrame, centers: DataFrame) -> DataFrame:
    """One Lloyd step: (k, pos, center) of the assigned points' means; empty centers stay."""
    m = assigned(points, centers).select("k", F.posexplode("vec").alias("pos", "x")).groupBy("k", "pos").agg(F.avg("x").alias("m"))
    old = centers.select("k", F.posexplode("center").alias("pos", "c"))
    return old.join(m, ["k", "pos"], "left").select("k", "pos", F.coalesce("m", "c").alias("center"))
