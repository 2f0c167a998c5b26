"""Tables and the views that operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.exprs import sign_bits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, word): lower-cased ASCII tokens of documents, one row an occurrence."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("image_id"), F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, kp_ind, vec, bits, label): embeddings as float and as sign-bit descriptors."""
    v = table(spark, sf_dir, "embeddings")
    return v.select((F.col("vec_id") % 25).alias("image_id"), F.col("vec_id").alias("kp_ind"), F.col("embedding").cast("array<double>").alias("vec"), sign_bits(F.col("embedding")).alias("bits"), "label")


def centers(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """(k, center): the first vectors stand for a codebook."""
    return vectors(spark, sf_dir).where(F.col("kp_ind") < k).select(F.col("kp_ind").alias("k"), F.col("vec").alias("center"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts, easting, northing): events other than clicks."""
    return events(spark, sf_dir).where("event_type <> 'click'").select("user_id", "ts", F.col("value").alias("easting"), F.col("event_id").cast("double").alias("northing"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, user_id, ts): clicks."""
    return events(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("image_id"), "user_id", "ts")
