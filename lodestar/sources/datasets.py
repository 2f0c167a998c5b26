"""Readers of vehicle data sets and topic catalogues, as schema-first text scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.exprs import euler_quaternion, utm
from lodestar.operators.trajectory import interpolate

#: Origin of the local frame (easting, northing, altitude), message types of images and of positions.
ORIGIN = (-620248.53, -5734882.47, 0.0)
IMAGE_TYPES = ("sensor_msgs/Image", "sensor_msgs/CompressedImage")
TRAJECTORY_TYPES = ("sensor_msgs/NavSatFix", "nmea_msgs/Sentence")


def topics_of(catalog: DataFrame, types: tuple[str, ...], topic: str | None = None) -> DataFrame:
    """Topics (topic, type) of the wanted types; a named topic must be among them."""
    found = catalog.where(F.col("type").isin(*types))
    if topic is None:
        return found
    chosen = found.where(F.col("topic") == topic)
    if chosen.isEmpty():
        raise ValueError(f"{topic} is no topic of {', '.join(types)}")
    return chosen


def suggested_topic(catalog: DataFrame, types: tuple[str, ...] = IMAGE_TYPES) -> str:
    """The first topic by name of the wanted types; none is an error."""
    first = topics_of(catalog, types).agg(F.min("topic").alias("topic")).first().topic
    if first is None:
        raise ValueError(f"no topic of {', '.join(types)}")
    return first


def positions(messages: DataFrame) -> DataFrame:
    """Messages of one position topic with zone, easting, northing, altitude: fixes (latitude, longitude, altitude) or sentences; the first message's type decides.

    Fixes without a place and sentences that do not parse are dropped; a type that holds no position fails.
    """
    kind = messages.select("type").first()
    if kind is None:
        return messages.withColumns({c: F.lit(None).cast("int" if c == "zone" else "double") for c in ("zone", "easting", "northing", "altitude")})
    if kind.type not in TRAJECTORY_TYPES:
        raise ValueError(f"{kind.type} holds no position")
    if kind.type == TRAJECTORY_TYPES[1]:
        return nmea_positions(messages)
    zone, easting, northing = utm(F.col("latitude"), F.col("longitude"))
    return messages.where("latitude is not null and longitude is not null").withColumns({"zone": zone, "easting": easting, "northing": northing})


def frames_with_positions(messages: DataFrame, catalog: DataFrame, image_topic: str | None = None, position_topic: str | None = None) -> DataFrame:
    """Messages (topic, ts, ...) of an image topic with the position topic's easting, northing, altitude at their times; frames outside the track are dropped.

    Topics not named are suggested; a named one must be of the right kind. Both filters reach the scan.
    """
    names = []
    for topic, types in ((image_topic, IMAGE_TYPES), (position_topic, TRAJECTORY_TYPES)):
        names.append(suggested_topic(topics_of(catalog, types, topic), types))
    typed = messages.join(F.broadcast(catalog.where(F.col("topic").isin(*names)).select("topic", "type").distinct()), "topic") if "type" not in messages.columns else messages
    values = ["easting", "northing", "altitude"]
    track = positions(typed.where(F.col("topic") == names[1])).select("ts", *values, F.lit(0).alias("_one"))
    frames = messages.where(F.col("topic") == names[0]).drop(*values).withColumn("_one", F.lit(0))
    return interpolate(frames, track, "_one", values).drop("_one")


def image_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """(us, ts, file): column 0 in microseconds; the last row is dropped, the file is named by its time."""
    rows = spark.read.schema("us long, chunk int").option("sep", " ").csv(path)
    last = rows.agg(F.max("us").alias("last"))
    return rows.join(F.broadcast(last), F.col("us") < F.col("last")).select("us", F.timestamp_micros("us").alias("ts"), F.concat(F.col("us").cast("string"), F.lit(".png")).alias("file"))


def origin_shift(df: DataFrame, origin: tuple[float, float, float] = ORIGIN) -> DataFrame:
    """easting, northing, altitude moved by the origin."""
    return df.withColumns({c: F.col(c) + v for c, v in zip(("easting", "northing", "altitude"), origin, strict=True)})


def gps(spark: SparkSession, path: str, origin: tuple[float, float, float] = ORIGIN) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    cast = raw.select(F.timestamp_micros(F.col("timestamp").cast("long")).alias("ts"), *[F.col(c).cast("double").alias(c) for c in ("easting", "northing", "altitude")])
    return origin_shift(cast, origin)


def ground_truth(spark: SparkSession, path: str, origin: tuple[float, float, float] = ORIGIN) -> DataFrame:
    """(ts, easting, northing, altitude, qx, qy, qz, qw) from Euler angles."""
    raw = spark.read.option("header", True).csv(path)
    n = {c: F.col(c).cast("double") for c in ("roll", "pitch", "yaw", "easting", "northing", "altitude")}
    q = euler_quaternion(n["roll"], n["pitch"], n["yaw"])
    cast = raw.select(F.timestamp_micros(F.col("timestamp").cast("long")).alias("ts"), *[n[c].alias(c) for c in ("easting", "northing", "altitude")], *[x.alias(c) for x, c in zip(q, ("qx", "qy", "qz", "qw"), strict=True)])
    return origin_shift(cast, origin)


def nmea_checksum(sentence: Column) -> Column:
    """Two hexadecimal digits: all characters between $ and * joined by exclusive or."""
    letters = F.filter(F.split(F.regexp_extract(sentence, r"^\$([^*]*)", 1), ""), lambda c: c != "")
    return F.lpad(F.hex(F.aggregate(letters, F.lit(0), lambda s, c: s.bitwiseXOR(F.ascii(c))).cast("long")), 2, "0")


def nmea_positions(sentences: DataFrame, column: str = "sentence") -> DataFrame:
    """zone, easting, northing, altitude of GGA sentences with a fix; rows that do not parse, and those whose checksum is wrong, are dropped.

    A sentence without a checksum is taken as it is.
    """
    part = F.split(F.regexp_replace(column, r"\*.*$", ""), ",")
    told = F.upper(F.regexp_extract(column, r"\*([0-9A-Fa-f]{2})\s*$", 1))

    def degrees(value, side, negative):
        v = F.get(part, F.lit(value)).try_cast("double")
        whole = F.floor(v / 100)
        return (whole + (v - whole * 100) / 60) * F.when(F.get(part, F.lit(side)) == negative, -1).otherwise(1)

    good = sentences.where(F.col(column).rlike(r"^\$..GGA,") & ((told == "") | (told == nmea_checksum(F.col(column)))))
    good = good.withColumns({"lat": degrees(2, 3, "S"), "lon": degrees(4, 5, "W"), "altitude": F.get(part, F.lit(9)).try_cast("double"), "_fix": F.get(part, F.lit(6)).try_cast("int")})
    good = good.where("lat is not null and lon is not null and altitude is not null and _fix > 0").drop("_fix")
    zone, easting, northing = utm(F.col("lat"), F.col("lon"))
    return good.withColumns({"zone": zone, "easting": easting, "northing": northing})


def lookup_table(spark: SparkSession, path: str, height: int = 960, width: int = 1280) -> DataFrame:
    """(row, col, x, y) from two float64 planes; a file of another size fails."""
    import numpy as np
    import pandas as pd

    def load(batches):
        for pdf in batches:
            for content in pdf.content:
                if len(content) != 16 * height * width:
                    raise ValueError(f"{len(content)} bytes are no lookup table of {height} x {width}")
                x, y = np.frombuffer(content, "<f8").reshape(2, height * width)
                at = np.arange(height * width)
                yield pd.DataFrame({"row": at // width, "col": at % width, "x": x, "y": y})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "row long, col long, x double, y double")


def image_files(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """Image files below a folder; decoding is left to a mapInPandas hook."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
