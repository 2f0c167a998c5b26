"""Positions in time: interpolation, resampling, heading, down-sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.exprs import yaw_quaternion


#: Rows of one key are cut by this many microseconds, so that a long track fills many tasks.
SPAN = 86_400_000_000


def bracketed(frames: DataFrame, track: DataFrame, by: str, values: list[str], span: int = SPAN) -> DataFrame:
    """frames with the track's last row at or before (p_*) and first at or after (n_*) their time, within ``by``.

    One union sorted by time in each span of time of each group; no range join. What lies
    before and after a span comes from the first and last rows of the others, one row a span.
    """
    point = F.struct(F.col("ts").alias("t"), *values)
    cut = F.floor(F.unix_micros("ts") / span)
    f = frames.withColumn("_at", F.lit(None).cast(track.select(point.alias("x")).schema["x"].dataType)).withColumns({"_frame": F.lit(1), "_span": cut})
    t = track.select(by, "ts", point.alias("_at"), F.lit(0).alias("_frame"), cut.alias("_span"))
    both = f.unionByName(t, allowMissingColumns=True)
    back = Window.partitionBy(by, "_span").orderBy("ts", "_frame").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by, "_span").orderBy(F.desc("ts"), "_frame").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_p", F.last("_at", ignorenulls=True).over(back)).withColumn("_n", F.last("_at", ignorenulls=True).over(ahead)).where("_frame = 1")
    ends = both.groupBy(by, "_span").agg(F.max("_at").alias("_last"), F.min("_at").alias("_first"))
    order = Window.partitionBy(by).orderBy("_span")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    others = ends.select(by, "_span", F.last("_last", ignorenulls=True).over(before).alias("_before"), F.first("_first", ignorenulls=True).over(after).alias("_after"))
    found = found.join(others, [by, "_span"]).withColumns({"_p": F.coalesce("_p", "_before"), "_n": F.coalesce("_n", "_after")})
    return found.select(*frames.columns, *[F.col(f"_p.{c}").alias(f"p_{c}") for c in ("t", *values)], *[F.col(f"_n.{c}").alias(f"n_{c}") for c in ("t", *values)])


def fraction(at: str = "ts"):
    """Where a time stands between its brackets, 0 to 1; 0 on an exact hit."""
    span = F.unix_micros("n_t") - F.unix_micros("p_t")
    return F.when(span > 0, (F.unix_micros(at) - F.unix_micros("p_t")) / span).otherwise(F.lit(0.0))


def or_fail(good, value, message: str):
    """``value`` where ``good`` holds; a row where it does not ends the job with the message."""
    return F.when(good, value).otherwise(F.raise_error(F.lit(message)))


def interpolate(frames: DataFrame, track: DataFrame, by: str, values: list[str], clamp: bool = False, strict: bool = False) -> DataFrame:
    """Linear values at the frames' times. Outside the track: dropped, with clamp the nearest end, with strict an error."""
    b = bracketed(frames, track, by, values)
    r = fraction()
    inside = {c: F.col(f"p_{c}") + (F.col(f"n_{c}") - F.col(f"p_{c}")) * r for c in values}
    if clamp:
        return b.where("p_t is not null or n_t is not null").select(*frames.columns, *[F.coalesce(inside[c], f"p_{c}", f"n_{c}").alias(c) for c in values])
    known = F.col("p_t").isNotNull() & F.col("n_t").isNotNull()
    if strict:
        return b.select(*frames.columns, *[or_fail(known, inside[c], "a requested time is outside the track").alias(c) for c in values])
    return b.where(known).select(*frames.columns, *[inside[c].alias(c) for c in values])


def at_offset(requests: DataFrame, track: DataFrame, by: str, values: list[str], strict: bool = True) -> DataFrame:
    """requests (by, seconds) with ts and the interpolated values at that many seconds after the key's first row.

    A negative offset, one beyond the track's length and a key without a track fail, or
    without strict are dropped.
    """
    starts = track.groupBy(by).agg(F.min("ts").alias("_start"))
    placed = requests.join(starts, by, "left")
    ts = F.timestamp_micros(F.unix_micros("_start") + F.round(F.col("seconds") * 1e6).cast("long"))
    if strict:
        ts = or_fail(F.col("_start").isNotNull(), ts, "a requested key has no track")
    else:
        placed = placed.where(F.col("_start").isNotNull())
    return interpolate(placed.withColumn("ts", ts).drop("_start"), track, by, values, strict=strict)


def at_index(requests: DataFrame, track: DataFrame, by: str, strict: bool = True) -> DataFrame:
    """requests (by, place) with the track's row of that place in time, from 0, or from -1 backwards; places beyond fail, or without strict are dropped."""
    order = Window.partitionBy(by).orderBy("ts")
    rows = track.withColumn("_i", F.row_number().over(order).cast("long") - 1)
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    wanted = requests.join(sizes, by, "left").withColumn("_i", F.when(F.col("place") < 0, F.col("_n") + F.col("place")).otherwise(F.col("place")).cast("long"))
    good = F.col("_n").isNotNull() & (F.col("_i") >= 0) & (F.col("_i") < F.col("_n"))
    wanted = wanted.withColumn("_i", or_fail(good, F.col("_i"), "a requested place is outside the track")) if strict else wanted.where(good)
    return wanted.drop("_n").join(rows, [by, "_i"]).drop("_i")


def headed(track: DataFrame, by: str, lagged: bool = False) -> DataFrame:
    """track with qz, qw of its heading: along the step from the row before; the first row takes the second's.

    lagged: along the step between the two rows before; the first two rows stay zero.
    """
    w = Window.partitionBy(by).orderBy("ts")
    if lagged:
        z, q = yaw_quaternion(F.lag("easting", 1).over(w) - F.lag("easting", 2).over(w), F.lag("northing", 1).over(w) - F.lag("northing", 2).over(w))
        return track.withColumns({"qz": F.coalesce(z, F.lit(0.0)), "qw": F.coalesce(q, F.lit(0.0))})
    z, q = yaw_quaternion(F.col("easting") - F.lag("easting").over(w), F.col("northing") - F.lag("northing").over(w))
    own = track.withColumns({"_z": z, "_w": q})
    return own.withColumns({"qz": F.coalesce("_z", F.lead("_z").over(w), F.lit(0.0)), "qw": F.coalesce("_w", F.lead("_w").over(w), F.lit(1.0))}).drop("_z", "_w")


def desample(rows: DataFrame, by: str, seconds: float, block: float, strict: bool = False) -> DataFrame:
    """Rows at a lower rate: in blocks of ``block`` s from the first row, targets at each ``seconds`` strictly inside; per target the first row strictly after it.

    A block's first instant is never a target. strict: a key whose own rate, rows by the
    length of its track, is no higher than the wanted one ends the job.
    """
    us = F.unix_micros("ts")
    step, size = round(seconds * 1e6), round(block * 1e6)
    per = max(0, -(-size // step) - 1)
    span = rows.groupBy(by).agg(F.min(us).alias("_s"), F.max(us).alias("_e"), F.count(F.lit(1)).alias("_n"))
    if strict:
        span = span.withColumn("_s", or_fail(F.col("_e") - F.col("_s") < F.col("_n") * step, F.col("_s"), "the wanted rate is not below a track's own"))
    blocks = span.select(by, "_s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_e") - F.col("_s")) / size).cast("long"))).alias("_b"))
    targets = blocks.select(by, F.explode(F.transform(F.sequence(F.lit(1), F.lit(per)), lambda i: F.col("_s") + F.col("_b") * size + i * step)).alias("target")) if per else blocks.select(by, F.col("_s").alias("target")).limit(0)
    both = rows.select(by, us.alias("_t"), F.struct(*rows.columns).alias("_row")).unionByName(targets.select(by, F.col("target").alias("_t"), F.lit(None).alias("_row")), allowMissingColumns=True)
    # at equal times the target comes after the row, so that only later rows follow it
    ahead = Window.partitionBy(by).orderBy(F.desc("_t"), F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_next", F.last("_row", ignorenulls=True).over(ahead)).where("_row is null and _next is not null")
    return hit.select(F.timestamp_micros("_t").alias("target"), "_next.*")


def time_range(rows: DataFrame, by: str, start: str, stop: str, look_back: float = 0.25) -> DataFrame:
    """Rows from start to stop; where the key's rows reach back ``look_back`` seconds before start, from there."""
    first, probe = F.unix_micros(F.lit(start).cast("timestamp")), F.unix_micros(F.lit(start).cast("timestamp")) - round(look_back * 1e6)
    us = F.unix_micros("ts")
    inside = rows.where((us >= probe) & (us <= F.unix_micros(F.lit(stop).cast("timestamp"))))
    reaching = rows.where(us <= probe).select(by).distinct().withColumn("_reaches", F.lit(True))
    return inside.join(reaching, by, "left").where((us >= first) | F.col("_reaches")).drop("_reaches")


def selected(rows: DataFrame, by: str, hz: float = -1, start: str | None = None, stop: str | None = None, look_back: float = 0.25) -> DataFrame:
    """Rows of a time range at a lower rate, by blocks of a second; hz below 0 keeps all. The rate must be below each key's own."""
    if start is not None or stop is not None:
        rows = time_range(rows, by, start or "0001-01-01", stop or "9999-12-31", look_back)
    if hz == 0:
        raise ValueError("no rate")
    return rows if hz < 0 else desample(rows, by, 1 / hz, 1.0, strict=True).drop("target")


def duration(track: DataFrame, by: str) -> DataFrame:
    return track.groupBy(by).agg(((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6).alias("seconds"), F.count(F.lit(1)).alias("n"))
