"""Streams of frames and positions, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions.exprs import utm
from lodestar.operators.placemap import PlaceMap
from lodestar.sources import images


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def run_once(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """What is available now, in micro-batches, through ``each``; a restart goes on from the checkpoint."""
    df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(features: DataFrame, target: PlaceMap, checkpoint: str, source: str = "stream") -> None:
    """Feature batches into a map, each against the map committed before it; a batch that comes again changes nothing.

    source names the stream: batch numbers are its checkpoint's own.
    """
    run_once(features, lambda batch, number: target.add(batch, batch=number, source=source), checkpoint)


def localize(queries: DataFrame, target: PlaceMap, out: str, checkpoint: str, n: int = 5) -> None:
    """Answers a stream of query images (image_id, kp_ind, bits): (query_id, rank, image_id, score, metadata) below ``out``.

    All requests of a batch are one plan. A batch has a folder of its own, which a repeated batch writes again.
    """
    run_once(queries, lambda batch, number: target.query(batch, n, described=True).write.mode("overwrite").parquet(f"{out}/batch={number}"), checkpoint)


def write_frames(frames: DataFrame, folder: str, checkpoint: str, log: str | None = None) -> None:
    """A stream of encoded frames (name, content) to one file each; ``log`` gets (name, bytes) of each batch.

    A batch that comes again writes the same files and the same folder of the log.
    """
    log = log or f"{folder.rstrip('/')}-log"
    run_once(frames, lambda batch, number: images.write_files(batch, folder).write.mode("overwrite").parquet(f"{log}/batch={number}"), checkpoint)


def utm_stream(fixes: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Stateless projection of GNSS fixes."""
    zone, easting, northing = utm(F.col(lat), F.col(lon))
    return fixes.withColumns({"zone": zone, "easting": easting, "northing": northing})


def latest_positions(positions: DataFrame, by: str, values: tuple[str, ...] = ("easting", "northing")) -> DataFrame:
    """Last position of each key by event time, for update mode: one row of state a key, which late rows do not move back."""
    return positions.groupBy(by).agg(F.max(F.struct("ts", *values)).alias("last")).select(by, "last.*")


def with_latest_position(frames: DataFrame, positions: DataFrame, by: str, values: tuple[str, ...] = ("easting", "northing")) -> DataFrame:
    """frames (by, ts, image_id) with position_ts and the values of the last position known for their key, by event time.

    Known are the positions of earlier batches, of which the latest is the state, and those
    of the same batch up to the frame's own time. Frames before any position get nulls. A
    late position changes nothing that a later one has set. Rows with a null key or time
    are left out.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    types = {f.name: f.dataType.simpleString() for f in [*frames.schema, *positions.schema]}
    state = f"ts timestamp, {', '.join(f'{v} double' for v in values)}"
    out = f"{by} {types[by]}, ts timestamp, image_id {types['image_id']}, position_ts timestamp, {', '.join(f'{v} double' for v in values)}"
    cast = [F.col(v).cast("double").alias(v) for v in values]
    both = frames.select(by, "ts", "image_id", *[F.lit(None).cast("double").alias(v) for v in values], F.lit(True).alias("is_frame")).unionByName(
        positions.select(by, "ts", F.lit(None).cast(types["image_id"]).alias("image_id"), *cast, F.lit(False).alias("is_frame"))
    )

    def follow(key, batches, group: GroupState):
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "is_frame"], kind="stable")  # at equal times the position comes first
        last = group.get if group.exists else None
        found = []
        for row in rows.itertuples(index=False):
            if row.is_frame:
                found.append((key[0], row.ts, row.image_id, *(last or (None,) * (1 + len(values)))))
            elif last is None or row.ts >= pd.Timestamp(last[0]):
                last = (row.ts.to_pydatetime(), *(float(getattr(row, v)) for v in values))
        if last is not None:
            group.update(last)
        yield pd.DataFrame(found, columns=[by, "ts", "image_id", "position_ts", *values])

    return both.where(F.col(by).isNotNull() & F.col("ts").isNotNull()).groupBy(by).applyInPandasWithState(follow, out, state, "append", GroupStateTimeout.NoTimeout)


def to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
