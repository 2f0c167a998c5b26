"""Weighted rendezvous sharding of stable keys, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.scratch import Scratch


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard with the least ``-ln(u) / weight``, u in (0, 1) drawn from the key and the shard alone.

    A shard wins a share of keys in proportion to its weight. A shard that is added
    or grows takes keys only into itself; one that leaves loses only its own.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("at least one shard, and only positive weights")
    name = F.coalesce(key.cast("string"), F.lit(""))
    scores = []
    for shard, weight in sorted(weights.items()):
        drawn = F.conv(F.substring(F.md5(F.concat(name, F.lit(f"|{shard}")).cast("binary")), 1, 12), 16, 10).cast("double")
        scores.append(F.struct((-F.log((drawn + 0.5) / float(1 << 48)) / float(weight)).alias("score"), F.lit(int(shard)).alias("shard")))
    return (F.array_min(F.array(*scores)) if len(scores) > 1 else scores[0])["shard"]


def sharded(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Rows (key, size, text_crc32, law, shard, slot, grown_shard).

    Law `key`: key and shards alone decide the shard. size: UTF-8 bytes of the text
    plus 1. slot: place in the shard, gapless from 0, by ascending key. A null text
    counts as empty (size 1, crc 0); null keys share one place in the hash and come
    first; repeated keys share a shard and have slots of their own. Other columns
    are ignored; an empty table gives no rows.

    Slots come from ranges of the key: a window inside each (shard, range), and the
    ranges' counts summed before it, so that no shard is sorted in one task.
    """
    scratch = scratch or Scratch(docs.sparkSession, "sharding")
    body = F.coalesce(F.col(text), F.lit(""))
    id_ = F.col(key).cast("long")
    rows = docs.select(
        id_.alias("key"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous(id_, weights).alias("shard"), (rendezvous(id_, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    placed = scratch.keep(rows.repartitionByRange(F.col("key")).withColumn("range", F.spark_partition_id()), "placed")
    counts = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))  # one row a shard and partition
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "range").orderBy(F.asc_nulls_first("key"), "text_crc32", "size"))
    out = placed.withColumn("inside", inside).join(before, ["shard", "range"])
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"), "grown_shard")
