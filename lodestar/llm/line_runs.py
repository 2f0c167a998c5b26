"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions alone.

A run is a table of line hashes bucketed and sorted by hash, so that a later batch
merges with it without moving or sorting it again. Each batch anti-joins all runs,
then adds its new hashes as a run of level 0; where a level holds ``fanout`` runs
they merge into one run of the next level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.scratch import Scratch

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_ = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """The runs of one collection: tables of (h1, h2) in the shared folder."""

    def __init__(self, scratch: Scratch, buckets: int, fanout: int = 3):
        self.scratch, self.buckets, self.fanout = scratch, buckets, fanout
        self.spark, self.levels, self.prefix = scratch.spark, {}, f"line_runs_{uuid.uuid4().hex[:12]}"
        self.made = 0

    def _write(self, hashes: DataFrame, level: int) -> None:
        name = f"{self.prefix}_{level}_{self.made}"
        self.made += 1
        dealt = hashes.select("h1", "h2").repartition(self.buckets, "h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.scratch.root}/{name}").saveAsTable(name)
        self.levels.setdefault(level, []).append(name)

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """Rows whose hash stands in no run."""
        for names in self.levels.values():
            for name in names:
                hashes = hashes.join(self.spark.table(name).hint("merge"), ["h1", "h2"], "left_anti")
        return hashes

    def add(self, hashes: DataFrame) -> None:
        """Distinct hashes that no run holds become a run; full levels merge upwards."""
        self._write(hashes, 0)
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            old = self.levels.pop(level)
            merged = self.spark.table(old[0])
            for name in old[1:]:
                merged = merged.union(self.spark.table(name))
            self._write(merged, level + 1)
            self._forget(old)
            level += 1

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.scratch.drop(name)

    def close(self) -> None:
        for names in self.levels.values():
            self._forget(names)
        self.levels = {}


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10, batches: int = 4, buckets: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """All columns of ``docs`` and n_lines, n_dropped (long), kept (the text without dropped lines).

    Texts split at newlines; a null text is one empty line. Lines whose key (see
    line_key) has ``least`` code points or more and stands in two documents or more
    stay in the document of the smallest key only. The documents come in ``batches``
    ranges of the key, in ascending order, each against the runs of those before.
    Rows of one key are one document; rows with a null key keep all lines and claim
    none. An empty table gives no rows; columns of ``docs`` named like the added
    ones, or _key, _text, _row, _lines or _gone, are replaced or dropped.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = F.split(F.coalesce(F.col("_text"), F.lit("")), "\n", -1)
    base = docs.drop(*[c for c in ("n_lines", "n_dropped", "kept") if c not in (key, text)])
    base = base.withColumn("_key", F.col(key).cast("long")).withColumn("_text", F.col(text)).withColumn("_row", F.xxhash64("_text"))
    lines = base.where("_key is not null").select("_key", "_row", F.posexplode(split).alias("pos", "line")).withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= least)
    lines = scratch.keep(lines.select("_key", "_row", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2")), "lines")

    cuts = lines.agg(F.percentile_approx("_key", [i / batches for i in range(1, batches)], 1000).alias("c")).first().c if batches > 1 else []
    cuts = sorted(set(cuts or []))
    runs, parts = LineRuns(scratch, buckets), []
    try:
        for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
            batch = lines
            if low is not None:
                batch = batch.where(F.col("_key") > low)
            if high is not None:
                batch = batch.where(F.col("_key") <= high)
            firsts = batch.groupBy("h1", "h2").agg(F.min("_key").alias("_key"))
            fresh = scratch.keep(runs.unseen(firsts), f"fresh-{i}")
            # only the first holder of a fresh hash keeps the line; the key in the join spreads a frequent line
            parts.append(scratch.keep(batch.join(fresh, ["h1", "h2", "_key"], "left_anti").select("_key", "_row", "pos"), f"drops-{i}"))
            runs.add(fresh)
            scratch.drop(f"fresh-{i}")
    finally:
        runs.close()
    drops = parts[0]
    for part in parts[1:]:
        drops = drops.union(part)
    gone = drops.groupBy("_key", "_row").agg(F.collect_set("pos").alias("_gone"))
    both = base.withColumn("_lines", split).join(gone, ["_key", "_row"], "left").drop("_row")
    n = F.size("_lines")
    left = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), "_gone"), lambda i: F.get("_lines", i))
    kept = F.when(F.col("_gone").isNull(), F.coalesce(F.col("_text"), F.lit(""))).otherwise(F.array_join(left, "\n"))
    out = both.withColumns({"n_lines": n.cast("long"), "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"), "kept": kept})
    return out.drop("_key", "_text", "_lines", "_gone")
