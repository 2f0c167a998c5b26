"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

Fixed masks pick words of each span of text and ignore the rest, so a changed word
at an ignored place does not hide the match. Test and training spans meet on the
masks' hashes; around each meeting the two texts are aligned and compared word by
word. With the default masks no two substitutions in ``window`` = 13 words can hide
a match from both masks at every offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.scratch import Scratch

MASKS = ((0, 3, 4, 6, 7, 8), (0, 1, 2, 3, 7, 8))
WINDOW = 13
AGREE = 11
BROADCAST_ROWS = 200_000


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for a null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def _seeds(rows: DataFrame, masks: list[tuple[int, ...]], keep: list[str]) -> DataFrame:
    """Rows (*keep, at, h): the hash of each mask at each word offset; rows has words."""
    least = min(m[-1] for m in masks) + 1
    at = rows.where(F.size("words") >= least).select(*keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - least)).alias("at"))
    # a mask that reaches beyond the text has a null word, which would change its hash: it is left out
    hashes = [F.when(F.col("at") + m[-1] < F.size("words"), F.xxhash64(F.lit(",".join(map(str, m))), *[F.get("words", F.col("at") + j) for j in m])) for m in masks]
    return at.select(*keep, "at", F.explode(F.array(*hashes)).alias("h")).where("h is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Rows (key, item, agree, window, start): per document and item its best aligned window.

    A document is contaminated by an item when some WINDOW aligned words agree in
    AGREE places or more; an item of fewer words must occur whole and unchanged.
    start: word offset of the window in the document. Null and empty texts on either
    side match nothing; rows with null keys are ignored; repeated keys are one
    document (its best window counts). Other columns are ignored.

    The seeds of the benchmark are broadcast only where they number at most
    BROADCAST_ROWS; else the join is shuffled.
    """
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    items = scratch.keep(benchmark.select(F.col(item).cast("long").alias("item"), normal_words(F.col(item_text)).alias("words")).where("item is not null and size(words) > 0").distinct(), "items")
    span = max(m[-1] for m in MASKS) + 1
    short = [r.n for r in items.where(F.size("words") < span).select(F.size("words").alias("n")).distinct().collect()]  # fewer than span values
    masks = [*MASKS, *[tuple(range(n)) for n in short]]
    tests = _seeds(items, masks, ["item"]).select("h", "item", F.col("at").alias("item_at"))
    tests = scratch.keep(tests, "seeds")
    small = tests.count() <= BROADCAST_ROWS
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("row"), F.col(text).alias("text")).where("key is not null")
    found = _seeds(rows.select("key", "row", normal_words(F.col("text")).alias("words")), masks, ["key", "row"]).join(F.broadcast(tests) if small else tests, "h")
    hits = scratch.keep(found.select("key", "row", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits")
    named = hits.select("key", "row").distinct()
    texts = rows.join(named, ["key", "row"], "left_semi").dropDuplicates(["key", "row"]).select("key", "row", normal_words(F.col("text")).alias("a"))
    aligned = hits.join(texts, ["key", "row"]).join(items.withColumnRenamed("words", "b"), "item")
    m = F.size("b")
    width = F.least(m, F.lit(WINDOW))
    same = F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.when((F.col("shift") + j >= 0) & (F.get("a", F.greatest(F.col("shift") + j, F.lit(0))) == F.get("b", j)), 1).otherwise(0))
    aligned = aligned.withColumn("same", same)
    sums = F.transform(F.sequence(F.lit(0), m - width), lambda s: F.struct(F.aggregate(F.slice("same", s + 1, width), F.lit(0), lambda x, y: x + y).alias("agree"), (-s).alias("from")))
    best = aligned.select("key", "item", "shift", width.alias("window"), F.array_max(sums).alias("best"))
    best = best.where(F.col("best.agree") >= F.when(F.col("window") < WINDOW, F.col("window")).otherwise(AGREE))
    top = best.groupBy("key", "item").agg(F.max(F.struct("best.agree", (-(F.col("shift") - F.col("best.from"))).alias("from"), "window")).alias("t"))
    return top.select(F.col("key").alias(key), F.col("item").alias(item), F.col("t.agree").alias("agree"), F.col("t.window").alias("window"), (-F.col("t.from")).alias("start"))
