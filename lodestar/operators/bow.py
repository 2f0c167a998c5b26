"""Inverted-index retrieval and maintenance: words, postings, TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def term_frequency(matches: DataFrame, features: int, word: str = "word") -> DataFrame:
    """(word, nwi, tf): matches of each word over all query features, matched or not."""
    return matches.groupBy(word).agg(F.count(F.lit(1)).alias("nwi")).withColumn("tf", F.col("nwi") / F.lit(features))


def document_frequency(postings: DataFrame, images: int, word: str = "word") -> DataFrame:
    """(word, df, idf): distinct images of each word, ln(images / df)."""
    return postings.select(word, "image_id").distinct().groupBy(word).agg(F.count("image_id").alias("df")).withColumn("idf", F.log(F.lit(float(images)) / F.col("df")))


def tfidf_search(matches: DataFrame, postings: DataFrame, features: int, images: int, word: str = "word") -> DataFrame:
    """(image_id, score) of every image that shares a word: sum of nwi**2 / features * idf * postings of the word there.

    Postings are cut to the query's words before anything is counted.
    """
    tf = term_frequency(matches, features, word)
    own = postings.join(tf.select(word), word, "left_semi")
    counts = own.groupBy(word, "image_id").agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy(word).agg(F.count(F.lit(1)).alias("df"))
    joined = counts.join(df, word).join(tf, word)
    score = F.sum(F.col("nwi") * F.col("tf") * F.log(F.lit(float(images)) / F.col("df")) * F.col("n"))
    return joined.groupBy("image_id").agg(score.alias("score"))


def top_images(scores: DataFrame, n: int = 5) -> DataFrame:
    """The n best, by descending score and then image id."""
    return scores.orderBy(F.desc("score"), "image_id").limit(n)


def tfidf_of_many(matches: DataFrame, postings: DataFrame, sizes: DataFrame, images: int, word: str = "word") -> DataFrame:
    """(query_id, image_id, score): tfidf_search for each query of matches (query_id, word); sizes (query_id, features) counts matched and unmatched ones.

    Postings are counted once for all queries.
    """
    tf = matches.groupBy("query_id", word).agg(F.count(F.lit(1)).alias("nwi")).join(sizes, "query_id").withColumn("tf", F.col("nwi") / F.col("features"))
    counts = postings.join(matches.select(word).distinct(), word, "left_semi").groupBy(word, "image_id").agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy(word).agg(F.count(F.lit(1)).alias("df"))
    score = F.sum(F.col("nwi") * F.col("tf") * F.log(F.lit(float(images)) / F.col("df")) * F.col("n"))
    return counts.join(df, word).join(tf, word).groupBy("query_id", "image_id").agg(score.alias("score"))


def top_of_many(scores: DataFrame, n: int = 5, places: int = 9) -> DataFrame:
    """(query_id, rank, image_id, score): the n best of each query, by descending score of ``places`` places and then image id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", places)), "image_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "rank", "image_id", "score")


def point_matches(matches: DataFrame, postings: DataFrame, word: str = "word_id") -> DataFrame:
    """(image_id, points): per image the pairs of query point and stored point of matched words."""
    joined = matches.join(postings, word)
    return joined.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("query_kp", "kp_ind"))).alias("points"))


def new_words(features: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Features without a match become words."""
    return features.join(matches.select(*keys).distinct(), keys, "left_anti")


def numbered(new: DataFrame, order: list[str], after: int) -> DataFrame:
    """Word ids from ``after``, gapless: a count of each partition of an ordered copy comes before it."""
    sized = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    counts = sized.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = sized.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return inner.join(F.broadcast(before), "_p").withColumn("word_id", (F.lit(after) + F.col("_b") + F.col("_i") - 1).cast("long")).drop("_p", "_b", "_i", "_n")


def posting_update(postings: DataFrame, matches: DataFrame, word: str = "word_id") -> DataFrame:
    """Matched features become postings of their words."""
    return postings.unionByName(matches.select(*postings.columns))


def purge(postings: DataFrame, images: DataFrame, least: int = 3, word: str = "word") -> DataFrame:
    """(word, first_image): words that stay.

    A word is judged once, at the first image ingested whose id exceeds its own first
    image's by more than one; it stays with ``least`` postings by then. Words not yet
    judged stay.
    """
    judged = judging_images(images)
    firsts = postings.groupBy(word).agg(F.min("image_id").alias("first_image"))
    kept = firsts.join(judged, "first_image", "left")
    counts = postings.join(kept, word).groupBy(word, "first_image", "judged").agg(F.count(F.when(F.col("image_id") <= F.col("judged"), 1)).alias("n"))
    return counts.where(F.col("judged").isNull() | (F.col("n") >= least)).select(word, "first_image")


def judging_images(images: DataFrame, span: int = 1 << 20) -> DataFrame:
    """(first_image, judged): for each image id the least other one that exceeds it by more than one, null for the last.

    It is the next id, or the one after where the next follows at once: leads within ranges
    of ``span`` ids, and the two least ids of the ranges after, one row for each range.
    """
    ids = images.where("image_id is not null").select(F.col("image_id").cast("long").alias("first_image")).distinct().withColumn("_r", F.floor(F.col("first_image") / span))
    inside = Window.partitionBy("_r").orderBy("first_image")
    near = ids.withColumns({f"_n{i}": F.lead("first_image", i).over(inside) for i in (1, 2)})
    ranges = near.groupBy("_r").agg(F.min("first_image").alias("_a"), F.min("_n1").alias("_b"))
    order = Window.orderBy("_r")
    after = ranges.select("_r", F.lead("_a").over(order).alias("_f1"), F.coalesce(F.lead("_b").over(order), F.lead("_a", 2).over(order)).alias("_f2"))
    one = F.coalesce("_n1", "_f1")
    two = F.when(F.col("_n2").isNotNull(), F.col("_n2")).when(F.col("_n1").isNotNull(), F.col("_f1")).otherwise(F.col("_f2"))
    return near.join(after, "_r").select("first_image", F.when(one > F.col("first_image") + 1, one).otherwise(two).alias("judged"))


def without_words(rows: DataFrame, gone: DataFrame, word: str = "word_id") -> DataFrame:
    """Words or postings less those of deleted words."""
    return rows.join(gone.select(word), word, "left_anti")


def integrity(words: DataFrame, postings: DataFrame, word: str = "word") -> DataFrame:
    """Words without a posting."""
    return words.join(postings, word, "left_anti")
