"""From raw documents to packed training sequences, in five written stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, jaccard, line_runs, packing, weak_labels
from lodestar.llm.queries import WORD_TOKENIZER
from lodestar.llm.scratch import Scratch

NO_WORD = r"^[\x20\x09-\x0D]*$"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier finds good and free of insults; null and blank texts go, null keys do not matter."""
    return weak_labels.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document holds; a document that loses all its words goes.

    Rows with a null key stay as they are; rows of one key are one document. Columns other
    than doc_id, text and n_chars are not touched, whatever their names.
    """
    other = {c: f"in_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = line_runs.dedup_lines(docs.withColumnsRenamed(other))
    left = out.where((F.col("n_dropped") == 0) | ~F.col("kept").rlike(NO_WORD))
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return left.select([(new[c] if c in new else F.col(other.get(c, c))).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each class linked by five-word Jaccard of 0.8 or more.

    Rows with a null key and texts without words stay; rows of one key are one document,
    which stays or goes whole.
    """
    parts = jaccard.jaccard_components(docs, k=5, percent=80, counted=False)
    gone = parts.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Rows with a null key and null texts stay; rows of one key go together. Items with a null
    key or without words match nothing.
    """
    bad = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of what is left, in bins of the permitted lengths; see packing.pack for nulls and repeated rows."""
    return packing.pack(docs, tokenizer_path=WORD_TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("best-fit packing", packed),
]

#: The learned and packing stages have no SQL; tests hold each stage against brute force and run() against their chain.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
