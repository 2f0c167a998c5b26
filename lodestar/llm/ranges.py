"""Global order without a global sort task: rows dealt to ranges of an ordered key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BYTES = 32 << 20
#: No more ranges than this; beyond it they get larger, and tasks, which stream through them, longer.
MOST_BUCKETS = 1 << 14


def total_bytes(df: DataFrame, text: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return row.n, row.b or 0


def buckets_of(size: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Ranges for so many bytes."""
    return min(MOST_BUCKETS, max(1, -(-size // bucket_bytes)))


def bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """At most ``buckets - 1`` increasing key values that cut the rows into near-equal ranges."""
    if buckets < 2:
        return []
    cuts = df.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 20 * buckets).alias("c")).first().c
    return sorted(set(cuts or []))


def range_of(key: str, cuts: list[int]) -> Column:
    """Index of the range that holds the key: the number of cuts below it; null keys go to the first.

    Only the key column goes through Python.
    """
    at = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, keys.to_numpy(np.int64), "left").astype(np.int32))

    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(find(F.coalesce(F.col(key), F.lit(0).cast("long")))) if cuts else F.lit(0)
