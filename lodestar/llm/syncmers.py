"""Document fingerprints from closed syncmers.

A k-mer of code points is chosen when the smallest hash among its inner s-mers
stands at its first or last place. The choice depends on the k-mer alone, so two
texts choose the same anchors wherever they share k characters, at any offset. A
fingerprint lists the anchors of least hash in the order in which the text has them, and
two fingerprints are matched by position: only anchors that both have in one order count,
so passages that change places are no likeness, and what is inserted or cut moves nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.ranges import BUCKET_BYTES, bounds, buckets_of, range_of, total_bytes
from lodestar.llm.words import mix, windows

K, S, SIZE = 16, 5, 128
_CHUNK = 1 << 18


def _joined(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in many], np.int64)
    data = np.frombuffer("".join(many).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate(([0], np.cumsum(lengths)))


def anchors(many: list[str], k: int = K, s: int = S) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions in code points) of each text's closed syncmers.

    A text without a closed syncmer, as every one of 1 to k - 1 code points, has one
    anchor, the whole of it; an empty one none.
    """
    data, offsets = _joined(many)
    n = len(data)
    chosen, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n >= k:
        units = mix(data.astype(np.uint64) + np.uint64(1))
        small = windows(units, np.arange(n - s + 1), np.arange(s, n + 1))
        span, low, width = k - s + 1, small, 1
        while width < span:  # sliding minimum by doubling
            step = min(width, span - width)
            low, width = np.minimum(low[:-step], low[step:]), width + step
        at = np.arange(n - k + 1)
        fits = np.repeat(offsets[1:], np.diff(offsets))[: len(at)] >= at + k
        chosen = np.flatnonzero(fits & ((small[: len(at)] == low) | (small[span - 1 :][: len(at)] == low)))
        hashes = windows(units, chosen, chosen + k)
    cut = np.searchsorted(chosen, offsets)
    for i in range(len(many)):
        lo, hi = offsets[i], offsets[i + 1]
        if hi > lo and cut[i] == cut[i + 1]:
            yield windows(mix(data[lo:hi].astype(np.uint64) + np.uint64(1)), np.array([0]), np.array([hi - lo])), np.zeros(1, np.int64)
        else:
            yield hashes[cut[i] : cut[i + 1]], chosen[cut[i] : cut[i + 1]] - lo


def sketch(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The ``size`` smallest distinct anchor hashes, 32 bits of each, in the order of their first places."""
    top = (hashes >> np.uint64(32)).astype(np.uint32)
    if len(top) > 4 * size:
        some = top[top <= np.partition(top, 2 * size)[2 * size]]
        top = some if len(np.unique(some)) >= size else top
    values, first = np.unique(top, return_index=True)
    return values[:size][np.argsort(first[:size], kind="stable")]


def sketches(many: list[str], k: int = K, s: int = S, size: int = SIZE) -> Iterator[np.ndarray]:
    """The sketch of each text."""
    lo = 0
    while lo < len(many):
        hi, total = lo, 0
        while hi < len(many) and (hi == lo or total + len(many[hi]) <= _CHUNK):
            total += len(many[hi])
            hi += 1
        for hashes, _ in anchors(many[lo:hi], k, s):
            yield sketch(hashes, size)
        lo = hi


def as_text(own: np.ndarray) -> str:
    return own.astype(">u4").tobytes().hex()


def in_order(places: list[int]) -> int:
    """Length of the longest increasing subsequence of different numbers."""
    ends: list[int] = []
    for x in places:
        at = bisect_left(ends, x)
        ends[at : at + 1] = [x]
    return len(ends)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of the smallest hashes of both sketches that both have in one order; two empty ones are alike, one empty is unlike.

    An estimate of the anchors' Jaccard likeness, less those whose passages have changed places.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:size]
    shared, in_a, in_b = np.intersect1d(a, b, True, return_indices=True)
    known = shared <= both[-1]
    return in_order(in_b[known][np.argsort(in_a[known])].tolist()) / len(both)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """Rows of ``key``, fingerprint string (hex of the sketch, in text order), and every anchor as arrays hashes, positions.

    A null text counts as empty: an empty fingerprint and no anchors. Null and
    repeated keys are kept as they are. Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            many = [t or "" for t in batch.column("text").to_pylist()]
            got = [x for t in many for x in anchors([t], k, s)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([as_text(sketch(h, size)) for h, _ in got], pa.string()), pa.array([h.view(np.int64) for h, _ in got], pa.list_(pa.int64())), pa.array([p for _, p in got], pa.list_(pa.int64()))],
                ["key", "fingerprint", "hashes", "positions"],
            )

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, fingerprint string, hashes array<long>, positions array<long>").withColumnRenamed("key", key)


def in_sequence(docs: DataFrame, key: str, text: str, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows (bucket, head, key, text) dealt to key ranges, each sorted by descending key.

    After the rows of a bucket comes, with head true, the row that follows its last
    one: the first of the next bucket, or of the whole table after the last bucket.
    The heads are one row a bucket; their keys are broadcast, their texts never gathered.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n, size = total_bytes(docs, text)
    cuts = bounds(rows, "key", buckets_of(size, bucket_bytes))
    dealt = rows.withColumn("bucket", F.lit(len(cuts)) - range_of("key", cuts))  # bucket 0 has the largest keys; nulls stand last
    firsts = sorted((r.bucket, r.first) for r in dealt.groupBy("bucket").agg(F.max("key").alias("first")).collect())  # one row a bucket
    follows = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(follows, "key long, to int")
    found = rows.join(F.broadcast(heads), rows["key"].eqNullSafe(heads["key"])).groupBy(rows["key"], "to").agg(F.max("text").alias("text"))
    found = found.select("key", "text", F.col("to").alias("bucket"), F.lit(True).alias("head"))
    both = dealt.withColumn("head", F.lit(False)).unionByName(found)
    return both.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "head", F.desc_nulls_last("key"), F.desc("text"))


def edited_text(text: str, following: str) -> str:
    """The last floor(n / 2) code points give way to the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, s: int = S, size: int = SIZE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Fingerprints of each text and of its edit with the next text, and their likeness.

    Next is the following row by descending key (ties: by descending text, nulls
    last), after the last row the first. A null text counts as empty. A row alone
    in its table is its own next. An empty table gives no rows.
    """
    import hashlib

    def finish(rows: list[tuple], following: tuple) -> pa.RecordBatch:
        keys = [r[0] for r in rows]
        olds = [r[1] for r in rows]
        nexts = [*olds[1:], following[1]]
        edits = [edited_text(a, b) for a, b in zip(olds, nexts, strict=True)]
        plain = list(sketches([*olds, following[1]], k, s, size))
        changed = list(sketches(edits, k, s, size))
        cols = {
            "key": pa.array(keys, pa.int64()), "n_chars": pa.array([len(t) for t in olds], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edits],
            "fingerprint": [as_text(x) for x in plain[:-1]], "edited_fingerprint": [as_text(x) for x in changed],
            "near_edited": pa.array([likeness(a, b, size) for a, b in zip(plain, changed, strict=False)], pa.float64()),
            "near_next": pa.array([likeness(a, b, size) for a, b in zip(plain, plain[1:], strict=False)], pa.float64()),
        }
        return pa.RecordBatch.from_pydict(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size_held = 0
        for batch in batches:
            for row_key, row_text, head in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("head").to_pylist(), strict=True):
                row = (row_key, row_text.as_py())
                if head:
                    yield finish(held, row)
                    held, size_held = [], 0
                    continue
                held.append(row)
                size_held += len(row[1])
                if size_held > 1 << 20:
                    last = held.pop()
                    if held:
                        yield finish(held, last)
                    held, size_held = [last], len(last[1])
        assert not held, "a bucket without its following row"

    out = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_sequence(docs, key, text, bucket_bytes).select("key", "text", "head").mapInArrow(run, out).withColumnRenamed("key", key)
