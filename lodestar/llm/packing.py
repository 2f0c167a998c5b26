"""Variable-capacity best-fit packing of token sequences."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.scratch import Scratch
from lodestar.llm.token_files import text_encoder
from lodestar.llm.words import chunks, release, texts, tidy

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_ROWS = 20_000
#: Pieces of words that a worker keeps while it counts tokens; they stay in its memory.
PIECES = 100_000
#: Equal rows travel together, at most so many.
COPIES = 1024
#: Tokens that a bin costs beside its capacity, and how much dearer a token of the longest bins is than one of very short bins.
OVERHEAD, LONG = 2.0, 0.01


def word_count(text: Column) -> Column:
    """Words of a text and one end token: at least 1."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")) + 1


def bin_cost(capacity: int, largest: int, overhead: float = OVERHEAD, long: float = LONG) -> float:
    """What a bin costs, in tokens of a very short bin: attention makes the tokens of long bins dearer."""
    return capacity * (1 + long * capacity / largest) + overhead


def best_fit(sizes: Sequence[int], capacities: Sequence[int], overhead: float = OVERHEAD, long: float = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, none above the largest capacity, and each bin's capacity.

    Sizes come largest first, equal ones in their order; each goes into the open bin that
    it leaves the least room, and bins stay open to the end. Where none has room, a bin is
    opened: for each permitted capacity it is filled, in thought, with the sizes that no bin
    counts on yet, always the one that fits the room best; the capacity that costs least for
    each token is opened, and the bin counts on those sizes, so that no two count on the same
    ones. What comes may differ, as every size takes the tightest room. At last each bin
    shrinks to the smallest capacity that holds its contents. With one capacity this is
    best-fit decreasing.
    """
    capacities = sorted(capacities)
    largest = capacities[-1]
    costs = {c: bin_cost(c, largest, overhead, long) for c in capacities}
    free, counted_on = Counter(sizes), Counter()
    left = sum(1 << s for s in free)  # bit s is set while a size s is free

    def take(s: int) -> None:
        nonlocal left
        free[s] -= 1
        if not free[s]:
            left ^= 1 << s

    def filled(room: int) -> list[int]:
        rest, used, taken = left, Counter(), []
        while room > 0:
            s = (rest & ((2 << room) - 1)).bit_length() - 1
            if s < 1:
                break
            taken.append(s)
            room -= s
            used[s] += 1
            if used[s] == free[s]:
                rest ^= 1 << s
        return taken

    def opened(first: int) -> tuple[int, list[int]]:
        best = None
        for c in capacities[bisect_left(capacities, first) :]:
            taken = filled(c - first)
            held = first + sum(taken)
            fit = capacities[bisect_left(capacities, held)]
            if best is None or costs[fit] / held < best[0]:
                best = costs[fit] / held, fit, taken
        return best[1:]

    bins, offsets, held = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    rooms: dict[int, list[int]] = defaultdict(list)
    some = 0  # bit r is set while an open bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        if counted_on[s]:
            counted_on[s] -= 1
        else:
            take(s)
        fits = some >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            to = rooms[room].pop()
            if not rooms[room]:
                some ^= 1 << room
        else:
            room, taken = opened(s)
            for x in taken:
                take(x)
                counted_on[x] += 1
            to = len(held)
            held.append(0)
        bins[i], offsets[i] = to, held[to]
        held[to] += s
        room -= s
        if room:
            some |= 1 << room
            rooms[room].append(to)
    return bins, offsets, np.array([capacities[bisect_left(capacities, h)] for h in held], np.int64)


def token_lengths(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n): the tokens of each whole text and one end token. A null text counts as empty."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_encoder(tokenizer_path, PIECES)
        release()  # what reading its file took
        for batch in batches:
            column = batch.column("text")
            _, offsets = texts(column)
            for lo, hi in chunks(offsets, 4 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), pa.array(coder.counts(column.slice(lo, hi - lo)) + 1, pa.int64())], ["key", "n"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "key long, n long")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: Column | None = None, capacities: Sequence[int] = CAPACITIES, shard_rows: int = SHARD_ROWS, tokenizer_path: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Rows (key, piece, start, n_tokens, bin, capacity, offset): tokens start to start + n_tokens of a
    document stand at offset in a bin.

    tokenizer_path: a file of the tokenizers library; a document's tokens are those of its
    whole text and an end token. Without it, length gives them, by default words and an end
    token; a null or less than 1 counts as 1. A document beyond the largest capacity is cut
    into pieces of that capacity and a rest, so no token is lost. Null and empty texts are
    one end token. Rows are dealt to shards of about ``shard_rows`` by a hash of key, length
    and number among equal ones, so that neither order nor partitions matter; each shard is
    packed by itself and leaves a few bins part full, a loss that does not grow. Null and
    repeated keys are packed like others; other columns are ignored; an empty table gives no
    rows. bin: unique over the table, shard * 2**32 + number.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    largest = max(capacities)
    lengths = token_lengths(docs, tokenizer_path, key, text) if tokenizer_path else docs.select(F.col(key).cast("long").alias("key"), (word_count(F.col(text)) if length is None else length).cast("long").alias("n"))
    lengths = lengths.select("key", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).cast("long").alias("n"))
    # rows of one key and length differ in nothing: their number is counted before they are dealt
    counted = scratch.keep(lengths.groupBy("key", "n").agg(F.count(F.lit(1)).alias("copies")), "lengths")
    shards = max(1, -(-(counted.agg(F.sum("copies")).first()[0] or 0) // shard_rows))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    parts = parts.withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("part") * COPIES))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("key", "n", "part"), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        copies = np.asarray(table.column("copies"))
        keys = table.column("key").combine_chunks().take(pa.array(np.repeat(np.arange(len(copies)), copies)))
        n = np.repeat(np.asarray(table.column("n")), copies)
        pieces = -(-n // largest)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(n[row] - piece * largest, largest)
        null, values = np.asarray(keys.is_null()), np.asarray(keys.fill_null(0))
        order = np.lexsort((piece, values[row], ~null[row], -size))
        bins, offsets, capacity = best_fit(size[order].tolist(), capacities)
        return pa.table({
            "key": keys.take(pa.array(row[order])), "piece": pa.array(piece[order], pa.int64()), "start": pa.array(piece[order] * largest, pa.int64()), "n_tokens": pa.array(size[order], pa.int64()),
            "bin": pa.array((shard << 32) + bins, pa.int64()), "capacity": pa.array(capacity[bins], pa.int64()), "offset": pa.array(offsets, pa.int64()),
        })

    out = dealt.select("key", "n", "copies", "shard").groupBy("shard").applyInArrow(run, "key long, piece long, start long, n_tokens long, bin long, capacity long, offset long")
    return out.withColumnRenamed("key", key)
