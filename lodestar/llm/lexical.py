"""Ranked lexical search by MaxScore over an inverted index in shards.

A shard is a run of some megabytes of text with its own posting lists; shards need no
shuffle. A term's list has an upper bound, its largest contribution to a score in the
shard. With the score that a document must reach known, an item's terms split in two:
those of the lowest bounds, which together cannot reach it, are non-essential. Only
lists of the others bring candidates; the rest are probed for candidates from the
highest bound on, while a candidate can still qualify.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.scratch import Scratch
from lodestar.llm.words import _TABLES, CHUNK_BYTES, between, chunks, prefix, texts

SHARD_BYTES = 8 << 20
#: Term occurrences of items that are searched together; more items go in further blocks.
BLOCK_TERMS = 1 << 18
_TERM = np.zeros(256, bool)
_TERM[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_NO_KEY = np.iinfo(np.int64).max
_SHARD = "docs long, total long, terms array<long>, dfs array<int>, keys array<long>, lengths array<int>, places binary, tfs binary"


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and where each text's begin and end among them.

    A term is a maximal run of ASCII letters, digits and characters beyond ASCII; A-Z alone are lower-cased.
    """
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return between(prefix(_TABLES[True][data]), starts, ends), np.searchsorted(starts, offsets)


class _Shard:
    """Texts gathered until they fill a shard; only terms of the vocabulary, if there is one, are kept."""

    def __init__(self, vocabulary: np.ndarray | None):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.found, self.places, self.keys, self.lengths, self.size = [], [], [], [], 0

    def add(self, data: np.ndarray, offsets: np.ndarray, keys: list) -> None:
        hashes, first = term_hashes(data, offsets)
        counts = np.diff(first)
        place = np.repeat(np.arange(len(keys), dtype=np.uint32) + np.uint32(len(self.keys)), counts)
        if self.vocabulary is not None:
            at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(len(self.vocabulary) - 1, 0))
            known = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
            hashes, place = at[known], place[known]
        self.found.append(hashes)
        self.places.append(place)
        self.keys += keys
        self.lengths.append(counts)
        self.size += len(data)

    def row(self) -> dict:
        found, places, lengths = np.concatenate(self.found), np.concatenate(self.places), np.concatenate(self.lengths)
        terms = self.vocabulary
        if terms is None:
            terms, found = np.unique(found, return_inverse=True)
        postings, tfs = np.unique(found.astype(np.uint64) << np.uint64(32) | places, return_counts=True)
        used, dfs = np.unique(postings >> np.uint64(32), return_counts=True)
        out = {"docs": int((lengths > 0).sum()), "total": int(lengths.sum()), "terms": terms[used.astype(np.int64)].view(np.int64), "dfs": dfs.astype(np.int32), "keys": self.keys, "lengths": lengths.astype(np.int32), "places": postings.astype(np.uint32).tobytes(), "tfs": tfs.astype(np.uint32).tobytes()}
        self.clear()
        return out


def index(docs: DataFrame, scratch: Scratch, vocabulary: np.ndarray | None = None, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of an inverted index, written: docs and total count the documents with a term and all their terms; one row a shard.

    terms are 64-bit hashes, ascending, with dfs postings each; places (into keys) and tfs
    are unsigned 32-bit, list after list. Every document is indexed; a vocabulary of hashes
    leaves out the lists of other terms, not the counts. Null texts have no terms; null and
    repeated keys are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, schema = _Shard(vocabulary), pa.schema([("docs", pa.int64()), ("total", pa.int64()), ("terms", pa.list_(pa.int64())), ("dfs", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("places", pa.binary()), ("tfs", pa.binary())])
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            keys = batch.column("key").to_pylist()
            for lo, hi in chunks(offsets, min(CHUNK_BYTES, shard_bytes)):
                shard.add(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], keys[lo:hi])
                if shard.size >= shard_bytes:
                    yield pa.RecordBatch.from_pylist([shard.row()], schema)
        if shard.keys:
            yield pa.RecordBatch.from_pylist([shard.row()], schema)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return scratch.keep(rows.mapInArrow(run, _SHARD), "index")


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, term hash); rows of one item id, null too, are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            hashes, first = term_hashes(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(np.repeat(np.arange(len(offsets) - 1), np.diff(first)))), pa.array(hashes.view(np.int64))], ["item", "term"])

    return items.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).mapInArrow(run, "item long, term long").distinct()


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class _Best:
    """The k best of an item so far: scores descending, equal ones by ascending key."""

    def __init__(self, k: int):
        self.k, self.scores, self.keys = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score below this cannot enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def merge(self, scores: np.ndarray, keys: np.ndarray) -> None:
        scores, keys = np.concatenate((self.scores, scores)), np.concatenate((self.keys, keys))
        order = np.lexsort((keys, -scores))[: self.k]
        self.scores, self.keys = scores[order], keys[order]


def max_score(lists: list[tuple[np.ndarray, np.ndarray, int]], sums: np.ndarray, best: _Best, keys: np.ndarray) -> int:
    """Enter a shard's documents into ``best``; the number of postings looked at.

    lists: (documents ascending, contributions, their maximum) for each term. sums: a zero
    for each document; zero again afterwards.
    """
    lists = sorted(lists, key=lambda x: x[2])
    bounds, least = np.cumsum([x[2] for x in lists]), best.least
    cut = int(np.searchsorted(bounds, least, "left"))  # the lists before it cannot reach the least score together
    looked = 0
    for places, gains, _ in lists[cut:]:
        sums[places] += gains
        looked += len(places)
    candidates = np.flatnonzero(sums) if cut < len(lists) else np.zeros(0, np.int64)
    touched = candidates
    for i in range(cut - 1, -1, -1):
        candidates = candidates[sums[candidates] + bounds[i] >= least]
        if not len(candidates):
            break
        places, gains, _ = lists[i]
        at = np.minimum(np.searchsorted(places, candidates), len(places) - 1)
        hit = places[at] == candidates
        sums[candidates[hit]] += gains[at[hit]]
        looked += len(candidates)
    candidates = candidates[sums[candidates] >= least]
    if len(candidates):
        best.merge(sums[candidates], keys[candidates])
    sums[touched] = 0
    return looked


def search(shards: DataFrame, items: DataFrame, k: int = 50, item: str = "item_id", text: str = "text", key: str = "doc_id", block_terms: int = BLOCK_TERMS, terms: DataFrame | None = None) -> DataFrame:
    """Rows (item, rank, key, score): the k best documents of each item with a score above 0, by exact integer scores.

    Equal scores rank by ascending key, a null key last. Items without terms give no rows.
    Rows of one item id are one item; each document row ranks by itself. terms: the
    item_terms() of the items, where the caller has them.
    """
    spark = shards.sparkSession
    terms = item_terms(items, item, text) if terms is None else terms
    out = f"{item} long, rank int, {key} long, score long"
    totals = shards.agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("n")).first()
    pairs = terms.count()
    if not totals.docs or not pairs:
        return spark.createDataFrame([], out)
    docs, total = totals.docs, totals.total
    listed = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
    known = terms.join(listed, "term")
    blocks, found = -(-pairs // block_terms), None
    for block in range(blocks):
        mine = known if blocks == 1 else known.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        rows = mine.collect()  # block_terms of them or so
        names = sorted({r["item"] for r in rows}, key=lambda x: (x is None, x))
        weights = {r.term & (1 << 64) - 1: weight(docs, r.df) for r in rows}
        vocabulary = np.array(sorted(weights), np.uint64)
        loads = np.array([weights[int(t)] for t in vocabulary], np.int64)
        number = {x: i for i, x in enumerate(names)}
        order = sorted((number[r["item"]], r.term & (1 << 64) - 1) for r in rows)
        owner = np.array([i for i, _ in order], np.int64)
        wanted = np.searchsorted(vocabulary, np.array([t for _, t in order], np.uint64))
        cuts = np.searchsorted(owner, np.arange(len(names) + 1))

        def run(batches: Iterator[pa.RecordBatch], names=names, vocabulary=vocabulary, loads=loads, wanted=wanted, cuts=cuts) -> Iterator[pa.RecordBatch]:
            best = [_Best(k) for _ in names]
            for batch in batches:
                for i in range(batch.num_rows):
                    array = lambda c: batch.column(c)[i].values  # noqa: B023, E731
                    binary = lambda c: np.frombuffer(batch.column(c)[i].as_buffer(), np.uint32)  # noqa: B023, E731
                    held, dfs, lengths = np.asarray(array("terms")).view(np.uint64), np.asarray(array("dfs")), np.asarray(array("lengths")).astype(np.int64)
                    keys = np.asarray(array("keys").fill_null(_NO_KEY))
                    ends = np.cumsum(dfs)
                    if not len(held):
                        continue
                    at = np.minimum(np.searchsorted(held, vocabulary), len(held) - 1)
                    here = held[at] == vocabulary
                    load = np.zeros(len(held), np.int64)
                    load[at[here]] = loads[here]
                    places, tfs = binary("places").astype(np.int64), binary("tfs").astype(np.int64)
                    m = 100 - 50 + 50 * lengths * docs // total
                    gains = np.repeat(load, dfs) * (1_000_000_000 * tfs // (1000 * tfs + 20 * m[places]))
                    tops = np.maximum.reduceat(gains, ends - dfs)
                    sums = np.zeros(len(keys), np.int64)
                    for j, mine in enumerate(best):
                        own = wanted[cuts[j] : cuts[j + 1]]
                        own = at[own[here[own]]]
                        lists = [(places[ends[t] - dfs[t] : ends[t]], gains[ends[t] - dfs[t] : ends[t]], int(tops[t])) for t in own.tolist()]
                        if lists:
                            max_score(lists, sums, mine, keys)
            sizes = [len(b.scores) for b in best]
            if sum(sizes):
                found = np.concatenate([b.keys for b in best])
                ids = pa.array([x for x, n in zip(names, sizes, strict=True) for _ in range(n)], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int64(), mask=found == _NO_KEY), pa.array(np.concatenate([b.scores for b in best]))], ["item", "key", "score"])

        part = shards.select("terms", "dfs", "keys", "lengths", "places", "tfs").mapInArrow(run, "item long, key long, score long")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def ranked(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """index() and search() in one go; where the items fit one block, only lists of their terms are built."""
    terms = scratch.keep(item_terms(items, item, item_text), "items")
    vocabulary = None
    if terms.count() <= block_terms:
        vocabulary = np.unique(np.array([r.term for r in terms.select("term").distinct().collect()], np.int64).view(np.uint64))
    shards = index(docs, scratch, vocabulary, key, text, shard_bytes)
    return search(shards, items, k, item, item_text, key, block_terms, terms)
