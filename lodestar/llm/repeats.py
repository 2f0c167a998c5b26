"""Removal of repeated word windows, by difference-cover anchors.

Windows of ``window`` words that start at two places are found in three passes:

1. Anchors: shorter windows are hashed only where the start, modulo ``period``,
   is in a difference cover. For any two places i and j some shift below the
   period takes both into the cover, so a repeated window holds an equal anchor at
   the same shift in both places.
2. Extension: the starts up to a period before each anchor that occurs twice hash
   their whole window; a hash that occurs twice is a repeated window.
3. Removal of every word under a repeated window.

Equal hashes meet in buckets, but each chunk of rows sends one representative of
a hash, so that a passage in a third of all documents stays small. Places are
packed as arrays; no pair of places is ever formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.ranges import total_bytes
from lodestar.llm.scratch import Scratch
from lodestar.llm.words import Words, chunks, texts, windows

#: Perfect difference sets: each non-zero residue is one difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
BUCKET_BYTES = 16 << 20
_HELD = 1 << 21
_PLACES = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("rows", pa.binary()), ("places", pa.binary())])
_PLACES_DDL = "bucket int, hashes binary, rows binary, places binary"


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _dealt(to: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Buckets that get something, ascending, and for each column the bytes that each gets."""
    order = np.argsort(to, kind="stable")
    full, cut = np.unique(to[order], return_index=True)
    cut = np.append(cut, len(to))
    return full, [[c[order[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)] for c in columns]


class _Sender:
    """Gathers (hash, row, place); flush() gives rows for buckets of hashes, and from ``buckets`` on for buckets of rows.

    Of a hash with several places here, all but the first are known to repeat and
    travel straight to their rows' buckets; the first stands for them, its hash sent twice.
    """

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.held = buckets, [], 0

    def add(self, hashes: np.ndarray, rows: np.ndarray, places: np.ndarray) -> bool:
        self.parts.append((hashes, rows, places))
        self.held += len(hashes)
        return self.held >= _HELD

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        hashes, rows, places = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.argsort(hashes, kind="stable")
        hashes, rows, places = hashes[order], rows[order], places[order]
        first = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        run = np.cumsum(first) - 1
        twice = np.bincount(run)[run] > 1
        for chosen, known in ((first, False), (first & twice, False), (~first, True)):
            if not chosen.any():
                continue
            h, r, p = hashes[chosen], rows[chosen], places[chosen]
            to = bucket_of(r, self.buckets) + np.int32(self.buckets) if known else bucket_of(h, self.buckets)
            full, (hs, rs, ps) = _dealt(to, h, r, p)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in ([b""] * len(full) if known else hs, rs, ps))], schema=_PLACES)


def _repeated(buckets: int):
    """Of a bucket of hashes the places that repeat, dealt to buckets of rows; a bucket of rows goes on as it is."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        r, p = (np.frombuffer(b"".join(x.as_py() for x in table.column(c)), t) for c, t in (("rows", np.uint64), ("places", np.uint32)))
        if bucket >= buckets:
            full, sides = np.array([bucket - buckets], np.int32), [[r.tobytes()], [p.tobytes()]]
        else:
            h = np.frombuffer(b"".join(x.as_py() for x in table.column("hashes")), np.uint64)
            order = np.argsort(h, kind="stable")
            h, r, p = h[order], r[order], p[order]
            same = h[1:] == h[:-1]
            twice = np.zeros(len(h), bool)
            twice[1:] |= same
            twice[:-1] |= same
            full, sides = _dealt(bucket_of(r[twice], buckets), r[twice], p[twice])
        return pa.table({"bucket": pa.array(full, pa.int32()), **{c: pa.array(x, pa.binary()) for c, x in zip(("rows", "places"), sides, strict=True)}})

    return run


_MARKS_DDL = "bucket int, rows binary, places binary"


def _marks(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Marked (row, place) of a bucket, sorted by row."""
    r = np.frombuffer(b"".join(x.as_py() for x in table.column("rows")), np.uint64)
    p = np.frombuffer(b"".join(x.as_py() for x in table.column("places")), np.uint32)
    order = np.argsort(r, kind="stable")
    return r[order], p[order].astype(np.int64)


def _covered(n: int, lo: np.ndarray, length: int) -> np.ndarray:
    """Which of n positions lie in [x, x + length) for some x of lo."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.clip(lo, 0, n), 1)
    np.add.at(change, np.clip(lo + length, 0, n), -1)
    return np.cumsum(change)[:n] > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, period: int = 21, bucket_bytes: int = BUCKET_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """Rows (key, n_words, n_removed, kept_sha256, kept, spans) without repeated windows.

    Words are maximal runs outside ``[\\x20\\x09-\\x0D]``. kept: the words left, joined
    by one space. spans: removed word ranges [start, stop). Null and empty texts have
    no words. Null and repeated keys are kept: each row counts as a text of its own.
    Texts shorter than the window lose nothing. Other columns are ignored; an empty
    table gives no rows.
    """
    cover = np.array(COVERS[period])
    short = window - period + 1
    if short < 1:
        raise ValueError("the period must not exceed the window")
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    _, size = total_bytes(docs, text)
    # no fewer than the session's shuffle partitions, so that small tables use all cores
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    in_cover = np.zeros(period, bool)
    in_cover[cover] = True
    # equal (key, text) rows share a row id: their windows, and so their marks, are the same
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(key), F.col(text)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(buckets)
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            ids = np.asarray(batch.column("row")).view(np.uint64)
            for lo, hi in chunks(offsets):
                w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                doc = np.repeat(np.arange(hi - lo), w.counts)
                place = np.arange(len(w.hashes)) - w.first[doc]
                at = np.flatnonzero(in_cover[place % period] & (place + short <= w.counts[doc]) & (w.counts[doc] >= window))
                if len(at) and out.add(windows(w.hashes, at, at + short), ids[lo:hi][doc[at]], place[at].astype(np.uint32)):
                    yield from out.flush()
        yield from out.flush()

    def met(sent: DataFrame, name: str) -> DataFrame:
        return scratch.keep(sent.groupBy("bucket").applyInArrow(_repeated(buckets), _MARKS_DDL), name)

    dealt = rows.withColumn("bucket", F.expr(f"cast(pmod(shiftrightunsigned(row, 33), {buckets}) as int)"))
    found = met(rows.select("row", "text").mapInArrow(anchor, _PLACES_DDL), "anchors")

    def extend(table: pa.Table, marks: pa.Table) -> pa.Table:
        out, got = _Sender(buckets), []
        marked, places = _marks(marks)
        if len(marked):
            data, offsets = texts(table.column("text"))
            ids = np.asarray(table.column("row")).view(np.uint64)
            from_, to = np.searchsorted(marked, ids), np.searchsorted(marked, ids, "right")
            for i in np.flatnonzero(to > from_):
                w = Words(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                n = len(w.hashes) - window + 1
                if n > 0:
                    at = np.flatnonzero(_covered(n, places[from_[i] : to[i]] - period + 1, period))
                    out.add(windows(w.hashes, at, at + window), np.full(len(at), ids[i]), at.astype(np.uint32))
        got.extend(out.flush())
        return pa.Table.from_batches(got, _PLACES)

    sides = dealt.select("bucket", "row", "text").groupBy("bucket").cogroup(found.groupBy("bucket"))
    repeated = met(sides.applyInArrow(extend, _PLACES_DDL), "windows")
    scratch.drop("anchors")

    def finish(table: pa.Table, marks: pa.Table) -> pa.Table:
        marked, places = _marks(marks)
        ids = np.asarray(table.column("row")).view(np.uint64)
        from_, to = np.searchsorted(marked, ids), np.searchsorted(marked, ids, "right")
        total, removed, sha, kept, spans = [], [], [], [], []
        for i, value in enumerate(table.column("text")):
            words = value.as_py().encode().split()
            total.append(len(words))
            cut = np.zeros(0, np.int64)
            if to[i] > from_[i]:
                gone = _covered(len(words), places[from_[i] : to[i]], window)
                cut = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                words = list(compress(words, ~gone))
            removed.append(total[-1] - len(words))
            left = b" ".join(words)
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode())
            spans.append(cut)
        return pa.table({"key": table.column("key"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.string()), "spans": pa.array(spans, pa.list_(pa.int64()))})

    sides = dealt.groupBy("bucket").cogroup(repeated.groupBy("bucket"))
    return sides.applyInArrow(finish, "key long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<long>").withColumnRenamed("key", key)
