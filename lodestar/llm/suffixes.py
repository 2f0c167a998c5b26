"""Removal of repeated byte strings, by suffix arrays sorted in two stages.

A suffix array of all text would need every suffix in one order. Equal strings of
``window`` bytes only have to meet in one task, so text is cut by content first: among
the ``seed``-byte substrings of a window the one of least hash names it, and neighbouring
windows that it names form a stretch of less than two windows. Then

1. stretches are counted under their names: a stretch that occurs twice is repeated as a
   whole, and one copy stands for it; a name with a single stretch has nothing to meet;
2. the stretches that share a name are laid end to end and their suffixes sorted: those
   smaller than their successors directly, the rest induced from them by bucket scans;
3. windows whose common prefix with a neighbour in that order spans the window repeat.

A name of very many different stretches, as at the edges of a passage that a third of all
documents hold, is no group for one task. Its windows are named anew, by what the windows
of 16 neighbouring offsets of the seed have in common, and counted again; what is still
many then, the windows that reach a few bytes over such an edge, is counted window by
window under 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.ranges import total_bytes
from lodestar.llm.scratch import Scratch
from lodestar.llm.words import _TABLES, CHUNK_BYTES, between, chunks, mix, powers, prefix, ragged, release, texts

WINDOW, SEED = 200, 32
BUCKET_BYTES = 16 << 20
#: Stretches of one name that are sorted together; those of a name of more are named anew.
GROUP_LIMIT = 1 << 11
#: Offsets of the seed that the first and the second new name comprise.
FINER = (16, 1)
#: Bytes whose suffixes are sorted together, but that one name's stretches are never parted.
SORT_BYTES = 2 << 20
_HELD = 1 << 20
_PLACE = (1 << 21) - 1


def _smaller(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last one is not."""
    step = np.full(len(text), -1, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    turns = np.flatnonzero(step)
    return np.repeat(step[turns] > 0, np.diff(turns, prepend=-1))


def _eights(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros behind the end; places up to depth beyond it exist."""
    padded = np.zeros(len(text) + depth + 8, np.uint8)
    padded[: len(text)] = text
    return np.ndarray(len(text) + depth, ">u8", padded, strides=(1,))


def _sorted_directly(text: np.ndarray, places: np.ndarray, eights: np.ndarray, depth: int) -> np.ndarray:
    """Places by the ``depth`` bytes that follow: sixteen as numbers, the rest of what is still equal as strings."""
    group = np.zeros(len(places), np.int64)
    alive = np.arange(len(places))
    for at in (0, 8):
        keys = eights[places[alive] + at].astype(np.uint64)
        order = np.lexsort((keys, group[alive])) if at else np.argsort(keys, kind="stable")
        places[alive] = places[alive[order]]
        keys, of = keys[order], group[alive]
        new = np.ones(len(alive), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
        group[alive] = np.cumsum(new)
        tied = ~new
        tied[:-1] |= ~new[1:]
        alive = alive[tied]
    if len(alive):
        data = text.tobytes()
        cuts = np.flatnonzero(np.diff(group[alive], prepend=-1))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(alive)], strict=True):
            run = slice(int(alive[lo]), int(alive[lo]) + hi - lo)  # members of a group are adjacent
            places[run] = sorted(places[run].tolist(), key=lambda i: data[i + 16 : i + depth])
    return places


def suffix_array(text: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Places of a byte text in the order of the ``depth`` bytes from there on, in two stages.

    Equal ones stand in any order.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    smaller = _smaller(text)
    direct = _sorted_directly(text, np.flatnonzero(smaller), _eights(text, max(depth, 16)), depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    done = []
    for c in range(256):
        scanned = []
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(wave):  # runs of one byte put what they induce into the bucket that is being scanned
            scanned.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & ~smaller[before]]
        if bounds[c + 1] > bounds[c]:
            scanned.append(direct[bounds[c] : bounds[c + 1]])
        if not scanned:
            continue
        waiting[c] = []
        bucket = np.concatenate(scanned)
        done.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & ~smaller[before]]
        if not len(before):
            continue
        into = text[before]
        order = np.argsort(into, kind="stable")
        full, cuts = np.unique(into[order], return_index=True)
        for d, part in zip(full.tolist(), np.split(before[order], cuts[1:]), strict=True):
            waiting[d].append(part)
    return np.concatenate(done)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Length of the common prefix of the suffixes at each a and b, ``depth`` at most; both must reach that far."""
    eights, out = _eights(text, depth), np.full(len(a), depth)
    alive = np.arange(len(a))
    for at in range(0, depth, 8):
        differ = (eights[a[alive] + at] ^ eights[b[alive] + at]).astype(">u8")
        unlike = differ != 0
        if unlike.any():
            first = np.argmax(differ[unlike].view(np.uint8).reshape(-1, 8) != 0, axis=1)
            out[alive[unlike]] = np.minimum(at + first, depth)
            alive = alive[~unlike]
    return out


def stretches(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(name, hash, text, place, windows, offset) of each stretch of up to _PLACE bytes of texts, in order.

    place is the first window's in its text, offset the seed's in that window; a stretch
    holds ``windows + window - 1`` bytes.
    """
    n, span = len(data), window - seed + 1
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    sums = prefix(_TABLES[False][data])
    with np.errstate(over="ignore"):
        seeds = (sums[seed:] - sums[:-seed]) * powers(n + 1)[1][: n - seed + 1]
    low, width = seeds & ~np.uint64(_PLACE) | np.arange(len(seeds), dtype=np.uint64), 1
    while width < span:  # sliding minimum by doubling; equal hashes: the first place
        step = min(width, span - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    starts = np.flatnonzero(np.repeat(offsets[1:], np.diff(offsets))[: n - window + 1] >= np.arange(window, n + 1))
    at = (low[starts] & np.uint64(_PLACE)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    count = np.diff(first, append=len(at))
    begin = starts[first]
    doc = np.searchsorted(offsets, begin, "right") - 1
    return mix(seeds[at[first]]), between(sums, begin, begin + count + window - 1), doc, begin - offsets[doc], count, at[first] - begin


def finer(text: np.ndarray, place: np.ndarray, count: np.ndarray, offset: np.ndarray, window: int, step: int) -> tuple[np.ndarray, ...]:
    """(name, hash, place, windows, offset) of the parts of stretches whose seeds stand at ``step`` neighbouring offsets.

    The new name is the hash of the bytes that all windows of those offsets hold; equal windows have equal names.
    """
    seed, low = place + offset, (offset - count + 1) // step
    classes = offset // step - low + 1
    of, kind = np.repeat(np.arange(len(place)), classes), np.repeat(low, classes) + ragged(classes)
    begin = np.maximum(place[of], seed[of] - kind * step - step + 1)
    last = np.minimum(place[of] + count[of] - 1, seed[of] - kind * step)
    core = seed[of] - kind * step
    units = _TABLES[False][text]
    name = mix(between(prefix(units), core, core + window - step + 1) ^ mix(kind.astype(np.uint64)))
    return name, between(prefix(mix(units)), begin, last + window), begin, last - begin + 1, seed[of] - begin


def _pieces(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first text, place of its first byte) of about a megabyte; longer texts come in parts that share window - 1 bytes."""
    for lo, hi in chunks(offsets):
        part, size = data[offsets[lo] : offsets[hi]], int(offsets[hi] - offsets[lo])
        if size <= CHUNK_BYTES:
            yield part, offsets[lo : hi + 1] - offsets[lo], lo, 0
        else:
            for at in range(0, size - window + 1, CHUNK_BYTES):
                cut = part[at : at + CHUNK_BYTES + window - 1]
                yield cut, np.array([0, len(cut)]), lo, at


class _Groups:
    """Stretches of a task, those of one name and content collapsed: the first stands for them, the others are known to repeat."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, *columns: np.ndarray) -> bool:
        self.parts.append(columns)
        self.held += len(columns[0])
        return self.held >= _HELD

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        name, content, row, check, spot = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.lexsort((content, name))
        name, content = name[order], content[order]
        first = np.ones(len(order), bool)
        first[1:] = (name[1:] != name[:-1]) | (content[1:] != content[:-1])
        run = np.cumsum(first) - 1
        twice = np.bincount(run)[run] > 1
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name.view(np.int64), content.view(np.int64), row[order], check[order], spot[order], twice, ~first)], ["name", "content", "row", "check", "spot", "twice", "known"])


_STRETCH = "name long, content long, row long, check int, spot long, twice boolean, known boolean"
_MARK = "row long, check int, spot long"


def _spot(place: np.ndarray, count: np.ndarray, offset: np.ndarray | int = 0) -> np.ndarray:
    """A run of 1 to 256 windows and the seed's offset in the first, in one number."""
    return place << 16 | offset << 8 | count - 1


def _run(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, windows, offset)."""
    return spot >> 16, (spot & 255) + 1, spot >> 8 & 255


def _wanted(rows: pa.Table, asked: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a bucket that something is asked of, with the indexes of what."""
    row, check = np.asarray(asked.column("row")), np.asarray(asked.column("check"))
    order = np.argsort(row, kind="stable")
    ids, checks = np.asarray(rows.column("row")), np.asarray(rows.column("check"))
    lo, hi = np.searchsorted(row[order], ids), np.searchsorted(row[order], ids, "right")
    for i in np.flatnonzero(hi > lo).tolist():
        mine = order[lo[i] : hi[i]]
        mine = mine[check[mine] == checks[i]]
        if len(mine):
            yield i, mine


def repeated_windows(cut: pa.Table, window: int, sort_bytes: int = SORT_BYTES) -> pa.Table:
    """Marks of the windows that occur twice among the stretches of each name."""
    order = np.argsort(np.asarray(cut.column("name")), kind="stable")
    cut = cut.take(pa.array(order))
    name, spots = np.asarray(cut.column("name")), np.asarray(cut.column("spot"))
    data, offsets = texts(cut.column("bytes"))
    ends = np.append(np.flatnonzero(np.diff(name)) + 1, len(name))  # of each name's stretches
    reach, found, lo = offsets[ends], [], 0
    while lo < len(name):
        hi = int(ends[max(np.searchsorted(reach, offsets[lo] + sort_bytes, "right") - 1, np.searchsorted(ends, lo, "right"))])
        text, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        whole = np.repeat(own[1:], np.diff(own)) >= np.arange(window, len(text) + window)  # windows that end in their stretch
        order = suffix_array(text, window)
        order = order[whole[order]]
        near = common_prefixes(text, order[:-1], order[1:], window) >= window
        twice = np.zeros(len(text), bool)
        twice[order[:-1][near]] = True
        twice[order[1:][near]] = True
        at = np.flatnonzero(twice)
        of = np.searchsorted(own, at, "right") - 1
        new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(of, prepend=-1) != 0))
        found.append((lo + of[new], at[new] - own[of[new]], np.diff(new, append=len(at))))
        lo = hi
    of, place, count = (np.concatenate(x) for x in zip(*found, strict=True))
    out = cut.select(["row", "check"]).take(pa.array(of))
    return out.append_column("spot", pa.array(_spot(_run(spots[of])[0] + place, count)))


def _gone(size: int, spots: np.ndarray, window: int) -> np.ndarray:
    """Bounds [start, stop, start, stop, ...] of what the marked windows cover."""
    start, count, _ = _run(spots)
    change = np.bincount(start, minlength=size + 1) - np.bincount(start + count + window - 1, minlength=size + 1)
    return np.flatnonzero(np.diff(np.cumsum(change)[:size] > 0, prepend=False, append=False))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, group_limit: int = GROUP_LIMIT, bucket_bytes: int = BUCKET_BYTES, sort_bytes: int = SORT_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """Rows (key, n_bytes, kept, spans): texts as UTF-8 bytes without any byte under a ``window``-byte string that starts in two places.

    Strings do not cross texts; they are judged on the input. kept holds the bytes left,
    which may cut characters; spans are the removed ranges [start, stop, start, stop, ...].
    Null and empty texts and those shorter than the window lose nothing. Null and repeated
    keys are kept: each row is a text of its own. Other columns are ignored; an empty table
    gives no rows.
    """
    if not 8 <= seed <= window or window - seed >= 256:
        raise ValueError("a seed has 8 bytes at least and is less than 256 bytes shorter than the window")
    scratch = scratch or Scratch(docs.sparkSession, "suffixes")
    _, size = total_bytes(docs, text)
    # no fewer than the session's shuffle partitions, so that small tables use all cores
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    plain = F.coalesce(F.col(text), F.lit(""))
    # equal (key, text) rows share their 96-bit id: what repeats in one repeats in the other
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(key), plain).alias("row"), F.hash(plain, F.col(key)).alias("check"), plain.cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Groups()
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            row, check = np.asarray(batch.column("row")), np.asarray(batch.column("check"))
            for part, own, doc, at in _pieces(data, offsets, window):
                name, content, of, place, count, offset = stretches(part, own, window, seed)
                if len(name) and out.add(name, content, row[doc + of], check[doc + of], _spot(place + at, count, offset)):
                    yield from out.flush()
        yield from out.flush()
        release()

    in_bucket = lambda df, c: df.withColumn("bucket", F.expr(f"cast(pmod(hash({c}), {buckets}) as int)"))
    dealt = in_bucket(rows.where(F.octet_length("text") >= window), "row")
    sent = scratch.keep(rows.where(F.octet_length("text") >= window).select("row", "check", "text").mapInArrow(cut, _STRETCH), "stretches")

    def counted(stretch: DataFrame, name: str) -> DataFrame:
        """Stretches that repeat as a whole (marked), and one of each content where a name has several (asked).

        Both counts are taken in one pass over rows dealt by name; windows spill.
        """
        of_content, of_name = "PARTITION BY name, content", "PARTITION BY name"
        rows = stretch.where("not known").select("name", "content", "row", "check", "spot", "twice").repartition("name")
        rows = rows.withColumn("nth", F.expr(f"row_number() OVER ({of_content} ORDER BY row, check, spot)")).withColumn("same", F.expr(f"count(1) OVER ({of_content})"))
        rows = rows.withColumn("contents", F.expr(f"sum(if(nth = 1, 1, 0)) OVER ({of_name})"))
        told = rows.select("name", "row", "check", "spot", (F.col("twice") | (F.col("same") > 1)).alias("marked"), ((F.col("nth") == 1) & (F.col("contents") > 1)).alias("asked"), (F.col("contents") > group_limit).alias("many"))
        return scratch.keep(told.where("marked or asked"), name)

    def extracted(step: int):
        """Bytes of the stretches that are asked for; of names of too many of them, the parts under their new names instead."""

        def run(table: pa.Table, asked: pa.Table) -> pa.Table:
            parts, out, column = _Groups(), [], table.column("text")
            row, check = np.asarray(table.column("row")), np.asarray(table.column("check"))
            spots, names, many = np.asarray(asked.column("spot")), np.asarray(asked.column("name")), np.asarray(asked.column("many"))
            for i, mine in _wanted(table, asked):
                data = column[i].as_py()
                for j in mine[~many[mine]].tolist():
                    place, count, _ = _run(int(spots[j]))
                    out.append((int(names[j]), 0, int(row[i]), int(check[i]), int(spots[j]), False, False, data[place : place + count + window - 1]))
                if many[mine].any():
                    name, content, *run_ = finer(np.frombuffer(data, np.uint8), *_run(spots[mine[many[mine]]]), window, step)
                    parts.add(name, content, np.full(len(name), row[i]), np.full(len(name), check[i]), _spot(*run_))
            columns = list(zip(*out, strict=True)) or [[]] * len(schema)
            tables = [pa.table([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)]
            for batch in parts.flush():
                tables.append(pa.Table.from_batches([batch]).append_column("bytes", pa.nulls(batch.num_rows, pa.binary())).cast(schema))
            return pa.concat_tables(tables)

        schema = pa.schema([("name", pa.int64()), ("content", pa.int64()), ("row", pa.int64()), ("check", pa.int32()), ("spot", pa.int64()), ("twice", pa.bool_()), ("known", pa.bool_()), ("bytes", pa.binary())])
        return run

    found, cut_out = counted(sent, "counted"), []
    marks = [sent.where("known").select("row", "check", "spot")]
    for step in FINER:
        marks.append(found.where("marked").select("row", "check", "spot"))
        more = not found.where("asked and many").isEmpty()
        asked = in_bucket(found.where("asked").select("name", "row", "check", "spot", "many"), "row")
        met = scratch.keep(dealt.select("bucket", "row", "check", "text").groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(extracted(step), f"{_STRETCH}, bytes binary"), f"cut-{step}")
        cut_out.append(met.where("bytes is not null").select("name", "row", "check", "spot", "bytes"))
        if not more:
            break
        parts = met.where("bytes is null")
        marks.append(scratch.keep(parts.where("known").select("row", "check", "spot"), f"known-{step}"))
        found = counted(parts, f"counted-{step}")
    else:  # of one window a stretch: what has another content under its name is another window
        marks.append(found.where("marked").select("row", "check", "spot"))
    sorted_ = in_bucket(reduce(DataFrame.union, cut_out), "name").groupBy("bucket").applyInArrow(lambda t: repeated_windows(t, window, sort_bytes), _MARK)
    marks.append(scratch.keep(sorted_, "sorted"))
    scratch.drop(*[f"cut-{step}" for step in FINER])
    marks = reduce(DataFrame.union, marks)

    def finish(table: pa.Table, marked: pa.Table) -> pa.Table:
        spots, kept, spans = np.asarray(marked.column("spot")), table.column("text").to_pylist(), [[]] * table.num_rows
        sizes = [len(x) for x in kept]
        for i, mine in _wanted(table, marked):
            cuts = _gone(sizes[i], spots[mine], window)
            edges = [0, *cuts.tolist(), sizes[i]]
            kept[i], spans[i] = b"".join(kept[i][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), cuts
        return pa.table({"key": table.column("key"), "n_bytes": pa.array(sizes, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.int64()))})

    sides = in_bucket(rows, "row").groupBy("bucket").cogroup(in_bucket(marks, "row").groupBy("bucket"))
    return sides.applyInArrow(finish, "key long, n_bytes long, kept binary, spans array<long>").withColumnRenamed("key", key)
