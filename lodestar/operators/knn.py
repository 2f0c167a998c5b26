"""Exact nearest neighbours of a query set, with (distance, id) as the order.

Two ways give the same rows. ``knn`` meets all rows in blocks: query blocks of a checked
size go out to the partitions of the base, which keep their best k a query, so that only
those are shuffled. ``hamming_knn`` first meets descriptors that share a sub-code, by
equi-joins, and leaves to the blocks only the queries whose answer that cannot prove.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lodestar.sources.shared import kept

#: Bytes of values that leave the driver at once.
BLOCK_BYTES = 32 << 20
#: Pairs whose distances a task holds at once, and queries among them, so that they stay in a core's cache.
PAIRS, TILE = 1 << 18, 256
#: The same for descriptors of bits: numpy joins words several times as fast in rows of some thousands.
BITS_TILE, BITS_PAIRS = 32, 1 << 16
BAND_BITS = 16
#: Pairs that one task meets, at most about; pairs of whole descriptors that cost what a row of the join on slices does.
TASK_PAIRS, JOINED_COST = 1 << 32, 500


def as_words(df: DataFrame, value: str) -> Column:
    """A descriptor of 64 bits or of an array of 64-bit words, as an array."""
    return F.col(value) if isinstance(df.schema[value].dataType, ArrayType) else F.array(value)


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    if not len(column):
        return np.zeros((0, 0), kind)
    width, rest = divmod(len(flat), len(column))
    if rest or flat.null_count or (np.diff(np.asarray(column.offsets)) != width).any():
        raise ValueError("vectors of one length and without nulls are needed")
    numbers = np.asarray(flat)
    return (numbers.view(np.uint64) if kind is np.uint64 else numbers.astype(kind)).reshape(len(column), width)


def blocks(df: DataFrame, id_: str, value: str, kind: type, size: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, rows of values) of a table in blocks of about ``size`` bytes, dealt by hash of the id; one at a time on the driver."""
    size = size or BLOCK_BYTES
    rows = df.select(F.col(id_).alias("id"), F.col(value).alias("value"))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("value")).alias("width")).first()
    count = -(-sums.n * (8 * (sums.width or 0) + 16) // size)
    for i in range(count):
        table = (rows if count == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(count)) == i)).toArrow()
        if table.num_rows:
            yield table.column("id").combine_chunks(), matrix(table.column("value"), kind)


def _l2(q: np.ndarray, b: np.ndarray, need: np.ndarray, k: int, places: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that may be among the k nearest, by a matrix product, with their distances taken exactly."""
    near = (q * q).sum(1)[:, None] - 2 * (q @ b.T) + (b * b).sum(1)[None]
    slack = 1e-9 * ((q * q).sum(1) + (b * b).sum(1).max()) + (0 if places is None else 10.0**-places)
    i, j = _where(near <= (_limit(near, need, k) + slack)[:, None])
    gap = q[i] - b[j]
    return i, j, (gap * gap).sum(1)


def _l1(q: np.ndarray, b: np.ndarray, need: np.ndarray, k: int, places: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that may be among the k nearest, by sums in single precision, with their distances taken exactly."""
    size = np.abs(q).sum(1) + np.abs(b).sum(1).max(initial=0.0)
    kind = np.float32 if size.max(initial=0.0) < 1e30 else float
    qt, bt = (np.ascontiguousarray(x.T.astype(kind)) for x in (q, b))
    near = np.zeros((len(q), len(b)), kind)
    for at in range(0, len(q), 32):  # few rows at once: all dimensions pass over what the cache holds
        part = near[at : at + 32]
        gap = np.empty_like(part)
        for x, y in zip(qt[:, at : at + 32], bt, strict=True):
            np.subtract(x[:, None], y, out=gap)
            np.add(part, np.abs(gap, out=gap), out=part)
    slack = 2 * (q.shape[1] + 4) * np.finfo(kind).eps * size + (0 if places is None else 10.0**-places)
    i, j = _where(near <= (_limit(near, need, k) + slack)[:, None])
    return i, j, np.abs(q[i] - b[j]).sum(1)


def differing(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every pair of rows of 64-bit words, in the least unsigned type that holds them; joined words stay in a core's cache."""
    far = np.empty((len(q), len(b)), np.min_scalar_type(64 * q.shape[1]))
    tall = max(1, BITS_PAIRS // max(1, len(b)))
    joined, columns = np.empty((min(tall, len(q)), len(b)), np.uint64), np.ascontiguousarray(b.T)
    for at in range(0, len(q), tall):
        part = far[at : at + tall]
        both = joined[: len(part)]
        for i, column in enumerate(columns):
            np.bitwise_xor(q[at : at + tall, i, None], column, out=both)
            if i:
                part += np.bitwise_count(both)
            else:
                np.bitwise_count(both, out=part)
    return far


def _hamming(q: np.ndarray, b: np.ndarray, need: np.ndarray, k: int, places: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that may be among the k nearest; where many may, the k lowest by distance and place alone, as b is in order of ids."""
    far = differing(q, b)
    most = np.minimum(need, 64 * q.shape[1]).astype(far.dtype)
    near = far <= most[:, None]
    if far.shape[1] > k and np.count_nonzero(near) > 4 * k * len(q):
        near = far <= np.minimum(most, _within(far, k))[:, None]
    if far.shape[1] > k and np.count_nonzero(near) > 4 * k * len(q):
        order = far.astype(np.int64) * far.shape[1] + np.arange(far.shape[1])
        near &= order <= np.partition(order, k - 1, axis=1)[:, k - 1, None]
    i, j = _where(near)
    return i, j, far[i, j].astype(float)


def _within(far: np.ndarray, k: int) -> np.ndarray:
    """Distances that at least k of each row are within: the k-th lowest of what groups of places have as their least."""
    groups = min(far.shape[1], 4 * k)
    width = far.shape[1] // groups
    return np.partition(far[:, : groups * width].reshape(len(far), groups, width).min(2), k - 1, axis=1)[:, k - 1]


def even(n: int, most: int) -> int:
    """The length of pieces that n is cut into, nearly equal ones of at most ``most``."""
    return max(1, -(-n // max(1, -(-n // most))))


def _where(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(near), near.shape[1])


def _limit(far: np.ndarray, need: np.ndarray, k: int) -> np.ndarray:
    """need, or where many are within it the k-th distance here, if that is less."""
    if far.shape[1] <= k or np.count_nonzero(far <= need[:, None]) <= 4 * k * len(far):
        return need
    return np.minimum(need, np.partition(far, k - 1, axis=1)[:, k - 1])


_METRICS: dict[str, tuple[type, Callable]] = {"l2": (float, _l2), "l1": (float, _l1), "hamming": (np.uint64, _hamming)}


class _Nearest:
    """The k nearest of each query so far, ordered by query, distance and id."""

    def __init__(self, queries: int, k: int):
        self.k, self.need = k, np.full(queries, np.inf)
        self.query, self.far, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def merge(self, query: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        query, far, ids = np.concatenate((self.query, query)), np.concatenate((self.far, far)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, far, query))
        query, far, ids = query[order], far[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        good = place < self.k
        last = place == self.k - 1
        self.need[query[last]] = far[last]
        self.query, self.far, self.ids = query[good], far[good], ids[good]


def _nearest_in(names: pa.Array, q: np.ndarray, metric: str, k: int, places: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind, pairs = _METRICS[metric]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tall = BITS_TILE if metric == "hamming" else TILE
        tiles = [(at, q[at : at + tall], _Nearest(len(q[at : at + tall]), k)) for at in range(0, len(q), tall)]
        for batch in batches:
            ids, values = np.asarray(batch.column("base")), matrix(batch.column("value"), kind)
            if len(values) and values.shape[1] != q.shape[1]:
                raise ValueError("vectors of one length are needed")
            order = np.argsort(ids, kind="stable")
            ids, values = ids[order], values[order]
            for _, mine, best in tiles:
                step = even(len(values), max(1, PAIRS // len(mine)))
                for lo in range(0, len(values), step):
                    i, j, far = pairs(mine, values[lo : lo + step], best.need, k, places)
                    if len(i):
                        best.merge(i, far if places is None or metric == "hamming" else np.round(far, places) + 0.0, ids[lo + j])
        for at, _, best in tiles:
            if len(best.query):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at + best.query)), pa.array(best.ids), pa.array(best.far)], ["query", "base", "dist"])

    return run


def spread(rows: DataFrame, by: str, pairs: int = 0) -> DataFrame:
    """rows dealt to all cores, and to more tasks where they make many pairs: they are few bytes, which Spark puts into few tasks, but each meets many others."""
    return rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS)), by)


def knn(queries: DataFrame, base: DataFrame, metric: str, k: int, value: str, query_id: str, base_id: str, places: int | None = None, block_bytes: int | None = None, pairs: int = 0) -> DataFrame:
    """(query_id, base_id, dist, rank): the k nearest of ``base`` for each query; ties go to the lower id.

    metric: l2 (squared), l1, or hamming (64-bit words, one or an array of them); l2 and l1
    may be rounded to ``places`` before they are compared. base_id is a whole number, the
    query id anything. The stated query set goes out in blocks of ``block_bytes``, each in a
    pass over the base; rows with a null value are left out, vectors of unequal length fail.
    pairs: how many they make, if known; then no task meets many more than ``TASK_PAIRS``.
    """
    kind = _METRICS[metric][0]
    shape = as_words if kind is np.uint64 else lambda df, c: F.col(c).cast("array<double>")
    q = queries.where(F.col(value).isNotNull()).select(F.col(query_id).alias("query"), shape(queries, value).alias("value"))
    b = spread(base.where(F.col(value).isNotNull()).select(F.col(base_id).cast("long").alias("base"), shape(base, value).alias("value")), "base", pairs)
    name = q.schema["query"].dataType.simpleString()
    found = [b.mapInArrow(_nearest_in(names, rows, metric, k, places), f"query {name}, base long, dist double") for names, rows in blocks(q, "query", "value", kind, block_bytes)]
    best = reduce(DataFrame.union, found) if found else queries.sparkSession.createDataFrame([], f"query {name}, base long, dist double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("dist", "base"))).where(F.col("rank") <= k)
    dist = F.col("dist").cast("int") if metric == "hamming" else F.col("dist")
    return ranked.select(F.col("query").alias(query_id), F.col("base").alias(base_id), dist.alias("dist"), "rank")


def sub_codes(words: Column, bands: int) -> list[Column]:
    """The 16-bit slices of an array of 64-bit words, the lowest first."""
    return [F.shiftrightunsigned(words[i // 4], 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF)).cast("int") for i in range(bands)]


def _meets(codes: DataFrame, sizes: DataFrame, near_codes: Column) -> int:
    """Rows that a join of codes (band, code) and their neighbours with sizes (band, code, n) meets, from how often each code comes."""
    probes = codes.groupBy("band", "code").agg(F.count(F.lit(1)).alias("asked")).select("band", "asked", near_codes.alias("code"))
    return probes.join(sizes, ["band", "code"]).agg(F.sum(F.col("asked") * F.col("n")).alias("n")).first().n or 0


def hamming_knn(queries: DataFrame, base: DataFrame, k: int, value: str, query_id: str, base_id: str, radius: int = 1, most: float = 0.1, block_bytes: int | None = None, few_pairs: int = 1 << 34) -> DataFrame:
    """The rows of ``knn`` for hamming, without all pairs where sub-codes prove the answer.

    Two descriptors of b slices that differ in fewer than b * (r + 1) bits differ in r bits
    at most in some slice. So a join on slices and their neighbours within r bits finds
    every base row nearer than that, and a query with k of them is done. r goes from 0 to
    ``radius``; queries that are not done, and those whose slices alone meet more than
    ``most`` of the base, are compared with it in blocks; so are all queries where there
    are no more than ``few_pairs`` pairs, which costs less than the joins. Neighbours of
    slices are joined only where they meet so few rows that this costs less than the blocks.
    A pair that meets in several slices counts at the first. Rows with a null value are left out.
    """
    q = kept(queries.where(F.col(value).isNotNull()).select(F.col(query_id).alias("query"), as_words(queries, value).alias("qv")))
    b = kept(base.where(F.col(value).isNotNull()).select(F.col(base_id).cast("long").alias("base"), as_words(base, value).alias("bv")))
    one = q.select(F.size("qv").alias("n")).first()
    rows = b.count()
    asked = q.count()
    if one is None or rows * asked <= few_pairs:
        return knn(q, b.withColumnRenamed("bv", "qv"), "hamming", k, "qv", "query", "base", block_bytes=block_bytes, pairs=rows * asked).select(F.col("query").alias(query_id), F.col("base").alias(base_id), "dist", "rank")
    bands = one.n * 64 // BAND_BITS
    cut = lambda words: F.posexplode(F.array(*sub_codes(F.col(words), bands))).alias("band", "code")
    codes = b.select("base", "bv", cut("bv"))
    sizes = codes.groupBy("band", "code").agg(F.count(F.lit(1)).alias("n"))
    left, done = q, []
    for r in range(radius + 1):
        masks = [sum(1 << x for x in bits) for n in range(r + 1) for bits in combinations(range(BAND_BITS), n)]
        near_codes = F.explode(F.array(*[F.col("code").bitwiseXOR(F.lit(m)) for m in masks]))
        if r and _meets(left.select(cut("qv")), sizes, near_codes) * JOINED_COST > asked * rows:
            break
        probes = left.select("query", "qv", cut("qv")).withColumn("code", near_codes)
        light = probes.join(sizes, ["band", "code"]).groupBy("query").agg(F.sum("n").alias("n")).where(F.col("n") <= most * rows * bands).select("query")
        met = probes.join(light, "query", "left_semi").join(codes, ["band", "code"])
        apart = [F.bit_count(x.bitwiseXOR(y)) <= r for x, y in zip(sub_codes(F.col("qv"), bands), sub_codes(F.col("bv"), bands), strict=True)]
        first = F.array_position(F.array(*apart), F.lit(True)) - 1
        far = F.aggregate(F.zip_with("qv", "bv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        near = met.where(first == F.col("band")).select("query", "base", far.alias("dist")).where(F.col("dist") < bands * (r + 1))
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("dist", "base"))).where(F.col("rank") <= k)
        found = kept(ranked)
        whole = found.where(F.col("rank") == k).select("query")
        done.append(found.join(whole, "query", "left_semi"))
        left = kept(left.join(whole, "query", "left_anti"))
        asked = left.count()
    done.append(knn(left.select("query", F.col("qv").alias("v")), b.withColumnRenamed("bv", "v"), "hamming", k, "v", "query", "base", block_bytes=block_bytes, pairs=rows * asked))
    return reduce(DataFrame.union, done).select(F.col("query").alias(query_id), F.col("base").alias(base_id), "dist", "rank")


def ratio_test(matches: DataFrame, ratio: float, query_id: str) -> DataFrame:
    """Nearest matches of two whose distance is strictly below ratio times the second's; single matches are dropped."""
    second = F.lead("dist").over(Window.partitionBy(query_id).orderBy("rank"))
    return matches.withColumn("second", second).where((F.col("rank") == 1) & (F.col("dist") < ratio * F.col("second")))


def few(rows: DataFrame, most: int = 1 << 16) -> DataFrame:
    """A table that may be broadcast: a codebook or medoids; one of more than ``most`` rows fails."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows cannot be held by every task")
    return F.broadcast(rows)


def nearest(points: DataFrame, centers: DataFrame, distance: Callable[[Column, Column], Column], point: str = "vec", center: str = "center", k: str = "k") -> DataFrame:
    """points with their nearest center (k, dist); the first of equals. The centers are a codebook, whose rows are counted."""
    book = F.broadcast(few(centers).agg(F.collect_list(F.struct(F.col(k).alias("k"), F.col(center).alias("c"))).alias("_book")))
    best = F.array_min(F.transform("_book", lambda b: F.struct(distance(F.col(point), b["c"]).alias("dist"), b["k"].alias("k"))))
    return points.crossJoin(book).withColumn("_best", best).withColumn(k, F.col("_best.k")).withColumn("dist", F.col("_best.dist")).drop("_best", "_book")


def lsh_candidates(queries: DataFrame, base: DataFrame, value: str, query_id: str, base_id: str, bands: int = 4) -> DataFrame:
    """Distinct (query_id, base_id) that share one of ``bands`` equal slices of their 64 bits: an equi-join."""
    width = 64 // bands

    def cut(df, id_, name):
        slices = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.col(value), i * width).bitwiseAND(F.lit((1 << width) - 1)).alias("bucket")) for i in range(bands)])
        return df.select(F.col(id_).alias(name), F.explode(slices).alias("s")).select(name, "s.band", "s.bucket")

    return cut(queries, query_id, "_q").join(cut(base, base_id, "_b"), ["band", "bucket"]).select(F.col("_q").alias(query_id), F.col("_b").alias(base_id)).distinct()
