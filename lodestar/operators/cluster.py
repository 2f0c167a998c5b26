"""Binary k-means and k-medoids; distances are Hamming, descriptors 64 bits (long) or more (array of longs).

Searches over medoids compare candidates with points. Candidates go out in blocks of a
checked size, each in a pass over the points that returns sums, so nothing of the size of
the table is broadcast and no pair is a row. The driver holds the medoids alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lodestar.functions.exprs import hamming, hamming_words
from lodestar.functions.random import Xoroshiro128
from lodestar.operators import bow
from lodestar.operators.knn import PAIRS, as_words, blocks, differing, even, few, matrix, nearest, spread
from lodestar.sources.shared import kept

Medoid = tuple[int, int | list[int]]
#: Swaps of a draw that are costed at first; then 16 times as many each time, while none helps.
FIRST_SWAPS = 256
#: Points in a tile's row, which numpy meets several times as fast as short ones, and points that a task gathers for them.
WIDE, GATHERED = 8000, 1 << 17


def _distance(points: DataFrame):
    return hamming_words if isinstance(points.schema["bits"].dataType, ArrayType) else hamming


def _words(medoids: list[Medoid]) -> np.ndarray:
    return np.array([b if isinstance(b, list) else [b] for _, b in medoids], np.int64).view(np.uint64)


def _table(spark: SparkSession, points: DataFrame, rows: list[Medoid], names: tuple[str, str] = ("m", "center")) -> DataFrame:
    return spark.createDataFrame(rows, f"{names[0]} long, {names[1]} {points.schema['bits'].dataType.simpleString()}")


def bit_sums(points: DataFrame, by: str) -> DataFrame:
    """(by, bit, ones, n): set bits of each position in each cluster."""
    bits = points.select(by, F.posexplode(F.split(F.reverse(F.lpad(F.bin("bits"), 64, "0")), "")).alias("bit", "one")).where("bit < 64")
    return bits.groupBy(by, "bit").agg(F.sum(F.col("one").cast("int")).cast("long").alias("ones"), F.count(F.lit(1)).alias("n"))


def bit_majority(points: DataFrame, by: str) -> DataFrame:
    """(by, bits): a bit is set where more than half of the cluster have it; ties are 0."""
    return bit_sums(points, by).groupBy(by).agg(F.bit_or(F.when(2 * F.col("ones") > F.col("n"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).otherwise(F.lit(0).cast("long"))).alias("bits"))


def assign_bits(points: DataFrame, centers: DataFrame) -> DataFrame:
    """points with k, dist of the nearest center; centers (k, center) are few."""
    return nearest(points, centers, _distance(points), "bits")


def majority_step(points: DataFrame, centers: DataFrame) -> DataFrame:
    """(k, bits) after one assignment and vote; a center without points stays."""
    voted = bit_majority(assign_bits(points, centers), "k")
    return centers.join(voted, "k", "left").select("k", F.coalesce("bits", "center").alias("bits"))


def _votes(points: DataFrame, centers: np.ndarray, moved: dict[int, int], before: tuple[np.ndarray, dict[int, int]] | None) -> list:
    """For each cluster: its size, set bits of each position, and members that were elsewhere under ``before``, in one pass.

    moved puts a few points, by id, into other clusters than the nearest.
    """
    width = 64 * centers.shape[1]

    def own(words: np.ndarray, ids: np.ndarray, book: np.ndarray, exceptions: dict[int, int]) -> np.ndarray:
        k = np.argmin(differing(words, book), axis=1)
        for i in np.flatnonzero(np.isin(ids, list(exceptions))) if exceptions else ():
            k[i] = exceptions[int(ids[i])]
        return k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones, changed = np.zeros(len(centers), np.int64), np.zeros((len(centers), width), np.int64), np.zeros(len(centers), np.int64)
        for batch in batches:
            words, ids = matrix(batch.column("value"), np.uint64), np.asarray(batch.column("id"))
            for lo in range(0, len(ids), max(1, PAIRS // len(centers))):
                w, i = words[lo : lo + max(1, PAIRS // len(centers))], ids[lo : lo + max(1, PAIRS // len(centers))]
                plain = own(w, i, centers, {})
                k = own(w, i, centers, moved) if moved else plain
                if before:
                    np.add.at(changed, plain, plain != own(w, i, *before))
                n += np.bincount(k, minlength=len(centers))
                bits = np.unpackbits(w.view(np.uint8).reshape(len(w), -1), axis=1, bitorder="little")
                for c in np.unique(k):
                    ones[c] += bits[k == c].sum(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centers))), pa.array(n), pa.array(changed), pa.array(list(ones), pa.list_(pa.int64()))], ["k", "n", "changed", "ones"])

    rows = points.select(F.col("kp_ind").alias("id"), as_words(points, "bits").alias("value"))
    sums = rows.mapInArrow(run, "k long, n long, changed long, ones array<long>").groupBy("k").agg(F.sum("n").alias("n"), F.sum("changed").alias("changed"), F.array(*[F.sum(F.col("ones")[i]) for i in range(width)]).alias("ones"))
    return sorted(sums.collect())


def kmajority(points: DataFrame, k: int, seed: int = 0, rounds: int = 100, start: list[int | list[int]] | None = None) -> tuple[list[tuple[int, int | list[int], int]], int, bool]:
    """([(k, bits, members)], rounds, converged): binary k-means.

    Each round sets every center to the majority of its members, an empty one stays, and
    assigns every point to the nearest center, the lower of equals. It has converged when
    no point then belongs elsewhere than before. Then each empty cluster, in order, takes
    from the largest one, the lower of equals, the farthest point, the lowest id of equals;
    the next round counts it there. Without more points than clusters the points, over and
    over, are the centers. start: the first centers; else k points by seeded hash of the id.
    """
    single = not isinstance(points.schema["bits"].dataType, ArrayType)
    n = points.count()
    if not n:
        return [], 0, True
    if n <= k:
        rows = [(r.kp_ind, r.bits) for r in points.orderBy("kp_ind").select("kp_ind", "bits").collect()]
        return [(i, rows[i % n][1], int(i < n)) for i in range(k)], 0, True
    centers = _words([(0, b) for b in start] if start else [(r.kp_ind, r.bits) for r in sampled(points, k, seed).select("kp_ind", "bits").collect()])
    moved: dict[int, int] = {}
    votes, done, number = _votes(points, centers, moved, None), False, 0
    while number < rounds and not done:
        number += 1
        before = (centers, moved)
        set_bits = np.array([[2 * x > max(v.n, 1) for x in v.ones] for v in votes])
        new = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64)
        centers = np.where(np.array([v.n for v in votes])[:, None] > 0, new, centers)
        votes = _votes(points, centers, {}, before)
        done = not any(v.changed for v in votes)
        moved = _refilled(points, centers, [v.n for v in votes])
        if moved:
            votes = _votes(points, centers, moved, None)
    signed = centers.view(np.int64).tolist()
    return [(i, signed[i][0] if single else signed[i], votes[i].n) for i in range(k)], number, done


def _refilled(points: DataFrame, centers: np.ndarray, sizes: list[int]) -> dict[int, int]:
    """Point id to empty cluster: each takes the next farthest point of what is then the largest cluster."""
    sizes, given = list(sizes), []
    for k in [i for i, n in enumerate(sizes) if not n]:
        largest = max(range(len(sizes)), key=lambda i: (sizes[i], -i))
        sizes[largest] -= 1
        sizes[k] += 1
        given.append((largest, k))
    if not given:
        return {}
    single = not isinstance(points.schema["bits"].dataType, ArrayType)
    book = _table(points.sparkSession, points, [(i, b[0] if single else b) for i, b in enumerate(centers.view(np.int64).tolist())], ("k", "center"))
    givers = sorted({a for a, _ in given})
    own = assign_bits(points, book).where(F.col("k").isin(*givers))
    far = own.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("dist"), "kp_ind"))).where(F.col("place") <= len(given))
    farthest = {(r.k, r.place): r.kp_ind for r in far.select("k", "place", "kp_ind").collect()}
    seen: dict[int, int] = {}
    out = {}
    for largest, k in given:
        seen[largest] = seen.get(largest, 0) + 1
        out[farthest[largest, seen[largest]]] = k
    return out


def farthest_of_largest(assigned: DataFrame, by: str = "k", id_: str = "kp_ind") -> DataFrame:
    """(by, id, dist): of the largest cluster the farthest point; ties go to the lower cluster and id."""
    sizes = assigned.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(1)
    own = assigned.join(F.broadcast(sizes), by)
    return own.orderBy(F.desc("dist"), id_).limit(1).select(by, id_, "dist")


def two_nearest(points: DataFrame, medoids: DataFrame) -> DataFrame:
    """(id, medoid, d1, medoid2, d2) by Hamming distance; medoids (m, center) are few, which is checked."""
    book = F.broadcast(few(medoids).agg(F.collect_list(F.struct("m", "center")).alias("_book")))
    distance = _distance(points)
    order = F.array_sort(F.transform("_book", lambda b: F.struct(distance(F.col("bits"), b["center"]).alias("d"), b["m"].alias("m"))))
    two = points.crossJoin(book).withColumn("_o", order)
    return two.select("kp_ind", "bits", F.get("_o", F.lit(0))["m"].alias("medoid"), F.get("_o", F.lit(0))["d"].alias("d1"), F.get("_o", F.lit(1))["m"].alias("medoid2"), F.get("_o", F.lit(1))["d"].alias("d2"))


def cost(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("d1").cast("long").alias("cost"))


def _cost_of(points: DataFrame, medoids: list[Medoid]) -> int:
    return cost(two_nearest(points, _table(points.sparkSession, points, medoids))).first().cost


def _tiles(words: np.ndarray, value: np.ndarray) -> Iterator[tuple[slice, np.ndarray, slice]]:
    """(candidates, distances, points) of all pairs, PAIRS at once, in rows of at most WIDE points."""
    wide = even(len(value), WIDE)
    for lo in range(0, len(value), wide):
        here, tall = slice(lo, lo + wide), max(1, PAIRS // wide)
        for up in range(0, len(words), tall):
            yield slice(up, up + tall), differing(words[up : up + tall], value[here]), here


def _sums(far: np.ndarray, cuts: np.ndarray | tuple[int, ...] = (0,)) -> np.ndarray:
    """Sums of each row of distances from each of ``cuts`` to the next; of 1,000 of one word 16 bits hold them, which are quick to add."""
    if far.dtype != np.uint8 or far.max(initial=0) > 65:
        return np.add.reduceat(far, cuts, axis=1, dtype=np.int64)
    fine = np.union1d(cuts, np.arange(0, far.shape[1], 1000))
    return np.add.reduceat(np.add.reduceat(far, fine, axis=1, dtype=np.uint16), np.searchsorted(fine, cuts), axis=1, dtype=np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they hold GATHERED rows, none of them empty."""
    held: list[pa.RecordBatch] = []
    for batch in (b for b in batches if b.num_rows):
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def swap_costs(assigned: DataFrame, candidates: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """(h, m, delta): change of cost when candidate h takes medoid m's place, for all pairs; a pass for each block of candidates.

    Point j pays min(d(h,j) - d1, 0) whatever goes; where m is its own medoid it pays
    min(d(h,j), d2) - d1 instead. So a sum for each h and a correction for each (h, m). With
    one medoid there is no second.
    """

    def summed(ids: np.ndarray, words: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least: dict[int, np.ndarray] = {}
            paid: dict[int, np.ndarray] = {}
            for batch in _gathered(batches):  # in order of medoids, so that rows of pairs are long however many there are
                medoid = np.asarray(batch.column("medoid"))
                order = np.argsort(medoid, kind="stable")
                value, (names, starts) = matrix(batch.column("value"), np.uint64)[order], np.unique(medoid[order], return_index=True)
                most = 64 * words.shape[1]
                kind = np.min_scalar_type(most)
                d1, d2 = (np.minimum(np.asarray(batch.column(c).fill_null(most)), most).astype(kind)[order] for c in ("d1", "d2"))
                sums = np.zeros((2, len(ids), len(names)), np.int64)
                for at, far, here in _tiles(words, value):
                    own = slice(*(np.searchsorted(starts, (here.start, here.start + far.shape[1] - 1), "right") + (-1, 0)))
                    cuts = np.maximum(starts[own] - here.start, 0)
                    for into, d in zip(sums, (d1, d2), strict=True):
                        into[at, own] += _sums(np.minimum(far, d[here]), cuts)
                for i, m in enumerate(names.tolist()):
                    least[m] = least.get(m, 0) + sums[:, :, i]
                    paid[m] = paid.get(m, 0) + d1[medoid[order] == m].sum(dtype=np.int64)
            for m, (near, next_) in least.items():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), m)), pa.array(near - paid[m]), pa.array(next_ - near)], ["h", "medoid", "g", "l"])

        return run

    rows = spread(assigned.select("kp_ind", as_words(assigned, "bits").alias("value"), F.col("medoid").cast("long").alias("medoid"), F.col("d1").cast("int").alias("d1"), F.col("d2").cast("int").alias("d2")), "kp_ind")
    pool = candidates.select("kp_ind", as_words(candidates, "bits").alias("value"))
    out = "h long, medoid long, g long, l long"
    parts = [rows.mapInArrow(summed(np.asarray(ids), words), out) for ids, words in blocks(pool, "kp_ind", "value", np.uint64, block_bytes)]
    sums = reduce(DataFrame.union, parts) if parts else assigned.sparkSession.createDataFrame([], out)
    by = sums.groupBy("h", "medoid").agg(F.sum("g").alias("g"), F.sum("l").alias("l"))
    return by.select("h", F.col("medoid").alias("m"), (F.sum("g").over(Window.partitionBy("h")) + F.col("l")).cast("long").alias("delta"))


def best_swap(deltas: DataFrame) -> DataFrame:
    """The swap of least cost (h, m, delta); ties go to the lower h, then m."""
    return deltas.orderBy("delta", "h", "m").limit(1)


def best_swaps(deltas: DataFrame) -> DataFrame:
    """For each medoid its swap of least cost (m, h, delta); ties go to the lower h."""
    return deltas.groupBy("m").agg(F.min(F.struct("delta", "h")).alias("_b")).select("m", "_b.h", "_b.delta")


def _bits(batch: pa.RecordBatch) -> np.ndarray:
    """The bits of each descriptor as a row."""
    words = matrix(batch.column("value"), np.uint64)
    return np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")


def _plain_totals(points: DataFrame, pool: DataFrame) -> DataFrame:
    """(kp_ind, total): of each candidate the distances to all points, from how many of them have each bit; no pairs are met."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([_bits(batch).sum(0, dtype=np.int64).tolist()], pa.list_(pa.int64()))], ["n", "ones"])

    rows = points.select(as_words(points, "bits").alias("value")).where("value is not null")
    per_bit = rows.mapInArrow(counted, "n long, ones array<long>").select("n", F.posexplode("ones").alias("bit", "ones"))
    sums = per_bit.groupBy("bit").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).orderBy("bit").collect()
    n, ones = np.array([r.n for r in sums], np.int64), np.array([r.ones for r in sums], np.int64)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            total = _bits(batch).astype(np.int64) @ (n - 2 * ones) + ones.sum()
            yield pa.RecordBatch.from_arrays([batch.column("kp_ind").cast(pa.int64()), pa.array(total)], ["kp_ind", "total"])

    return (pool if len(n) else pool.limit(0)).mapInArrow(summed, "kp_ind long, total long")


def totals(points: DataFrame, candidates: DataFrame, chosen: list[Medoid] | None = None, block_bytes: int | None = None) -> DataFrame:
    """(kp_ind, total): for each candidate the points' distances to the nearest of it and the chosen, in blocks of candidates."""

    def summed(ids: np.ndarray, words: np.ndarray, held: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(ids), np.int64)
            for batch in _gathered(batches):
                value = matrix(batch.column("value"), np.uint64)
                near = differing(held, value).min(0)
                for at, far, here in _tiles(words, value):
                    sums[at] += _sums(np.minimum(far, near[here]))[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums)], ["kp_ind", "total"])

        return run

    pool = candidates.select("kp_ind", as_words(candidates, "bits").alias("value"))
    if not chosen:
        return _plain_totals(points, pool)
    rows = spread(points.select("kp_ind", as_words(points, "bits").alias("value")), "kp_ind")
    pool = pool.where(~F.col("kp_ind").isin(*[i for i, _ in chosen]))
    parts = [rows.mapInArrow(summed(np.asarray(ids), words, _words(chosen)), "kp_ind long, total long") for ids, words in blocks(pool, "kp_ind", "value", np.uint64, block_bytes)]
    sums = reduce(DataFrame.union, parts) if parts else points.sparkSession.createDataFrame([], "kp_ind long, total long")
    return sums.groupBy("kp_ind").agg(F.sum("total").alias("total"))


def distance_sums(points: DataFrame, candidates: DataFrame) -> DataFrame:
    """(kp_ind, total): of each candidate the distances to all points."""
    return totals(points, candidates)


def _added(points: DataFrame, candidates: DataFrame, chosen: list[Medoid]) -> list[Medoid]:
    """chosen and the candidate that lowers the cost most, the lower id of equals; one row comes to the driver."""
    best = totals(points, candidates, chosen).orderBy("total", "kp_ind").first()
    return chosen if best is None else [*chosen, (best.kp_ind, candidates.where(F.col("kp_ind") == best.kp_ind).first().bits)]


def build(points: DataFrame, k: int, candidates: DataFrame | None = None) -> list[Medoid]:
    """Greedy start: (id, bits) of k medoids; each next one lowers the cost most."""
    chosen: list[Medoid] = []
    for _ in range(k):
        chosen = _added(points, points if candidates is None else candidates, chosen)
    return chosen


def lab(points: DataFrame, k: int, seed: int = 0) -> list[Medoid]:
    """Greedy start over samples: each step draws ``10 + ceil(sqrt(n))`` rows afresh and takes of them what lowers their cost most.

    Draws are positions in the order of ids; a step whose draw holds medoids alone ends the search.
    """
    placed = kept(bow.numbered(points.select("kp_ind", "bits"), ["kp_ind"], 0))
    n, rng, chosen = placed.count(), Xoroshiro128(seed), []
    for _ in range(min(k, n)):
        drawn = points.sparkSession.createDataFrame([(x,) for x in rng.sample(10 + math.ceil(math.sqrt(n)), n)], "word_id long")
        part = kept(placed.join(drawn, "word_id").select("kp_ind", "bits"))
        now = _added(part, part, chosen)
        if len(now) == len(chosen):
            break
        chosen = now
    return chosen


def _others(pool: DataFrame, medoids: list[Medoid]) -> DataFrame:
    return pool.where(~F.col("kp_ind").isin(*[m for m, _ in medoids]))


def _replaced(medoids: list[Medoid], m: int, new: Medoid) -> list[Medoid]:
    return sorted([x for x in medoids if x[0] != m] + [new])


def pam(points: DataFrame, medoids: list[Medoid], rounds: int = 100, candidates: DataFrame | None = None) -> tuple[list[Medoid], int]:
    """Swaps until the cost falls no more; a swap is taken only if it lowers the cost. k rows and one cost at the driver."""
    pool = points if candidates is None else candidates
    now = None
    for _ in range(rounds):
        own = two_nearest(points, _table(points.sparkSession, points, medoids))
        now = cost(own).first().cost
        swap = best_swap(swap_costs(own, _others(pool, medoids))).join(pool.select(F.col("kp_ind").alias("h"), "bits"), "h").first()
        if swap is None or swap.delta >= 0:
            break
        medoids = _replaced(medoids, swap.m, (swap.h, swap.bits))
        now += swap.delta
    return medoids, now


def fast_pam(points: DataFrame, medoids: list[Medoid], rounds: int = 100, fasttol: float = 1.0, candidates: DataFrame | None = None) -> tuple[list[Medoid], int, int]:
    """(medoids, cost, rounds): PAM that takes several swaps a round.

    One pass gives each medoid its best swap. The best of all is taken; then the others, in
    order of their first gain, are costed again on what the medoids have become and taken
    if they still gain, at least (1 - fasttol) of the first gain. Costing one again passes
    over the points and k medoids, not over pairs. k rows at the driver.
    """
    pool, taken = points if candidates is None else candidates, 0
    now = _cost_of(points, medoids)
    while taken < rounds:
        taken += 1
        own = kept(two_nearest(points, _table(points.sparkSession, points, medoids)))
        swaps = best_swaps(swap_costs(own, _others(pool, medoids))).join(pool.select(F.col("kp_ind").alias("h"), "bits"), "h").where("delta < 0").collect()
        if not swaps:
            break
        for i, swap in enumerate(sorted(swaps, key=lambda s: (s.delta, s.h, s.m))):
            if any(x == swap.h for x, _ in medoids):
                continue
            new = _replaced(medoids, swap.m, (swap.h, swap.bits))
            after = now + swap.delta if not i else _cost_of(points, new)
            if after < now and after - now <= swap.delta * (1 - fasttol):
                medoids, now = new, after
    return medoids, now, taken


def _place(*parts) -> Column:
    """A seeded order that SQL and Python can repeat."""
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def sampled(points: DataFrame, n: int, seed: int, first: list[int] | None = None) -> DataFrame:
    """n rows: those of ``first``, once each, filled up by seeded hash of the id."""
    place = _place(F.lit(str(seed)), F.col("kp_ind").cast("string"))
    ahead = [(~F.col("kp_ind").isin(*first)).cast("int")] if first else []
    return points.orderBy(*ahead, place, "kp_ind").limit(n)


def clara(points: DataFrame, k: int, samples: int = 5, size: int | None = None, seed: int = 0, fast: bool = False) -> tuple[list[Medoid], int]:
    """PAM on samples that each hold the best medoids so far; the medoids of least cost over all points.

    Samples have 40 + 2k rows; with fast, FastPAM runs on 80 + 4k.
    """
    size = size or (80 + 4 * k if fast else 40 + 2 * k)
    best: tuple[list[Medoid], int] | None = None
    for i in range(samples):
        part = kept(sampled(points, size, seed + i, [m for m, _ in best[0]] if best else None).select("kp_ind", "bits"))
        found = fast_pam(part, build(part, k))[0] if fast else pam(part, build(part, k))[0]
        whole = _cost_of(points, found)
        if best is None or whole < best[1]:
            best = found, whole
    return best


def clarans(points: DataFrame, k: int, local: int = 2, rate: float | None = None, seed: int = 0, fast: bool = False) -> tuple[list[Medoid], int]:
    """Random-neighbour search: each start takes the first of its drawn swaps that helps, till a whole draw does not.

    A draw is afresh from all swaps of a medoid with another row, ceil(rate * k * (n - k)) of
    them (rate 0.0125), so it grows with the table. With fast a draw is of rows alone,
    ceil(rate * (n - k)) of them (rate 0.025), and each row meets all medoids at once: the
    first row whose best swap helps is taken. A draw is costed in parts, in its order, up to the
    part that has one. k rows and one swap at the driver.
    """
    spark, n, best = points.sparkSession, points.count(), None
    rate = rate or (0.025 if fast else 0.0125)
    retries = max(1, math.ceil(rate * (n - k) * (1 if fast else k)))
    for i in range(local):
        medoids = sorted((r.kp_ind, r.bits) for r in sampled(points, k, seed + 100 * i).select("kp_ind", "bits").collect())
        now, step = _cost_of(points, medoids), 0
        while n > k:
            step += 1
            others = _others(points, medoids).select(F.col("kp_ind").alias("h"), "bits")
            swaps = others if fast else others.withColumn("m", F.explode(F.array(*[F.lit(m).cast("long") for m, _ in medoids])))
            drawn = kept(swaps.withColumn("place", _place(F.lit(f"{seed + 100 * i + 1}|{step}"), *[F.col(c).cast("string") for c in (["h"] if fast else ["h", "m"])])).orderBy("place", "h", *([] if fast else ["m"])).limit(retries))
            own = two_nearest(points, _table(spark, points, medoids))
            swap, size, low = None, FIRST_SWAPS, ""
            while swap is None and low is not None:  # in parts by place, as the first that helps is wanted
                high = f"{size * 16**32 // ((n - k) * (1 if fast else k)):032x}" if size < retries else None
                part = drawn.where((F.col("place") >= low) & (F.lit(True) if high is None else F.col("place") < high))
                deltas = swap_costs(own, part.select(F.col("h").alias("kp_ind"), "bits").distinct())
                helps = deltas.where("delta < 0").join(part, ["h"] if fast else ["h", "m"])
                swap, size, low = helps.orderBy("place", "h", "delta", "m").first(), 16 * size, high
            if swap is None:
                break
            medoids = _replaced(medoids, swap.m, (swap.h, swap.bits))
            now += swap.delta
        if best is None or now < best[1]:
            best = medoids, now
    return best
