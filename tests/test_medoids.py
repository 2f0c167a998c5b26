"""Medoid searches and binary k-means over all vectors of a small table, against numpy."""

import hashlib
import math
from itertools import count

import numpy as np
import pytest
from lodestar.functions.random import Xoroshiro128
from lodestar.operators import cluster
from lodestar.plans import catalog
from lodestar.sources import tables


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("medoids"))
    x = np.random.default_rng(3).normal(size=(150, 64))
    spark.createDataFrame([(i, [float(y) for y in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{where}/embeddings.parquet")
    bits = x > 0
    return where, (bits[:, None] != bits[None]).sum(2)


def whole_cost(d, medoids):
    return int(d[:, medoids].min(1).sum())


def best_swap_cost(d, medoids):
    return min(whole_cost(d, [h if x == m else x for x in medoids]) for m in medoids for h in set(range(len(d))) - set(medoids))


def test_fastpam_is_over_all_vectors(spark, small):
    got = catalog.QUERIES["fastpam"](spark, small[0]).collect()
    medoids = [r.medoid for r in got]
    assert {r.cost for r in got} == {whole_cost(small[1], medoids)} and best_swap_cost(small[1], medoids) >= got[0].cost


def test_clarans_draws_from_all_swaps(spark, small):
    got = catalog.QUERIES["clarans"](spark, small[0]).collect()
    assert {r.cost for r in got} == {whole_cost(small[1], [r.medoid for r in got])}
    points = tables.vectors(spark, small[0]).select("kp_ind", "bits").persist()
    medoids, cost = cluster.clarans(points, 3, local=1, rate=1.0)
    medoids = [m for m, _ in medoids]
    assert cost == whole_cost(small[1], medoids) and best_swap_cost(small[1], medoids) >= cost


def build(d, k):
    chosen = []
    for _ in range(k):
        near = d[:, chosen].min(1) if chosen else np.full(len(d), 1 << 30)
        sums = np.minimum(d, near[:, None]).sum(0)
        sums[chosen] = 1 << 40
        chosen.append(int(np.argmin(sums)))
    return chosen


def deltas(d, medoids):
    """{(h, m): change}, each taken from the whole cost."""
    now = whole_cost(d, medoids)
    return {(h, m): whole_cost(d, [h if x == m else x for x in medoids]) - now for h in set(range(len(d))) - set(medoids) for m in medoids}


def pam(d, medoids):
    for rounds in count(1):
        delta, h, m = min((v, h, m) for (h, m), v in deltas(d, medoids).items())
        if delta >= 0:
            return sorted(medoids), rounds
        medoids = [h if x == m else x for x in medoids]


def fast_pam(d, medoids, tol=1.0):
    for rounds in count(1):
        found = deltas(d, medoids)
        best = sorted(min((v, h, m) for (h, m), v in found.items() if m == own) for own in medoids)
        best = [b for b in best if b[0] < 0]
        if not best:
            return sorted(medoids), rounds
        for i, (gain, h, m) in enumerate(best):
            if h in medoids:
                continue
            new = [h if x == m else x for x in medoids]
            change = whole_cost(d, new) - whole_cost(d, medoids)
            if not i or (change < 0 and change <= gain * (1 - tol)):
                medoids = new


def order(seed, ids):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest())


def points_of(spark, small):
    return tables.vectors(spark, small[0]).select("kp_ind", "bits")


def ids(found):
    return sorted(m for m, _ in found)


@pytest.mark.parametrize("start, tol", [([0, 1, 2, 3], 1.0), ([9, 30, 60, 90, 120, 149], 1.0), ([9, 30, 60, 90, 120, 149], 0.2)])
def test_fast_pam_takes_several_swaps_a_round(spark, small, start, tol):
    v = points_of(spark, small).persist()
    rows = {r.kp_ind: r.bits for r in v.collect()}
    found, cost, rounds = cluster.fast_pam(v, [(i, rows[i]) for i in start], fasttol=tol)
    assert (ids(found), rounds) == fast_pam(small[1], start, tol)
    assert cost == whole_cost(small[1], ids(found)) and best_swap_cost(small[1], ids(found)) >= cost
    plain, plain_rounds = pam(small[1], start)
    assert ids(cluster.pam(v, [(i, rows[i]) for i in start])[0]) == plain
    if tol == 1.0:
        assert rounds <= plain_rounds - (len(start) > 4) and cost <= 1.01 * whole_cost(small[1], plain)
    v.unpersist()


@pytest.mark.parametrize("fast", [False, True])
def test_clara(spark, small, fast):
    d, best = small[1], None
    for i in range(3):
        size = 92 if fast else 46
        first = best or []
        part = first + [x for x in order(4 + i, range(len(d))) if x not in first][: size - len(first)]
        part = sorted(part)
        inner = d[np.ix_(part, part)]
        medoids, _ = (fast_pam if fast else pam)(inner, build(inner, 3))
        medoids = sorted(part[m] for m in medoids)
        if best is None or whole_cost(d, medoids) < whole_cost(d, best):
            best = medoids
    found, cost = cluster.clara(points_of(spark, small), 3, samples=3, seed=4, fast=fast)
    assert (ids(found), cost) == (best, whole_cost(d, best))


def test_sample_is_filled_up(spark, small):
    got = [r.kp_ind for r in cluster.sampled(points_of(spark, small), 20, 3, [5, 7, 5, 149]).collect()]
    want = [x for x in order(3, range(150)) if x in (5, 7, 149)] + [x for x in order(3, range(150)) if x not in (5, 7, 149)]
    assert got == want[:20]
    assert cluster.sampled(points_of(spark, small), 999, 3, [5]).count() == 150


def test_fast_clarans(spark, small):
    d = small[1]
    retries = math.ceil(0.1 * 147)
    medoids = sorted(order(6, range(150))[:3])
    for step in count(1):
        found = deltas(d, medoids)
        drawn = sorted(set(range(150)) - set(medoids), key=lambda h: hashlib.md5(f"7|{step}|{h}".encode()).hexdigest())[:retries]
        helps = [(min((found[h, m], m) for m in medoids), h) for h in drawn]
        swap = next(((h, m) for (v, m), h in helps if v < 0), None)
        if swap is None:
            break
        medoids = sorted([x for x in medoids if x != swap[1]] + [swap[0]])
    got, cost = cluster.clarans(points_of(spark, small), 3, local=1, rate=0.1, seed=6, fast=True)
    assert (ids(got), cost) == (medoids, whole_cost(d, medoids))


def test_lab_draws_afresh_each_step(spark, small):
    d, rng, chosen = small[1], Xoroshiro128(12), []
    for _ in range(5):
        part = sorted(rng.sample(10 + math.ceil(math.sqrt(150)), 150))
        near = d[np.ix_(part, chosen)].min(1) if chosen else np.full(len(part), 1 << 30)
        sums = {h: int(np.minimum(d[part, h], near).sum()) for h in part if h not in chosen}
        chosen.append(min(sums, key=lambda h: (sums[h], h)))
    assert [m for m, _ in cluster.lab(points_of(spark, small), 5, 12)] == chosen


def kmajority(bits, centers, rounds=100):
    n, k = len(bits), len(centers)
    far = lambda c: (bits[:, None] != c[None]).sum(2)
    own = far(centers).argmin(1)
    for number in range(1, rounds + 1):
        for c in range(k):
            if (own == c).any():
                centers[c] = 2 * bits[own == c].sum(0) > (own == c).sum()
        dist = far(centers)
        new = dist.argmin(1)
        done = (new == own).all()
        own = new
        for c in range(k):
            if not (own == c).any():
                largest = np.bincount(own, minlength=k).argmax()
                mine = np.flatnonzero(own == largest)
                own[mine[dist[mine, largest].argmax()]] = c
        if done:
            break
    return centers, np.bincount(own, minlength=k), number, done


@pytest.mark.parametrize("width, start", [(1, [0, 0, 0, 7, 7]), (3, [5, 6, 7, 8, 9, 10, 11, 12])])
def test_kmajority(spark, width, start):
    """Equal first centers leave clusters empty, which are refilled; descriptors of one word and of three."""
    rng = np.random.default_rng(8)
    bits = rng.random((90, 64 * width)) < rng.random((1, 64 * width))
    bits[60:] = bits[:30] ^ (rng.random((30, 64 * width)) < 0.05)
    words = np.packbits(bits, axis=1, bitorder="little").view(np.int64).tolist()
    kind = "long" if width == 1 else "array<long>"
    rows = [w[0] if width == 1 else w for w in words]
    v = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"kp_ind long, bits {kind}").repartition(3)
    for rounds in (1, 100):
        centers, sizes, number, done = kmajority(bits, bits[start].copy(), rounds)
        got, mine, converged = cluster.kmajority(v, len(start), start=[rows[i] for i in start], rounds=rounds)
        want = np.packbits(centers, axis=1, bitorder="little").view(np.int64).tolist()
        assert [(k, b, n) for k, b, n in got] == [(k, w[0] if width == 1 else w, n) for k, (w, n) in enumerate(zip(want, sizes.tolist(), strict=True))]
        assert (mine, converged) == (number, done)
    few = v.where("kp_ind < 2")
    assert [b for _, b, _ in cluster.kmajority(few, 5)[0]] == [rows[i % 2] for i in range(5)]
    assert cluster.kmajority(v.limit(0), 3) == ([], 0, True)


def test_wide_descriptors_and_blocks(spark):
    """Medoid steps on 256 bits, candidates in many blocks."""
    rng = np.random.default_rng(2)
    words = rng.integers(-(2**63), 2**63, (60, 4), dtype=np.int64)
    d = np.bitwise_count(words.view(np.uint64)[:, None] ^ words.view(np.uint64)[None]).sum(2).astype(int)
    v = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(words)], "kp_ind long, bits array<long>").repartition(3)
    medoids = cluster.build(v, 3)
    assert [m for m, _ in medoids] == build(d, 3)
    own = cluster.two_nearest(v, cluster._table(spark, v, medoids))
    chosen = [m for m, _ in medoids]
    got = {(r.h, r.m): r.delta for r in cluster.swap_costs(own, v.where(~v.kp_ind.isin(chosen)), block_bytes=500).collect()}
    assert got == deltas(d, chosen)
    assert {r.kp_ind: r.total for r in cluster.totals(v, v, block_bytes=500).collect()} == dict(enumerate(d.sum(0).tolist()))


def test_swap_cost_meets_one_candidate(spark, small, monkeypatch):
    met, whole = [], cluster.swap_costs
    monkeypatch.setattr(cluster, "swap_costs", lambda own, pool, *a: (met.append(pool.count()), whole(own, pool, *a))[1])
    got = catalog.QUERIES["swap_cost"](spark, small[0]).collect()
    assert met == [1] and [tuple(r) for r in got] == [(10, 2, deltas(small[1], [0, 1, 2, 3])[10, 2])]


def test_points_in_one_piece_go_to_all_cores(spark, small):
    points = points_of(spark, small).coalesce(1)
    medoids = [(m, b) for m, b in sorted((r.kp_ind, r.bits) for r in points.where("kp_ind < 3").collect())]
    found = cluster.swap_costs(cluster.two_nearest(points, cluster._table(spark, points, medoids)), points.where("kp_ind >= 3"))
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.h, r.m): r.delta for r in found.collect()} == deltas(small[1], [0, 1, 2])


def test_first_medoid_meets_no_pairs(spark, small, monkeypatch):
    monkeypatch.setattr(cluster, "blocks", lambda *a: 1 / 0)
    points = points_of(spark, small)
    assert {r.kp_ind: r.total for r in cluster.distance_sums(points, points).collect()} == dict(enumerate(small[1].sum(0).tolist()))


def test_clarans_costs_a_draw_in_parts(spark, small, monkeypatch):
    met, whole = [], cluster.swap_costs
    monkeypatch.setattr(cluster, "swap_costs", lambda own, pool, *a: (met.append(pool.count()), whole(own, pool, *a))[1])
    want = cluster.clarans(points_of(spark, small), 2, local=1, rate=0.5)
    at_once, met[:] = list(met), []
    monkeypatch.setattr(cluster, "FIRST_SWAPS", 8)
    assert cluster.clarans(points_of(spark, small), 2, local=1, rate=0.5) == want
    assert min(at_once) > 90 and min(met) < 20


@pytest.mark.parametrize("width", [1, 3, 4])
def test_tiles_have_long_rows(width):
    """Numpy meets rows of some thousand points several times as fast as short ones; sums of bytes hold at every distance."""
    rng = np.random.default_rng(6)
    words, value = (rng.integers(0, 2**63, (n, width), dtype=np.uint64) for n in (70, 9000))
    value[:2000] = ~words[0]
    far, met = np.bitwise_count(words[:, None] ^ value[None]).sum(2).astype(int), np.zeros((70, 9000), int)
    for at, part, here in cluster._tiles(words, value):
        assert part.shape[1] >= 4000
        met[at, here] = part
        cuts = [0, 7, 2500, 2501]
        assert (cluster._sums(part, cuts) == np.add.reduceat(far[at, here], cuts, axis=1)).all() and (cluster._sums(part)[:, 0] == far[at, here].sum(1)).all()
    assert (met == far).all()


def test_tasks_gather_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(cluster, "GATHERED", 4)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64())], ["x"]) for n in (0, 3, 0, 2, 1, 0)]
    assert [t.column("x").to_pylist() for t in cluster._gathered(iter(batches))] == [[0, 1, 2, 0, 1], [0]]


def test_totals_meet_gathered_batches(spark, small, monkeypatch):
    """A pass of the greedy start meets all points of a task at once, however small Spark's batches are."""
    points = points_of(spark, small)
    first = [(r.kp_ind, r.bits) for r in points.where("kp_ind = 4").collect()]
    batch = cluster.pa.RecordBatch.from_arrays([cluster.pa.array([[r.bits] for r in points.orderBy("kp_ind").collect()])], ["value"])
    rows, met, whole = [], [], cluster._tiles
    monkeypatch.setattr(cluster, "_tiles", lambda words, value: (met.append(len(value)), whole(words, value))[1])
    monkeypatch.setattr(cluster.DataFrame, "mapInArrow", lambda df, run, schema: (rows.extend(run(batch.slice(i, 10) for i in range(0, 150, 10))), spark.createDataFrame([], schema))[1], raising=False)
    monkeypatch.setattr(type(points), "mapInArrow", cluster.DataFrame.mapInArrow)
    cluster.totals(points, points, first)
    got = dict(zip(*(x.to_pylist() for x in rows[0].columns), strict=True))
    assert met == [150] and got == {h: int(np.minimum(small[1][h], small[1][4]).sum()) for h in range(150) if h != 4}
