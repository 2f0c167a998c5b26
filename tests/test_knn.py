"""Nearest neighbours in blocks and by sub-codes, against all distances in numpy."""

import numpy as np
import pytest
from lodestar.operators import knn as nn

RNG = np.random.default_rng(5)


def brute(far, k):
    out = {}
    for q, row in enumerate(far):
        for rank, b in enumerate(np.lexsort((np.arange(len(row)), row))[:k], 1):
            out[q, rank] = (int(b), float(row[b]))
    return out


def found(df):
    return {(r.q, r["rank"]): (r.b, float(r.dist)) for r in df.collect()}


@pytest.fixture(scope="module")
def descriptors():
    """256-bit rows: random ones, copies with a few turned bits, equal ones, and many that share whole words of zeros."""
    base = RNG.integers(-(2**63), 2**63, (300, 4), dtype=np.int64)
    base[200:] = 0
    base[200:, 3] = RNG.integers(0, 50, 100)
    base[10] = base[11]
    queries = base[::5].copy()
    for i, row in enumerate(queries[:30]):
        for bit in RNG.choice(256, i, replace=False):
            row[bit // 64] ^= np.int64(np.uint64(1 << int(bit % 64)).view(np.int64))
    queries = np.concatenate((queries, RNG.integers(-(2**63), 2**63, (10, 4), dtype=np.int64)))
    return queries, base, np.bitwise_count(queries.view(np.uint64)[:, None] ^ base.view(np.uint64)[None]).sum(2)


def frame(spark, rows, name, kind="long"):
    return spark.createDataFrame([(i, [x.item() for x in row], "x") for i, row in enumerate(rows)] + [(9999, None, "x")], f"{name} long, v array<{kind}>, query string").repartition(3)


@pytest.mark.parametrize("radius", [0, 1])
@pytest.mark.parametrize("most", [1.0, 0.1, 0.0])
def test_sub_codes(spark, descriptors, radius, most):
    queries, base, far = descriptors
    got = nn.hamming_knn(frame(spark, queries, "q"), frame(spark, base, "b"), 2, "v", "q", "b", radius, most, few_pairs=0)
    assert found(got) == brute(far, 2)


def test_sub_codes_spare_the_blocks(spark, descriptors, monkeypatch):
    """Near copies are settled by joins: only what they leave reaches the comparison with all rows."""
    queries, base, far = descriptors
    left = []
    whole = nn.knn
    monkeypatch.setattr(nn, "knn", lambda q, *a, **b: (left.append(q.count()), whole(q, *a, **b))[1])
    near = queries[:16]
    twice = np.concatenate((base[:200], base[:200]))
    got = found(nn.hamming_knn(frame(spark, near, "q"), frame(spark, twice, "b"), 2, "v", "q", "b", few_pairs=0))
    assert left == [0]
    assert got == brute(np.bitwise_count(near.view(np.uint64)[:, None] ^ twice.view(np.uint64)[None]).sum(2), 2)


@pytest.mark.parametrize("metric", ["l2", "l1", "hamming"])
def test_blocks(spark, descriptors, metric, monkeypatch):
    monkeypatch.setattr(nn, "PAIRS", 1000)
    if metric == "hamming":
        queries, base, far = descriptors
        kind = "long"
    else:
        queries, base, kind = RNG.normal(size=(40, 12)).round(1), RNG.normal(size=(200, 12)).round(1), "double"
        gap = queries[:, None] - base[None]
        far = np.round((gap**2).sum(2) if metric == "l2" else np.abs(gap).sum(2), 6)
    q, b = frame(spark, queries, "q", kind), frame(spark, base, "b", kind)
    for k, size in ((1, None), (5, 700), (1000, None)):
        got = nn.knn(q, b, metric, k, "v", "q", "b", None if metric == "hamming" else 6, block_bytes=size)
        assert found(got) == brute(far, k)


def test_no_cartesian_product(spark, descriptors):
    queries, base, _ = descriptors
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for metric, rows in (("hamming", (queries, base)), ("l2", (RNG.normal(size=(9, 3)), RNG.normal(size=(30, 3))))):
            kind = "long" if metric == "hamming" else "double"
            got = nn.knn(frame(spark, rows[0], "q", kind), frame(spark, rows[1], "b", kind), metric, 2, "v", "q", "b")
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Cartesian" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ids_of_any_kind_and_one_word(spark):
    q = spark.createDataFrame([((1, "a"), 3), ((1, "b"), 12)], "f struct<i: int, s: string>, bits long")
    b = spark.createDataFrame([(7, 1), (5, 2), (9, 15), (11, None)], "w long, bits long")
    want = {("a", 1): (5, 1), ("a", 2): (7, 1), ("b", 1): (9, 2), ("b", 2): (5, 3)}
    for got in (nn.knn(q, b, "hamming", 2, "bits", "f", "w"), nn.hamming_knn(q, b, 2, "bits", "f", "w", few_pairs=0), nn.hamming_knn(q, b, 2, "bits", "f", "w")):
        assert {(r.f.s, r["rank"]): (r.w, r.dist) for r in got.collect()} == want


def test_empty_and_uneven(spark):
    q, b = frame(spark, np.zeros((2, 3)), "q", "double"), frame(spark, np.zeros((2, 3)), "b", "double")
    assert nn.knn(q.limit(0), b, "l2", 2, "v", "q", "b").count() == nn.knn(q, b.limit(0), "l2", 2, "v", "q", "b").count() == 0
    ql, bl = frame(spark, np.zeros((2, 3), np.int64), "q"), frame(spark, np.zeros((2, 3), np.int64), "b")
    assert nn.hamming_knn(ql.limit(0), bl, 2, "v", "q", "b").count() == nn.hamming_knn(ql, bl.limit(0), 2, "v", "q", "b").count() == 0
    with pytest.raises(Exception, match="one length"):
        nn.knn(q, frame(spark, np.zeros((2, 4)), "b", "double"), "l2", 2, "v", "q", "b").collect()
    with pytest.raises(ValueError, match="rows cannot be held"):
        nn.few(spark.range(20), 10)


@pytest.mark.parametrize("metric", ["l2", "l1", "hamming"])
def test_many_queries_meet_many_rows_at_once(metric, monkeypatch):
    """A pass over the base takes it in pieces of many rows, however many queries there are; equal distances go to the lower id."""
    import pyarrow as pa

    kind, pairs = nn._METRICS[metric]
    rng, met = np.random.default_rng(2), []
    q, b = ((rng.integers(0, 4, (n, 64)).astype(kind)) for n in (8200, 60))
    monkeypatch.setitem(nn._METRICS, metric, (kind, lambda *a: (met.append(len(a[1])), pairs(*a))[1]))
    ids = rng.permutation(60)
    value = pa.array([x.tolist() for x in (b.view(np.int64) if kind is np.uint64 else b)], pa.list_(pa.int64() if kind is np.uint64 else pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), value], ["base", "value"])
    out = pa.Table.from_batches(nn._nearest_in(pa.array(range(len(q))), q, metric, 3, None)(iter([batch])))
    assert min(met) == 60
    far = nn.differing(q[:300], b).astype(float) if metric == "hamming" else (np.abs(q[:300, None] - b[None]) ** (2 if metric == "l2" else 1)).sum(2)
    want = [(i, int(ids[x]), far[i, x]) for i in range(300) for x in np.lexsort((ids, far[i]))[:3]]
    assert sorted(x for x in zip(*(out.column(c).to_pylist() for c in ("query", "base", "dist")), strict=True) if x[0] < 300) == sorted(want)


def test_a_base_in_one_piece_goes_to_all_cores(spark, descriptors):
    """Words of a map are one small file; the pairs that they make are not one task's. Values are taken once, not in each join."""
    queries, base, far = descriptors
    got = nn.hamming_knn(frame(spark, queries, "q"), frame(spark, base, "b").coalesce(1), 2, "v", "q", "b")
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert found(got) == brute(far, 2)
    joined = nn.hamming_knn(frame(spark, queries, "q"), frame(spark, base, "b").withColumn("v", nn.F.transform("v", lambda x: x + 0)), 2, "v", "q", "b", few_pairs=0)
    assert "transform" not in joined._jdf.queryExecution().optimizedPlan().toString() and found(joined) == brute(far, 2)


def test_neighbours_of_slices_are_joined_only_where_that_costs_less(spark, descriptors, monkeypatch):
    """Many rows that share slices: the second join is left out, with the same answer; where it is cheap it is made."""
    queries, base, far = descriptors
    q, b = frame(spark, queries, "q"), frame(spark, base, "b")
    copies, whole = [], nn.kept
    monkeypatch.setattr(nn, "kept", lambda df: (copies.append(df), whole(df))[1])
    for cost, many in ((nn.JOINED_COST, 4), (0, 6)):
        monkeypatch.setattr(nn, "JOINED_COST", cost)
        copies.clear()
        assert found(nn.hamming_knn(q, b, 2, "v", "q", "b", few_pairs=0)) == brute(far, 2)
        assert len(copies) == many


def test_more_pairs_go_to_more_tasks(spark, descriptors, monkeypatch):
    queries, base, far = descriptors
    monkeypatch.setattr(nn, "TASK_PAIRS", 1000)
    got = nn.hamming_knn(frame(spark, queries, "q"), frame(spark, base, "b"), 2, "v", "q", "b")
    assert f", {-(-len(queries) * len(base) // 1000)})" in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]
    assert found(got) == brute(far, 2)


@pytest.mark.parametrize("width", [1, 3, 4])
def test_first_rows_of_bits_are_not_sorted(width, monkeypatch):
    """The k lowest of a first tile come from the least of groups of places, not from an order of all pairs; many equal ones still go by place."""
    rng, met, whole = np.random.default_rng(4), [], np.partition
    q, b = (rng.integers(0, 2**63, (n, width), dtype=np.uint64) for n in (50, 9000))
    far = np.bitwise_count(q[:, None] ^ b[None]).sum(2)
    assert (nn.differing(q, b) == far).all()
    monkeypatch.setattr(np, "partition", lambda x, *a, **k: (met.append(x.shape[1]), whole(x, *a, **k))[1])
    i, j, dist = nn._hamming(q, b, np.full(50, np.inf), 2, None)
    assert met == [8] and (dist == far[i, j]).all()
    for row in range(50):
        assert set(np.lexsort((np.arange(9000), far[row]))[:2]) <= set(j[i == row])
    i, j, _ = nn._hamming(q, np.repeat(b[:1], 9000, 0), np.full(50, np.inf), 2, None)
    assert (i == np.repeat(np.arange(50), 2)).all() and (j == np.tile([0, 1], 50)).all()
    assert [nn.even(n, 8) for n in (0, 1, 8, 9, 17)] == [1, 1, 8, 5, 6]
