"""The filter audit against a direct simulation of all orders, on copies that span ranges, nulls and odd texts."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from lodestar.llm import audit
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def build():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)] + ["É", "Über", "$5", "A"]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(1, None, "a"), (2, "", None), (3, "", ""), (4, " \t\n", "a"), (5, "x\x00y " * 80, "b"), (6, "ALL CAPS " * 40, "b"), (7, "a b" * 4000, "a")]
    rows += [(100 + i, "copy of one text " * 20, "abc"[i % 3]) for i in range(60)]
    rows += [(50 + i, "copy of one text " * 20, "c") for i in range(3)] + [(None, "copy of one text " * 20, "a"), (None, "alone", "a"), (None, "alone", "a")]
    rows += [(300, "twice the same key", "a"), (300, "twice the same key", "a"), (301, "twice the same key", "b")]
    rows += [(400 + i, text(30 + 2 * i), "abc"[i % 3]) for i in range(40)]
    return rows


ROWS = build()
LABELS = [(k, int(k % 3 == 0), int(k % 5 == 0)) for k, _, _ in ROWS if k and k % 2] + [(50, 1, 1), (50, 0, 0), (9999, 1, 1), (None, 1, 1)]


def expected(rows, labels):
    masks = []
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    for k, t, p in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and least[t] < k}
        masks.append((k, p or "", {x for x, y in fails.items() if y}))
    good, toxic = {k for k, g, _ in labels if g and k is not None}, {k for k, _, x in labels if x and k is not None}
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in masks}:
        mine = [(k, f) for k, p, f in masks if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for i, x in enumerate(order):
                gone = [(k, f) for k, f in left if x in f]
                left = [(k, f) for k, f in left if x not in f]
                shapley[part, x] += len(gone)
                all_fails = sum(x in f for _, f in mine)
                out[part, order, i + 1] = [len(left), len(gone), all_fails - len(gone), sum(f == {x} for _, f in mine), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone)]
    return {(p, o, i): (*v, shapley[p, o[i - 1]]) for (p, o, i), v in out.items()}


@pytest.fixture
def spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(k, t, p, 1, "x", 2) for k, t, p in rows], "doc_id long, text string, source string, slot int, digest string, mask int").repartition(3)
    return docs, spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")


def test_every_order(spread):
    docs, labels = tables(spread, ROWS, LABELS)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(docs, labels).collect()}
    assert got == expected(ROWS, LABELS)
    assert len(got) == 4 * 600


def test_copies_over_range_bounds(spread):
    """One text in all rows: the ranges cut its copies, and only the least key stays."""
    rows = [(i, "the same words " * 30, "a") for i in range(500)]
    docs, _ = tables(spread, rows, LABELS)
    masks = audit.failures(docs)
    assert [r.doc_id for r in masks.where(F.col("mask").bitwiseAND(16) == 0).collect()] == [0]


def test_empty(spark):
    docs, labels = tables(spark, ROWS, LABELS)
    assert audit.audit(docs.limit(0), labels).count() == 0
    got = audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count(F.lit(1))).first()
    assert tuple(got) == (0, 0, 2400)


def test_counters_add_up(spark):
    docs, labels = tables(spark, ROWS, LABELS)
    masks = audit.failures(docs).cache()
    whole = {(r.part, r.mask): (r.n, r.good, r.toxic) for r in audit.counters(masks, labels).collect()}
    halves = Counter()
    for side in (masks.where("part < 'b'"), masks.where("part >= 'b'")):
        for r in audit.counters(side, labels).collect():
            for i, v in enumerate((r.n, r.good, r.toxic)):
                halves[r.part, r.mask, i] += v
    assert {(p, m, i): v[i] for (p, m), v in whole.items() for i in range(3)} == dict(halves)
    masks.unpersist()
