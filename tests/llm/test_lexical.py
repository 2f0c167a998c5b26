"""Ranked search against scores taken one by one, with ties, nulls, many shards and many blocks."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from lodestar.llm import lexical
from lodestar.llm.scratch import Scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def build():
    rng = np.random.default_rng(11)
    words = np.array([f"w{i}" for i in range(500)] + ["Éa", "İx", "日本語", "a-b", "X_y", "42"])
    share = 1 / np.arange(1, len(words) + 1)
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 200)), p=share / share.sum()))) for i in range(400)]
    rows += [(1000 + i, "the same tie w400 w401") for i in range(120)]
    rows += [(5000, None), (5001, ""), (5002, " -- \x00\t"), (None, "w400 w401 null key"), (5003, "w7 " * 30000), (5004, "one"), (5004, "one"), (5004, "w401 w402 one")]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(1, 40)), p=share / share.sum()))) for i in range(30)]
    items += [(100, "w400 W401 w401"), (101, None), (102, "..."), (103, "zzz unknown"), (104, "w0 the"), (105, "one"), (105, "w402"), (None, "w3 w4")]
    return rows, items


ROWS, ITEMS = build()


def expected(rows, items, k=50):
    counted = [(key, Counter(terms(t))) for key, t in rows]
    docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = {}
    for i, mine in wanted.items():
        found = []
        for key, c in counted:
            m = 50 + 50 * sum(c.values()) * docs // total
            score = sum(math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in mine if c[t])
            if score > 0:
                found.append((-score, key is None, key))
        for rank, (score, _, key) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[i, rank] = (key, -score)
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in ROWS], "doc_id long, text string, item long, key string, score int").repartition(3)
    return docs, spark.createDataFrame([(i, t, 3) for i, t in ITEMS], "item_id long, text string, doc_id long")


def rows_of(df):
    return {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in df.collect()}


@pytest.mark.parametrize("shard_bytes", [2000, 1 << 23])
@pytest.mark.parametrize("block_terms", [40, 1 << 18])
def test_all_ranks(spark, tables, shard_bytes, block_terms):
    docs, items = tables
    df = lexical.ranked(docs, items, Scratch(spark, "lexical"), block_terms=block_terms, shard_bytes=shard_bytes)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    rows = df.collect()
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}
    assert len(got) == len(rows)
    assert got == expected(ROWS, ITEMS)


def test_full_index_serves_other_items(spark, tables):
    docs, items = tables
    shards = lexical.index(docs, Scratch(spark, "lexical"), shard_bytes=5000)
    assert shards.count() > 3
    assert rows_of(lexical.search(shards, items, k=7)) == expected(ROWS, ITEMS, 7)
    assert rows_of(lexical.search(shards, items.where("item_id = 100"), k=200)) == expected(ROWS, [x for x in ITEMS if x[0] == 100], 200)


def test_empty(spark, tables):
    docs, items = tables
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id = 5002"), items), (docs, items.where("item_id = 103"))):
        assert lexical.ranked(d, i, Scratch(spark, "lexical")).count() == 0


def test_bounds_save_postings():
    """A rare term lifts the least score over what a frequent one can add: its list is probed for candidates alone."""
    rare, often = (np.array([3, 50]), np.array([900, 800]), 900), (np.arange(1000), np.full(1000, 5), 5)
    best, keys, sums = lexical._Best(2), np.arange(1000), np.zeros(1000, np.int64)
    first = lexical.max_score([rare, often], sums, best, keys)
    assert first == 1002 and not sums.any()
    assert lexical.max_score([rare, often], sums, best, keys + 5000) <= 4 and not sums.any()
    assert best.scores.tolist() == [905, 905] and best.keys.tolist() == [3, 5003]
