"""Sharding, token attribution and decontamination against plain loops, on nulls, repeated keys and long texts."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from lodestar.llm import decontaminate, sharding, token_counts

RNG = np.random.default_rng(21)
WORDS = ["the", "of"] * 30 + [f"w{i}é" for i in range(200)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def test_shards_by_hand(spark):
    weights, grown = {0: 1.0, 3: 2.5, 7: 0.5}, {0: 1.0, 3: 2.5, 7: 0.5, 9: 1.0}
    keys = [*range(-5, 300), None, None, 17, 17]

    def shard(key, of):
        name = "" if key is None else str(key)
        return min((-math.log((int(hashlib.md5(f"{name}|{s}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / w, s) for s, w in of.items())[1]

    df = spark.createDataFrame([(k, "x") for k in keys], "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.shard, r.grown_shard) for r in sharding.sharded(df, weights, grown).collect())
    assert got == Counter((k, shard(k, weights), shard(k, grown)) for k in keys)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_of_each_line(spark, rule):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(1, "one\ntwo\n\n\nthree 日本語\n🙂🙂\n"), (2, None), (2, ""), (3, "\n"), (None, "a\r\nb"), (None, "   \n\n   x"), (4, prose(500).replace(" the", "\n  the")), (5, "é" * 300 + "\n" * 50 + "🙂" * 40)]
    coder, _ = token_counts.encoder(path, pattern)

    def lines(text):
        parts = re.findall(r"[^\n]*\n|[^\n]+", text) or [""]
        line_of = [i for i, p in enumerate(parts) for _ in p]
        char_of = [i for i, c in enumerate(text) for _ in c.encode()]
        counts, at = [0] * len(parts), 0
        for token in coder.encode_ordinary(text):
            size = len(coder.decode_single_token_bytes(token))
            chars = sorted({char_of[i] for i in range(at, at + size)})
            held = Counter(line_of[c] for c in chars)
            counts[line_of[chars[0]] if rule == "first" else max(sorted(held), key=held.__getitem__)] += 1
            at += size
        return [(i, sum(map(len, parts[:i])), sum(map(len, parts[: i + 1])), n) for i, n in enumerate(counts)]

    df = spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id long, text string, section int")
    got = Counter(tuple(r) for r in token_counts.count_tokens(df, path, pattern, rule=rule).collect())
    assert got == Counter((k, *x) for k, t in rows for x in lines(t or ""))


def alignments(docs, items):
    """Best window of each document and item over all alignments: most agreeing words, then the earliest."""
    split = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    out = {}
    for key, text in docs:
        a = split(text)
        for item, other in items:
            b = split(other)
            width = min(len(b), 13)
            for shift in range(-len(b), len(a) + 1) if b and key is not None and item is not None else ():
                same = [0 <= shift + j < len(a) and a[shift + j] == w for j, w in enumerate(b)]
                for s in range(len(b) - width + 1):
                    agree = sum(same[s : s + width])
                    if agree >= (width if width < 13 else 11):
                        out[key, item] = max(out.get((key, item), (0, 0, 0)), (agree, width, -(shift + s)))
    return {k: (agree, width, -start) for k, (agree, width, start) in out.items()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_by_all_alignments(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    items = [(i, prose(int(n))) for i, n in enumerate(RNG.integers(1, 40, 12))] + [(50, None), (51, "..."), (None, prose(20)), (52, "the of the"), (53, "unseen")]
    docs = [(i, prose(120)) for i in range(15)]
    for i in range(12):
        words = items[i][1].split()
        for j in range(i % 4):
            words[(7 * j + i) % len(words)] = f"changed{j}"
        docs.append((100 + i, prose(i) + " " + " ".join(words) + (" " + prose(5) if i % 2 else "")))
    docs += [(200, prose(1500) + " " + items[3][1] + " " + prose(1500)), (201, None), (202, ""), (None, items[3][1]), (203, items[4][1]), (203, prose(30) + " " + items[5][1])]
    frames = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, item int").repartition(3), spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, h string")
    want: dict = {}
    for k, v in [x for d in docs for x in alignments([d], items).items()]:
        want[k] = max(want.get(k, (0, 0, 1)), v, key=lambda x: (x[0], -x[2]))
    got = {(r.doc_id, r.item_id): (r.agree, r.window, r.start) for r in decontaminate.contaminated(*frames).collect()}
    assert got == want and len(got) > 12
