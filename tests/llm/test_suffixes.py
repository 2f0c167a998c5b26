"""Suffix arrays against sorted suffixes, and the removal of repeated strings against all windows of all texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from lodestar.llm import suffixes

RNG = np.random.default_rng(7)


def built():
    words = [f"wörd{i}" for i in range(3000)]
    prose = lambda n, seed: " ".join(np.random.default_rng(seed).choice(words, n))
    shared, long = prose(60, 1), prose(3000, 2)
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 199), (4, "b" * 200), (5, "c" * 201), (6, "xyz" * 500), (7, long), (8, long), (9, long), (None, "null key " + shared), (10, prose(40, 3) + shared + prose(40, 4))]
    rows += [(11, prose(20, 5) + shared), (12, shared + shared), (13, "日本語" * 90 + prose(30, 6)), (14, "日本語" * 90), (15, prose(50, 7) + "\x00" * 250), (16, prose(200, 8)), (16, prose(200, 8)), (17, prose(200, 8)), (17, "another text of the same key " + prose(50, 9))]
    rows += [(100 + i, prose(20 + i, 50 + i) + " " + shared[: 260 + i] + prose(20, 90 + i)) for i in range(30)]
    base = prose(150, 20).split()
    for i in range(10):
        base[int(RNG.integers(150))] = f"new{i}"
        rows.append((200 + i, " ".join(base)))
    return rows


ROWS = built()


def expected(rows, window):
    texts = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for k, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
        out.append((k, len(t), bytes(np.frombuffer(t, np.uint8)[~gone]), tuple(edges.tolist())))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.n_bytes, bytes(r.kept), tuple(r.spans)) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x", 1, b"y") for k, t in ROWS], "doc_id long, text string, row string, spot int, kept binary").repartition(3)


@pytest.mark.parametrize("options", [{}, {"group_limit": 1}, {"group_limit": 2}, {"group_limit": 8, "sort_bytes": 1, "bucket_bytes": 5000}, {"window": 64, "seed": 8}, {"window": 50, "seed": 50}])
def test_repeats(docs, options):
    assert found(suffixes.remove_repeats(docs, **options)) == expected(ROWS, options.get("window", 200))


def test_empty(docs):
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0
    assert found(suffixes.remove_repeats(docs.where("doc_id < 4"))) == expected([r for r in ROWS if r[0] is not None and r[0] < 4], 200)


def test_texts_longer_than_a_part(spark, monkeypatch):
    """A text in parts: repeats within it, and with a text that is cut elsewhere."""
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 1000)
    text = "".join(chr(97 + i) for i in np.random.default_rng(1).integers(0, 26, 9000))
    text = text + text[2500:3300] + "é"
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    whole = suffixes.stretches(data, offsets)
    parts = []
    for part, own, doc, at in suffixes._pieces(data, offsets, 200):
        name, _, of, place, count, _ = suffixes.stretches(part, own)
        assert doc == 0 and not of.any()
        parts += [(n, p + i) for n, p, c in zip(name.tolist(), (at + place).tolist(), count.tolist(), strict=True) for i in range(c)]
    assert parts == [(n, p + i) for n, p, c in zip(whole[0].tolist(), whole[3].tolist(), whole[4].tolist(), strict=True) for i in range(c)]


@pytest.mark.parametrize("step", suffixes.FINER)
def test_finer_names(step):
    """Parts cover the stretches' windows once, and equal windows have equal names."""
    text = np.frombuffer("".join(np.random.default_rng(2).choice([f"w{i} " for i in range(40)], 900)).encode() * 2, np.uint8)
    _, _, _, place, count, offset = suffixes.stretches(text, np.array([0, len(text)]))
    name, _, begin, n, at = suffixes.finer(text, place, count, offset, 200, step)
    windows = [(p + i, x) for p, k, x in zip(begin.tolist(), n.tolist(), name.tolist(), strict=True) for i in range(k)]
    assert [p for p, _ in sorted(windows)] == list(range(len(text) - 199))
    assert (at < 169).all() and (n <= step).all()
    named = {}
    assert all(named.setdefault(text[p : p + 200].tobytes(), x) == x for p, x in windows)


@pytest.mark.parametrize("letters", [1, 2, 4, 256])
def test_suffix_array(letters):
    for n in (1, 2, 3, 50, 700):
        data = RNG.integers(0, letters, n).astype(np.uint8).tobytes()
        if n > 300:
            data = data[:200] * 2 + data[:150] + data
        got = suffixes.suffix_array(np.frombuffer(data, np.uint8), len(data) + 16).tolist()
        assert got == sorted(range(len(data)), key=lambda i: data[i:])


def test_common_prefixes():
    data = (b"abcabcabcabc" * 20 + b"abd") * 2
    text = np.frombuffer(data, np.uint8)
    a, b = RNG.integers(0, len(data) - 100, 300), RNG.integers(0, len(data) - 100, 300)
    naive = [next((i for i in range(61) if data[x + i] != data[y + i]), 61) for x, y in zip(a, b, strict=True)]
    assert suffixes.common_prefixes(text, a, b, 61).tolist() == naive


def test_direct_share():
    """Only suffixes smaller than their successors are sorted directly."""
    text = np.frombuffer(b"mississippi", np.uint8)
    assert suffixes._smaller(text).tolist() == [b"mississippi"[i:] < b"mississippi"[i + 1 :] for i in range(11)]


def test_query_digests(spark, tmp_path):
    from lodestar.llm import queries

    spark.createDataFrame([(k, t) for k, t in ROWS], "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in queries.op11_suffix_dedup(spark, str(tmp_path)).collect())
    assert got == Counter({(k, n, n - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest()): c for (k, n, kept, spans), c in expected(ROWS, 200).items()})
