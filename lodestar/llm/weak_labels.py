"""Quality classifier from weak labels.

Overlapping heuristic labellers speak against a document or stay silent. For each of two
questions, junk and toxic, expectation-maximisation over the counts of vote patterns,
taken over all documents, estimates how often each labeller speaks on good documents and
on each kind of bad ones; nothing but a count of one or two stands behind the estimates.
The posterior of a document's votes is its label for a hashed linear scorer of its words
and statistics, without the votes, which is fitted on a bounded sample and decides about
every document.

Where labelled documents are given, one half of them teaches the toxic word lists of some
labellers. The other half anchors the estimation: these documents keep their class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.scratch import Scratch
from lodestar.llm.words import _TABLES, Words, between, chunks, mix, prefix, release, texts, tidy

DIM_BITS = 16
#: At most so many documents teach the scorers, half of them such as some labeller speaks against.
SAMPLE = 6000
#: At most so many labelled documents teach the word lists, those of least key hash.
LABELLED = 20_000
#: Texts of about so many bytes are scored at a time.
SCORED_BYTES = 1 << 18
HEAD_BYTES = (5, 7, 9)
#: Words of open insult; two overlapping lists for two labellers.
INSULTS = ("idiot", "moron", "stupid", "clown", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "dumb", "imbecile", "filthy", "vermin", "retard", "bastard", "bitch", "asshole")
STRONG_INSULTS = ("idiot", "moron", "scum", "worthless", "pathetic", "loser", "imbecile", "vermin", "retard", "bastard", "bitch", "asshole")
PERSONAL_INSULTS = ("stupid", "clown", "trash", "disgusting", "idiot", "loser", "dumb", "filthy", "moron", "scum")

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SYMBOL = np.isin(_BYTES, np.frombuffer(b"!#$%&*+/<=>@\\^_`{|}~", np.uint8))

#: name, statistic, bad beyond; statistics are fractions of a document.
JUNK_RULES = (
    ("shouting", "upper", 0.30),
    ("symbols", "symbols", 0.05),
    ("marked words", "marked", 0.20),
    ("bare marks", "bare", 0.15),
    ("repeats", "repeats", 0.20),
    ("few letters", "other", 0.45),
)
#: name, list that it looks for, least finds, least finds for each run of letters.
TOXIC_RULES = (
    ("any insult", 0, 1, 0.0),
    ("strong insult", 1, 1, 0.0),
    ("personal insult", 2, 1, 0.0),
    ("taught word", 3, 1, 0.006),
    ("taught words", 3, 2, 0.012),
    ("taught beginning", 4, 1, 0.008),
    ("doubtful beginnings", 5, 2, 0.012),
)
#: Brings the sums of weights over the root of the number of features near the range of logits.
_SCALE = 10.0
LABELLERS = len(JUNK_RULES) + len(TOXIC_RULES)


def word_hashes(words: tuple[str, ...]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.sort(Words(data, np.array([0, len(data)]), lower=True).hashes)


_LISTS = tuple(word_hashes(x) for x in (INSULTS, STRONG_INSULTS, PERSONAL_INSULTS))


def letter_runs(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Text index of each run of letters, and hashes of the whole run and of its beginnings (0 where shorter), from the bytes' sums."""
    code = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(code & (edge[:-1] | ~np.concatenate(([False], code[:-1]))[: len(code)]))
    end = np.flatnonzero(code & (edge[1:] | ~np.concatenate((code[1:], [False]))[: len(code)])) + 1
    heads = [np.where(end - begin > n, between(sums, begin, np.minimum(begin + n, end)) ^ np.uint64(n), np.uint64(0)) for n in HEAD_BYTES]
    return np.searchsorted(offsets, begin, "right") - 1, [between(sums, begin, end), *heads]


class Lists:
    """Sorted hashes: toxic words, word beginnings that few clean documents have, and beginnings that some have."""

    def __init__(self, words: np.ndarray, heads: np.ndarray, doubtful: np.ndarray):
        self.words, self.heads, self.doubtful = words, heads, doubtful


NOTHING_TAUGHT = Lists(*[np.zeros(0, np.uint64)] * 3)


def _among(hashes: np.ndarray, list_: np.ndarray) -> np.ndarray:
    """Which hashes a sorted list holds."""
    if not len(list_):
        return np.zeros(len(hashes), bool)
    return list_[np.minimum(np.searchsorted(list_, hashes), len(list_) - 1)] == hashes


class _Chunk:
    """Statistics, votes and hashed features of a run of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        hashed = prefix(_TABLES[True][data])
        w = Words(data, offsets, lower=True, sums=hashed)
        doc = np.repeat(np.arange(n), w.counts)
        many = np.maximum(w.counts, 1)

        def part(mask: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(mask)))
            return np.diff(sums[offsets])

        def of_words(mask: np.ndarray) -> np.ndarray:
            return np.bincount(doc[mask], minlength=n) / many

        letters, sums = part(_LETTER[data]), np.concatenate(([0], np.cumsum(_SYMBOL[data])))
        solid = np.concatenate(([0], np.cumsum(_LETTER[data] | _DIGIT[data])))
        length = np.maximum(np.diff(offsets), 1)
        tail = sums[w.ends] - sums[np.maximum(w.ends - 2, w.starts)]
        same = np.concatenate(([False], (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1]))) if len(doc) else np.zeros(0, bool)
        self.stats = {
            "upper": part(_UPPER[data]) / np.maximum(letters, 1), "symbols": part(_SYMBOL[data]) / length, "marked": of_words(tail >= 2),
            "bare": of_words(solid[w.ends] == solid[w.starts]), "repeats": of_words(same), "other": 1 - letters / length - part(data == 32) / length,
        }
        self.empty = w.counts == 0
        self.home, (self.runs, *self.heads) = letter_runs(data, offsets, hashed)  # an insult counts without the marks around it
        self.w, self.doc, self.n, self.hashed = w, doc, n, hashed

    def votes(self, lists: Lists) -> np.ndarray:
        """A bit for each labeller that speaks against a text, the junk rules' first."""
        speaks = [self.empty | (self.stats[s] > bad) for _, s, bad in JUNK_RULES]
        runs = np.bincount(self.home, minlength=self.n)
        found = [_among(self.runs, x) for x in (*_LISTS, lists.words)]
        for x in (lists.heads, lists.doubtful):
            begun = np.zeros(len(self.runs), bool)
            for h in self.heads if len(x) else ():
                begun |= _among(h, x)
            found.append(begun)
        hits = [np.bincount(self.home[x], minlength=self.n) for x in found]
        speaks += [hits[at] >= np.maximum(least, share * runs) for _, at, least, share in TOXIC_RULES]
        return sum(x.astype(np.int32) << i for i, x in enumerate(speaks))

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashed features of each text: runs of letters, their beginnings, the last two bytes of words, statistics by twentieths."""
        w, size = self.w, np.uint64(64 - DIM_BITS)
        tails = between(self.hashed, np.maximum(w.ends - 2, w.starts), w.ends) ^ np.uint64(2)
        levels = np.stack([np.minimum(x * 20, 20).astype(np.uint64) for x in self.stats.values()], 1)
        dense = mix((np.arange(levels.shape[1], dtype=np.uint64)[None] + np.uint64(1)) * np.uint64(1000) + levels)
        parts = [(self.home, self.runs), (self.doc, tails), (np.repeat(np.arange(self.n), dense.shape[1]), dense.ravel())]
        parts += [(self.home[h != 0], h[h != 0] ^ np.uint64(77 + i)) for i, h in enumerate(self.heads)]
        doc, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        both = np.sort((doc.astype(np.uint64) << np.uint64(DIM_BITS)) | (mix(hashes) >> size))
        both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
        at = np.searchsorted(both >> np.uint64(DIM_BITS), np.arange(self.n + 1))
        return (both & np.uint64((1 << DIM_BITS) - 1)).astype(np.int64), at


def votes_of(masks: np.ndarray) -> np.ndarray:
    """Rows of -1 (speaks against) and 0 (silent) from the bits of each mask."""
    return -((np.asarray(masks, np.int64)[:, None] >> np.arange(LABELLERS)) & 1).astype(np.int8)


def _each(batches: Iterator[pa.RecordBatch], at: int | str = "text") -> Iterator[tuple[pa.RecordBatch, _Chunk]]:
    """Slices of the batches and what their texts, in column ``at``, hold."""
    for batch in batches:
        data, offsets = texts(batch.column(at))
        for lo, hi in chunks(offsets, SCORED_BYTES):
            yield batch.slice(lo, hi - lo), _Chunk(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


class LabelModel:
    """Class 0 is good; class 1 + j is the kind of bad that labeller j notices first.

    Each labeller has a distribution of its three votes in each class, silence (0) included.
    Several kinds of bad let labellers that never speak of the same document be right all the same.
    """

    def __init__(self, labellers: int):
        self.prior, self.table = np.full(labellers + 1, 1 / (labellers + 1)), np.full((labellers + 1, labellers, 3), 1 / 3)

    def classes(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.prior)[None] + sum(np.log(self.table[:, j, votes[:, j].astype(int) + 1]).T for j in range(votes.shape[1]))
        logs = np.exp(logs - logs.max(1, keepdims=True))
        return logs / logs.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        return self.classes(votes)[:, 0]

    def fit(self, votes: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, rounds: int = 500, tolerance: float = 1e-5) -> LabelModel:
        """votes: distinct patterns; counts: documents of each; known: 1 good, -1 bad, 0 not known, for each pattern.

        Starts from the votes: documents that no labeller speaks against are good, others
        are of the kinds of those that do.
        """
        if not len(votes):
            return self
        known = np.zeros(len(votes), int) if known is None else known
        against = votes < 0
        spoken = against.any(1)

        def anchored(share: np.ndarray) -> np.ndarray:
            share = share.copy()
            share[known > 0] = np.eye(share.shape[1])[0]
            share[known < 0, 0] = 0
            return share / np.maximum(share.sum(1, keepdims=True), 1e-300)

        kinds = np.where(spoken[:, None], 0.99 * against / np.maximum(against.sum(1, keepdims=True), 1), 0.01 / votes.shape[1])
        share = anchored(np.concatenate((np.where(spoken, 0.01, 0.99)[:, None], kinds), 1))
        for _ in range(rounds):
            weight = share * counts[:, None]
            self.prior = (weight.sum(0) + 0.1) / (weight.sum() + 0.1 * weight.shape[1])
            for c in range(weight.shape[1]):
                for j in range(votes.shape[1]):
                    found = np.bincount(votes[:, j].astype(int) + 1, weight[:, c], 3) + ((0.1, 4.9, 0.1) if c == 0 else (0.5, 0.5, 0.1))
                    self.table[c, j] = found / found.sum()
            new = anchored(self.classes(votes))
            moved, share = np.abs(new - share).max(), new
            if moved < tolerance:
                break
        return self

    def accuracies(self) -> np.ndarray:
        """Per labeller, the share of its opinions that are right."""
        bad = self.prior[1:] / self.prior[1:].sum()
        bad_table = (bad[:, None, None] * self.table[1:]).sum(0)
        right = (1 - self.prior[0]) * bad_table[:, 0] + self.prior[0] * self.table[0, :, 2]
        wrong = (1 - self.prior[0]) * bad_table[:, 2] + self.prior[0] * self.table[0, :, 0]
        return right / (right + wrong)


def train_scorer(features: list[np.ndarray], bad: np.ndarray, epochs: int = 4, rate: float = 0.3, decay: float = 1e-4, least: float = 3.0, slight: float = 1.0) -> np.ndarray:
    """Weights of a logistic scorer of badness over binary features, the bias last.

    A feature's value is the log of how much more often bad documents have it than good ones,
    less ``slight``, over the root of the document's number of features; one that fewer than
    ``least`` documents have counts nothing. AdaGrad in a fixed order.
    """
    dim = 1 << DIM_BITS
    has = np.zeros((2, dim))
    for f, b in zip(features, bad, strict=True):
        has[0, f] += 1 - b
        has[1, f] += b
    odds = np.log((has[1] + 0.5) / (bad.sum() + 1)) - np.log((has[0] + 0.5) / ((1 - bad).sum() + 1))
    odds[has.sum(0) < least] = 0
    odds = np.sign(odds) * np.maximum(np.abs(odds) - slight, 0)
    weights, seen = np.append(np.where(odds != 0, 0.3, 0.0), 0.0), np.full(dim + 1, 1e-2)
    rows = [f[odds[f] != 0] for f in features]
    values = [np.append(odds[r] * _SCALE / np.sqrt(max(1, len(f))), 1.0) for f, r in zip(features, rows, strict=True)]
    rows, order = [np.append(r, dim) for r in rows], np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i], values[i]
            step = (1 / (1 + np.exp(-np.clip(weights[at] @ x, -30, 30))) - bad[i]) * x + decay * weights[at]
            seen[at] += step * step
            weights[at] -= rate * step / np.sqrt(seen[at])
    weights[:dim] *= odds
    return weights





class QualityModel:
    """Label models and scorers for junk and toxic."""

    parts = (slice(0, len(JUNK_RULES)), slice(len(JUNK_RULES), LABELLERS))

    def __init__(self, lists: Lists, models: list[LabelModel], weights: list[np.ndarray]):
        self.lists, self.models, self.weights = lists, models, weights

    def scores(self, chunk: _Chunk) -> list[np.ndarray]:
        """Probabilities of good text and of clean text, by the scorers."""
        flat, at = chunk.features()
        scale, out = _SCALE / np.sqrt(np.maximum(np.diff(at), 1)), []
        for w in self.weights:
            sums = np.concatenate(([0.0], np.cumsum(w[flat])))
            out.append(1 / (1 + np.exp(np.clip(np.diff(sums[at]) * scale + w[-1], -30, 30))))
        return out

    def labels(self, chunk: _Chunk) -> list[np.ndarray]:
        """The label models' posteriors of good and of clean."""
        votes = votes_of(chunk.votes(self.lists))
        return [m.posterior(votes[:, p]) for m, p in zip(self.models, self.parts, strict=True)]


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))


def _known(labels: DataFrame, key: str, teaching: bool) -> DataFrame:
    """One row (key, quality, toxic) for each labelled key of one half: 1 good, -1 bad, 0 not known or contradictory."""
    rows = labels.select(F.col(key).cast("long").alias("key"), *[F.col(c).cast("int").alias(c) if c in labels.columns else F.lit(None).cast("int").alias(c) for c in ("quality", "toxic")])
    rows = rows.where("key is not null").where((F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(2)) == 0) == teaching)

    def side(c: str, good: int):
        low, high = F.min(c), F.max(c)
        return F.when(low != high, 0).otherwise(F.when(low.isNull(), 0).when((low > 0).cast("int") == good, 1).otherwise(-1)).alias(c)

    return rows.groupBy("key").agg(side("quality", 1), side("toxic", 0))


def learn_lists(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", labelled: int = LABELLED, scratch: Scratch | None = None) -> Lists:
    """Toxic words and beginnings from at most ``labelled`` documents of the teaching half; equal texts count once.

    A listed word or beginning stands in 3 toxic documents at least, in a share of them
    five times its share of the clean ones, and 3 of 4 documents that have it are toxic; a
    doubtful beginning in 4, three times, and 3 of 10.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    bounded = _known(labels, key, True).where("toxic <> 0").orderBy(F.xxhash64("key"), "key").limit(labelled)
    rows = _rows(docs, key, text).join(F.broadcast(bounded), "key").dropDuplicates(["text", "toxic"])  # labelled rows of 16 bytes

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            toxic = np.asarray(batch.column("toxic")) < 0
            for lo, hi in chunks(offsets, 2 * SCORED_BYTES):
                part = data[offsets[lo] : offsets[hi]]
                home, (runs, *heads) = letter_runs(part, offsets[lo : hi + 1] - offsets[lo], prefix(_TABLES[True][part]))
                mine = toxic[lo:hi]
                parts = [(2, np.zeros(1, np.uint64), np.array([mine.sum()]), np.array([(~mine).sum()]))]
                for kind, hashes in ((0, runs), *[(1, h) for h in heads]):
                    pairs = _distinct(hashes, home)
                    found, at = np.unique(pairs[0], return_inverse=True)
                    bad = mine[pairs[1]]
                    parts.append((kind, found, np.bincount(at, bad, len(found)), np.bincount(at, ~bad, len(found))))
                for kind, h, t, c in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), kind, np.int32)), pa.array(t.astype(np.int64)), pa.array(c.astype(np.int64))], ["h", "kind", "t", "c"])

    total = rows.select("text", "toxic").mapInArrow(count, "h long, kind int, t long, c long").groupBy("kind", "h").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    total = scratch.keep(total, "counts")
    whole = total.where("kind = 2").first()
    if whole is None or not whole.t:
        return NOTHING_TAUGHT
    usual = (F.col("c") + 1) * (whole.t / max(whole.c, 1))

    def often(least: int, times: float, part: float):
        return (F.col("t") >= least) & (F.col("t") >= times * usual) & (F.col("t") >= part * (F.col("t") + F.col("c")))

    listed, doubtful = often(3, 5.0, 0.75), (F.col("kind") == 1) & often(4, 3.0, 0.3)
    found = total.where("kind < 2").where(listed | doubtful).select("h", "kind", listed.alias("listed"), doubtful.alias("doubtful")).collect()  # bounded by the words of ``labelled`` texts
    scratch.drop("counts")
    sides = ([r.h for r in found if r.kind == 0 and r.listed], [r.h for r in found if r.kind == 1 and r.listed], [r.h for r in found if r.doubtful])
    return Lists(*(np.sort(np.array(x, np.int64).view(np.uint64)) for x in sides))


def _distinct(hashes: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, text) pairs, without hash 0."""
    order = np.lexsort((home, hashes))
    h, d = hashes[order], home[order]
    keep = (h != 0) & np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))[: len(h)]
    return h[keep], d[keep]


def fit(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, scratch: Scratch | None = None) -> QualityModel:
    """Votes are counted over all documents; the scorers learn from at most ``sample`` of them, the least row hashes.

    labels (key, quality 1 or 0, toxic 1 or 0; nulls are not known), where given: see the
    module and learn_lists. Rows of equal key and text teach once; an empty table gives a
    model without evidence.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    lists = learn_lists(docs, labels, key, text, scratch=scratch) if labels is not None else NOTHING_TAUGHT
    rows = _rows(docs, key, text).withColumn("h", F.xxhash64("key", "text"))

    @tidy
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in _each(batches):
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("h"), pa.array(chunk.votes(lists), pa.int32())], ["key", "h", "votes"])

    voted = scratch.keep(rows.mapInArrow(vote, "key long, h long, votes int"), "votes")
    known = [F.lit(0).alias(c) for c in ("quality", "toxic")]
    judged = voted
    if labels is not None:
        judged, known = voted.join(_known(labels, key, False), "key", "left"), [F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")]
    counted = judged.groupBy("votes", *known).agg(F.count(F.lit(1)).alias("n")).orderBy("votes", "quality", "toxic").collect()  # 9 * 2**LABELLERS rows at most
    votes, counts, models = votes_of([r.votes for r in counted]), np.array([r.n for r in counted], float), []
    for p, side in zip(QualityModel.parts, ("quality", "toxic"), strict=True):
        both = np.concatenate((votes[:, p], np.array([r[side] for r in counted], np.int8)[:, None]), 1)
        patterns, at = np.unique(both, axis=0, return_inverse=True) if len(both) else (both, np.zeros(0, int))
        models.append(LabelModel(patterns.shape[1] - 1).fit(patterns[:, :-1], np.bincount(at.ravel(), counts, len(patterns)), patterns[:, -1]))

    distinct = voted.groupBy("h").agg(F.first("votes").alias("votes"))
    some = [r.h for spoken in ("votes = 0", "votes <> 0") for r in distinct.where(spoken).select("h").orderBy("h").limit(sample // 2).collect()]
    scratch.drop("votes")
    chosen = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in some], "h long")), "h").select("key", "text", "h")

    @tidy
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in _each(batches):
            flat, at = chunk.features()
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(chunk.votes(lists), pa.int32()), pa.array([flat[a:b].astype(np.uint16).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["h", "votes", "features"])

    got = {r.h: r for r in chosen.dropDuplicates(["h"]).mapInArrow(featured, "h long, votes int, features binary").toLocalIterator()}
    got = [got[h] for h in sorted(got)]
    features = [np.frombuffer(r.features, np.uint16) for r in got]
    own = votes_of([r.votes for r in got])
    weights = [train_scorer(features, 1 - m.posterior(own[:, p])) for m, p in zip(models, QualityModel.parts, strict=True)]
    del got, features
    release()  # the driver lives on for the stages after it
    return QualityModel(lists, models, weights)


SCORES = "key long, quality double, clean double, quality_label double, clean_label double, keep boolean"


def classify(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", model: QualityModel | None = None, threshold: float = 0.5) -> DataFrame:
    """Rows (key, quality, clean, quality_label, clean_label, keep).

    quality and clean are the scorers' probabilities of good text and of text without
    insults; the labels are the label models' posteriors. keep: both scores reach the
    threshold, and the text has a word. Null, empty and blank texts are never kept. Null
    and repeated keys are kept; other columns are ignored; an empty table gives no rows.
    """
    model = model or fit(docs, labels, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * 2**DIM_BITS weights

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in _each(batches):
            (quality, clean), (a, b) = shared.value.scores(chunk), shared.value.labels(chunk)
            keep = (quality >= threshold) & (clean >= threshold) & ~chunk.empty
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(x, pa.float64()) for x in (quality, clean, a, b)], pa.array(keep)], ["key", "quality", "clean", "quality_label", "clean_label", "keep"])

    return _rows(docs, key, text).mapInArrow(run, SCORES).withColumnRenamed("key", key)


def good_documents(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", model: QualityModel | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that classify() keeps, all columns, without a join: rows stream through the scorer."""
    model = model or fit(docs, labels, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, chunk in _each(batches, at):
            quality, clean = shared.value.scores(chunk)
            yield rows.filter(pa.array((quality >= threshold) & (clean >= threshold) & ~chunk.empty))

    return docs.mapInArrow(run, docs.schema)
