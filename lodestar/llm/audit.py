"""What each filter of a chain removes, alone and behind the others, in every order.

A document's failures are one bit mask. All but the duplicate filter look at one text;
that one needs the whole table: rows are range-sorted by text fingerprint, full text
and key, so a copy stands behind its original and is found by comparing with its
predecessor. Where a range begins inside a fingerprint, the texts that earlier ranges
hold of it decide. Masks then collapse to counts for each part, and every figure of
every order is a sum of those counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.scratch import Scratch

_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = b"#$%&*|"

#: Failure conditions of a text's UTF-8 bytes and its words.
RULES: dict[str, Callable[[bytes, list[bytes]], bool]] = {
    "A": lambda text, words: len(words) < 50,
    "B": lambda text, words: 100 * len(set(words)) < 65 * len(words),
    "C": lambda text, words: 100 * (len(text) - len(text.translate(None, _UPPER))) > 5 * len(text.translate(None, _CONTINUATION)),
    "D": lambda text, words: len(text.translate(None, _SYMBOLS)) < len(text),
}
DUPLICATE = "E"
_OUT = "slot int, document boolean, print long, digest string, key long, part string, mask int"
_SCHEMA = pa.schema([("slot", pa.int32()), ("document", pa.bool_()), ("print", pa.int64()), ("digest", pa.string()), ("key", pa.int64()), ("part", pa.string()), ("mask", pa.int32())])


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", rules: dict[str, Callable[[bytes, list[bytes]], bool]] = RULES, scratch: Scratch | None = None) -> DataFrame:
    """Rows (key, part, mask): bit i for the i-th rule, the next bit for copies of a text with a smaller key.

    A null text is empty, a null part is the empty string. A null key is neither smaller
    nor larger than another: such rows are no copies and have none. Rows of equal key and
    text are not copies of each other. Other columns are ignored; an empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "audit")
    tests, copy = list(rules.values()), 1 << len(rules)
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.xxhash64(plain).alias("print"), plain.alias("text"), F.col(key).cast("long").alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    # the key is in the ranges' bounds, so that many copies of one text fill many ranges; a text is not, as bounds go through the driver
    ranged = rows.repartitionByRange("print", "key").sortWithinPartitions("print", "text", "key")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, opened = TaskContext.get().partitionId(), None
        before: bytes | None = None
        mark, least, mask, digest = None, None, 0, None
        held: set[str] = set()  # digests of the texts under the present fingerprint that have a key
        for batch in batches:
            out: list[tuple] = []
            for mine, value, own, of in zip(batch.column("print").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("key").to_pylist(), batch.column("part").to_pylist(), strict=True):
                data = value.as_py()
                if mine != mark:
                    mark, before, held = mine, None, set()
                    opened = mine if opened is None else opened
                if data != before:
                    before, least = data, None
                    words = data.split()
                    mask = sum(1 << i for i, test in enumerate(tests) if test(data, words))
                    digest = hashlib.sha256(data).hexdigest()
                if own is not None:
                    least = own if least is None else least
                    held.add(digest)
                later = own is not None and own > least
                out.append((slot, True, mine, digest if mine == opened and not later and own is not None else None, own, of, mask | copy * later))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA) if out else pa.RecordBatch.from_pylist([], _SCHEMA)
        if held:
            yield pa.RecordBatch.from_pylist([{"slot": slot, "document": False, "print": mark, "digest": d} for d in sorted(held)], _SCHEMA)

    found = scratch.keep(ranged.mapInArrow(judge, _OUT), "masks")
    # one row a range, as 64 bits of fingerprint hold one text but by rare chance: that bounds the broadcast by the number of ranges
    ends = found.where("not document").groupBy("print", "digest").agg(F.min("slot").alias("_first"))
    known = found.where("document").join(F.broadcast(ends), ["print", "digest"], "left")
    mask = F.when(F.col("_first") < F.col("slot"), F.col("mask").bitwiseOR(copy)).otherwise(F.col("mask"))
    return known.select(F.col("key").alias(key), "part", mask.alias("mask"))


def counters(masks: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents of each failure mask, and those that any label row calls good or toxic.

    Additive: counts of two tables are the counts of their union. Labels of null keys or of
    unknown documents count nothing.
    """
    known = labels.groupBy(F.col(key).cast("long").alias(key)).agg(F.max(F.col("quality") == 1).alias("_g"), F.max(F.col("toxic") == 1).alias("_t"))
    one = lambda c: F.count(F.when(F.col(c), 1))
    return masks.join(known, key, "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), one("_g").alias("good"), one("_t").alias("toxic"))


def interactions(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters.

    Every part has all orders and steps, zeros included. A document that fails m filters is
    removed by each of them in one m-th of all orders, which makes shapley a sum over masks.
    """
    spark, orders = counts.sparkSession, factorial(len(letters))
    steps = [("".join(o), i + 1, sum(1 << letters.index(x) for x in o[:i]), 1 << letters.index(o[i])) for o in permutations(letters) for i in range(len(o))]
    table = spark.createDataFrame(steps, "filter_order string, step int, gone int, bit int")
    pairs = sorted({(gone, bit) for _, _, gone, bit in steps})
    each = counts.select("*", F.explode(F.array(*[F.struct(F.lit(g).alias("gone"), F.lit(b).alias("bit")) for g, b in pairs])).alias("p")).select("part", "mask", "n", "good", "toxic", "p.*")
    fails, early = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("gone")) != 0
    total = lambda when, c="n": F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    share = F.floor(F.col("n") * orders / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")
    sums = each.groupBy("part", "gone", "bit").agg(
        total(~fails & ~early).alias("kept"), total(fails & ~early).alias("removed"), total(fails & early).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~early, "good").alias("good_lost"), total(fails & ~early, "toxic").alias("toxic_lost"), F.coalesce(F.sum(F.when(fails, share)), F.lit(0)).cast("long").alias("shapley"),
    )
    return sums.join(F.broadcast(table), ["gone", "bit"]).drop("gone", "bit").select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """The five filters A to E over whole texts; see failures, counters and interactions."""
    return interactions(counters(failures(docs, key, text, part, RULES, scratch), labels, key), "".join(RULES) + DUPLICATE)
