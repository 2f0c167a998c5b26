"""Grouped prefix join: links and classes of documents by Jaccard likeness of word n-grams.

1. Each text becomes a set of 64-bit shingle hashes in one global order: shingles
   that a corpus-wide counting sketch finds frequent come last, otherwise by hash.
   Two sets of a likeness of ``percent`` or more share a shingle in their prefixes,
   the first ``n - ceil(percent * n / 100) + 1`` of each. A prefix holds its shingles'
   places in the order, 63-bit numbers.
2. Documents of the same prefix and size collapse into one group. Groups meet on
   prefix shingles; size and position bounds, then the prefixes' differences, drop
   pairs that cannot reach the threshold.
3. Surviving group pairs, and groups of several different sets, expand to their
   member sets, which are verified exactly.

Where many groups share a shingle, the first round pairs each with a few others
only; its links join into components. Middle rounds pair what is still apart with
ever more pivots, and the last one pairs all that they left apart. So no link between
components is lost, and a large family of near copies costs about its size, not its
square. A document's number of links costs more: every link lies within a component,
so where rounds left pairs out, all pairs of a component are counted, block by block,
which reads its sets once for each block of it. After the first round, pairs are also held against parity maps of their whole
sets: bits that differ are no more than shingles that one set has and the other lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestar.llm.components import components
from lodestar.llm.scratch import Scratch
from lodestar.llm.words import Words, chunks, mix, texts, tidy, windows

SKETCH_BITS = 18
FULL_BLOCK = 8  # up to so many groups of one shingle, the first round pairs all
MARK_BITS = 24  # texts to verify are marked in so many bits, 2 MB in all, before they are read
PIVOTS = 3  # beyond it, each meets the next one by size and so many of least hash, the same ones for all shingles of a family
BLOCK = 1 << 18  # shingles of a block of sets of one component when links are counted; each set counts BLOCK_SET more
BLOCK_SET = 512
MIDDLE = (16,)  # pivots of the rounds between the first and the last, which pair different components only

PARITY = ["b0", "b1", "b2", "b3"]  # 256 bits of a set: whether the number of its shingles of each hash remainder is odd


def parities(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A row of four words by set, sets being ``hashes[cut[i]:cut[i + 1]]``."""
    wide, out = 64 * len(PARITY), [np.zeros((0, len(PARITY)), np.int64)]
    for lo in range(0, len(cut) - 1, 128):
        ends = cut[lo : lo + 129]
        mine, sets = hashes[ends[0] : ends[-1]], len(ends) - 1
        at = np.repeat(np.arange(sets), np.diff(ends)) * wide + (mix(mine) % np.uint64(wide)).astype(np.int64)
        odd = (np.bincount(at, minlength=sets * wide) & 1).astype(np.uint8)
        out.append(np.packbits(odd).view(np.int64).reshape(sets, len(PARITY)))
    return np.concatenate(out)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per chunk of texts: the distinct shingle hashes of each text, sorted, concatenated; and their number by text.

    A text of fewer than k words has one shingle, its whole sequence; one without words none.
    """
    data, offsets = texts(column)
    for lo, hi in chunks(offsets):
        w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
        hashes, at = w.shingles(k)
        cut = np.searchsorted(at, w.first)
        brief = np.flatnonzero((w.counts > 0) & (w.counts < k))
        whole = dict(zip(brief.tolist(), windows(w.hashes, w.first[brief], w.first[brief + 1]), strict=True))
        sets = [np.array([whole[i]], np.uint64) if i in whole else np.unique(hashes[cut[i] : cut[i + 1]]) for i in range(hi - lo)]
        yield np.concatenate([*sets, hashes[:0]]), np.array([len(s) for s in sets], np.int64)


def _ceil(a: np.ndarray, b: int) -> np.ndarray:
    return -(-a // b)


def count_sketch(docs: DataFrame, text: str, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many texts have a shingle of each hash bucket; 2**bits counters whatever the corpus."""
    blocks = 64
    wide = (1 << bits) // blocks

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for hashes, _ in shingle_sets(batch.column(0), k):
                total += np.bincount(hashes >> np.uint64(64 - bits), minlength=1 << bits)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([x.astype(np.uint64).tobytes() for x in total.reshape(blocks, wide)], pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(wide, np.uint64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_py(), np.uint64)
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, counts binary"
    found = docs.select(text).mapInArrow(count, kind).groupBy("block").applyInArrow(add, kind).collect()  # 64 rows, 2 MB in all
    out = np.zeros((blocks, wide), np.int64)
    for r in found:
        out[r.block] = np.frombuffer(r.counts, np.uint64)
    return out.ravel()


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """0 for a bucket of usual load, then one class for each doubling; fits a byte, at most 15."""
    usual = 1.5 * counts.mean() + 16
    return np.clip(np.floor(np.log2(np.maximum(counts, 1) / usual)) + 1, 0, 15).astype(np.uint8)


def signatures(docs: DataFrame, text: str, k: int, percent: int, classes: np.ndarray) -> DataFrame:
    """Rows (id, n, s1, s2, gkey, prefix, b0 to b3): set size, two hashes of the set, group key, prefix in global order and parities."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # 2**SKETCH_BITS bytes

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, bits = shared.value, int(len(shared.value)).bit_length() - 1
        for batch in batches:
            ids, row = batch.column(0), 0
            for hashes, sizes in shingle_sets(batch.column(1), k):
                order = (frequency[hashes >> np.uint64(64 - bits)].astype(np.uint64) << np.uint64(59)) | (hashes >> np.uint64(5))
                cut = np.concatenate(([0], np.cumsum(sizes)))
                with np.errstate(over="ignore"):
                    sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(c)), dtype=np.uint64))) for c in (0, 0x5BD1E995)]
                    s1, s2 = (np.diff(s[cut]) for s in sums)
                heads = []
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    n = b - a
                    p = n - (percent * n + 99) // 100 + 1 if n else 0
                    heads.append(np.sort(np.partition(order[a:b], p - 1)[:p]) if p else order[:0])
                lengths = np.array([len(h) for h in heads], np.int64)
                flat = np.concatenate([*heads, hashes[:0]])
                ends = np.concatenate(([0], np.cumsum(lengths)))
                units = np.concatenate((flat, sizes.astype(np.uint64)))  # group key: prefix, then mixed with size
                gkey = mix(windows(units, ends[:-1], ends[1:]) ^ mix(sizes.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(sizes)), pa.array(sizes, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(gkey.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64))), *(pa.array(b) for b in parities(hashes, cut).T.copy())],
                    ["id", "n", "s1", "s2", "gkey", "prefix", *PARITY],
                )
                row += len(sizes)

    return docs.select("id", text).mapInArrow(sign, "id long, n long, s1 long, s2 long, gkey long, prefix array<long>, b0 long, b1 long, b2 long, b3 long")


def candidates(postings: DataFrame, percent: int, pivots: int | None, first: bool) -> DataFrame:
    """Rows (a, partners) from postings (token, pos, n, id, comp, lone, last), within each token.

    first: all pairs of blocks up to FULL_BLOCK, and in the others the next member and
    the pivots for each member. Else, in blocks over FULL_BLOCK, the pairs whose
    components differ: those with a pivot, or where pivots is None all; these postings
    have parities b0 to b3 too, and whether they are those of one set alone (solo).
    """
    names = ["token", "id", "n", "pos", "comp", "lone", "last", *([] if first else ["solo", *PARITY])]

    def block(ids, sizes, places, comps, lone, last, solo=None, *parity) -> Iterator[tuple[int, np.ndarray]]:
        m = len(ids)
        large = m > FULL_BLOCK
        if not first and (not large or (comps == comps[0]).all()):
            return
        some = large and pivots is not None and m > pivots
        if some:
            chosen = np.sort(np.argpartition(mix(ids.astype(np.uint64)), pivots)[:pivots])
            pivotal = np.isin(np.arange(m), chosen)
        words = np.stack(parity, axis=1).view(np.uint64) if parity else None
        for i in range(m - 1):
            if not some or pivotal[i]:
                j = np.arange(i + 1, m)
            else:
                j = np.unique(np.concatenate(([i + 1], chosen[chosen > i])))
            j = j[sizes[j] * percent <= 100 * sizes[i]]  # sizes ascend from i on the other side: j is the larger set
            need = _ceil(percent * (sizes[i] + sizes[j]), 100 + percent)
            j = j[np.minimum(sizes[i] - places[i], sizes[j] - places[j]) >= need]  # this shingle and all after it
            if not first:
                j = j[comps[j] != comps[i]]
            left = np.where(last[j] < last[i], sizes[j] - lone[j], sizes[i] - lone[i])
            j = j[left >= _ceil(percent * (sizes[i] + sizes[j]), 100 + percent)]
            if words is not None and len(j):
                differ = np.bitwise_count(words[j] ^ words[i]).sum(axis=1, dtype=np.int64)
                total = sizes[i] + sizes[j]
                j = j[((solo[i] & solo[j]) == 0) | (total - differ >= 2 * _ceil(percent * total, 100 + percent))]
            if len(j):
                yield ids[i], ids[j]

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        def emit(cols):
            token = cols[0]
            cut = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
            left, right = [], []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b - a > 1:
                    for i, j in block(*(c[a:b] for c in cols[1:])):
                        left.append(i)
                        right.append(j)
            for lo in range(0, len(left), 5000):
                part = right[lo : lo + 5000]
                yield pa.RecordBatch.from_arrays([pa.array(left[lo : lo + 5000], pa.int64()), pa.array(part, pa.list_(pa.int64()))], ["a", "partners"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(x)) for x in names]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = np.searchsorted(cols[0], cols[0][-1])
            yield from emit([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None:
            yield from emit(held)

    sorted_ = postings.select(names).repartition("token").sortWithinPartitions("token", "n", "id")
    return sorted_.mapInArrow(meet, "a long, partners array<long>")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, scratch: Scratch | None = None, counted: bool = True, block: int = BLOCK) -> DataFrame:
    """Rows (key, n_shingles, component_id, n_links): set size, least key reachable by links, links from the class of equal sets.

    Words are maximal runs outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased. Texts link
    when ``100 * |A & B| >= percent * |A | B|``. Null, empty and blank texts have the
    empty set and link with nothing. Rows with a null key have no component and link
    with nothing; repeated keys are one document of several texts. Other columns are
    ignored; an empty table gives no rows. n_links counts all other classes of equal sets,
    by least key, that the class links with; without ``counted`` the column is left out.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketch = frequency_classes(count_sketch(rows, "text", k))
    signed = scratch.keep(signatures(rows, "text", k, percent, sketch), "signed")
    usable = signed.where("n > 0 and id is not null")
    groups = scratch.keep(usable.groupBy("gkey").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")), "groups")
    classes = scratch.keep(usable.groupBy("gkey", "n", "s1", "s2").agg(F.min("id").alias("rep"), *(F.first(b).alias(b) for b in PARITY)), "classes")
    many = classes.groupBy("gkey").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    inner = classes.join(many, "gkey").select(F.col("gkey").alias("token"), F.lit(0).alias("pos"), F.col("n"), F.col("rep").alias("id"))
    outer = groups.select(F.posexplode("prefix").alias("pos", "token"), F.col("n"), F.col("gkey").alias("id"))

    # a shingle of one group joins nothing: only shared ones are kept
    shared = outer.repartition("token").sortWithinPartitions("token").mapInArrow(_shared, "pos int, token long, n long, id long")
    raw = scratch.keep(shared, "raw")
    # shingles of a prefix that no other group has are lost to any pair, up to the lesser end of both prefixes
    ends = groups.select(F.col("gkey").alias("id"), F.size("prefix").alias("p"), F.element_at("prefix", -1).alias("last"))
    lone = raw.groupBy("id").agg(F.count(F.lit(1)).alias("shared")).join(ends, "id").select("id", (F.col("p") - F.col("shared")).alias("lone"), "last")
    outer = scratch.keep(raw.join(lone, "id"), "postings")
    inner = inner.select("*", F.lit(0).cast("long").alias("lone"), F.lit((1 << 63) - 1).alias("last"))
    scratch.drop("raw")
    signed = scratch.keep(signed.drop("prefix", *PARITY), "sizes")
    scratch.drop("signed")
    members = classes.select("gkey", "rep")

    def pairs(outer_c: DataFrame, inner_c: DataFrame, pivots: int | None, first: bool) -> DataFrame:
        met = candidates(outer_c, percent, pivots, first).select("a", F.explode("partners").alias("b")).distinct()
        left, right = (groups.select(F.col("gkey").alias(g), F.col("n").alias(f"n{g}"), F.col("prefix").alias(f"p{g}")) for g in "ab")
        # below the lesser end of both prefixes, a shingle of one that the other lacks is no common shingle
        upto = F.least(F.element_at("pa", -1), F.element_at("pb", -1))
        lacks = [F.size(F.array_except(F.filter(x, lambda t: t <= upto), y)) for x, y in (("pa", "pb"), ("pb", "pa"))]
        most = F.least(F.col("na") - lacks[0], F.col("nb") - lacks[1])
        met = met.join(left, "a").join(right, "b").where((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b")
        wide = met.join(members.select(F.col("gkey").alias("a"), F.col("rep").alias("ra")), "a").join(members.select(F.col("gkey").alias("b"), F.col("rep").alias("rb")), "b").select("ra", "rb")
        same = candidates(inner_c, percent, pivots, first).select(F.col("a").alias("ra"), F.explode("partners").alias("rb"))
        return wide.union(same).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct()

    def links(found: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Verified pairs and how many they are."""
        met = Observation()
        found = scratch.keep(found.observe(met, F.count(F.lit(1)).alias("n")), f"{name}-pairs")
        if not met.get["n"]:  # nothing to verify: no further job
            return found, 0
        wanted = found.select(F.col("a").alias("id")).union(found.select("b")).distinct()
        sets = scratch.keep(_marked(rows, wanted).mapInArrow(_sets(k), "id long, s1 long, s2 long, shingles array<long>"), f"{name}-sets")
        # repeated keys: the class's own set decides
        reps = classes.select(F.col("rep").alias("id"), "s1", "s2")
        both = found.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
        for g in "ab":
            both = both.join(reps.select(*(F.col(c).alias(f"{c}_{g}") for c in reps.columns)), f"id_{g}")
        for g, x in (("a", "x"), ("b", "y")):
            held = sets.select(*(F.col(c).alias(f"{c}_{g}") for c in reps.columns), F.col("shingles").alias(x))
            both = both.join(held, [f"id_{g}", f"s1_{g}", f"s2_{g}"])
        both = both.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "x", "y")
        common = F.size(F.array_intersect("x", "y"))
        sums = Observation()
        out = both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()
        out = scratch.keep(out.observe(sums, F.count(F.lit(1)).alias("n")), f"{name}-links")
        scratch.drop(f"{name}-sets", f"{name}-pairs")
        return out, sums.get["n"]

    zero = F.lit(0).cast("long").alias("comp")
    all_links, _ = links(pairs(outer.select("*", zero), inner.select("*", zero), PIVOTS, True), "first")
    # the rounds after it read large blocks alone
    outer, inner = (scratch.keep(x.join(x.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > FULL_BLOCK).select("token"), "token"), f"large-{i}") for i, x in enumerate((outer, inner)))
    scratch.drop("postings")
    # a group of several sets has no parities of its own
    known = [F.min(b).alias(b) for b in PARITY]
    by_id = [classes.groupBy(F.col("gkey").alias("id")).agg((F.count(F.lit(1)) == 1).cast("long").alias("solo"), *known), classes.groupBy(F.col("rep").alias("id")).agg((F.count(F.lit(1)) == 1).cast("long").alias("solo"), *known)]
    outer, inner = outer.join(by_id[0], "id"), inner.join(by_id[1], "id")
    part = scratch.keep(components(all_links, scratch, "stars"), "parts")
    for i, pivots in enumerate((*MIDDLE, None)):
        labels = classes.join(part.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        # a group whose sets lie in several components meets everything: it is labelled by its own key
        by_group = labels.groupBy(F.col("gkey").alias("id")).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).select("id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("id").bitwiseOR(F.lit(-(1 << 63)))).alias("comp"))
        by_class = labels.select(F.col("rep").alias("id"), F.col("component").alias("comp"))
        new, found = links(pairs(outer.join(by_group, "id"), inner.join(by_class, "id"), pivots, False), f"round-{i}")
        if found:  # else the components stand
            # a group of several components may meet its pairs again
            all_links = scratch.keep(all_links.union(new).distinct(), f"links-{i}") if counted else all_links
            part = joined(part, new, scratch, i)
    final = part
    labelled = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    if counted:
        # a pair that meets in a small block was verified; the rounds left out pairs of large ones alone
        met = outer.select("id").distinct().join(members.withColumnRenamed("gkey", "id"), "id").select("rep").union(inner.select(F.col("id").alias("rep"))).distinct()
        nodes = final.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
        edges = all_links.join(final, F.col("a") == F.col("node")).groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
        whole = F.col("nodes") * (F.col("nodes") - 1) == 2 * F.col("edges")
        touched = final.join(met, F.col("node") == F.col("rep")).select("component").distinct()
        open_ = nodes.join(edges, "component").where(~whole).join(touched, "component").select("component")
        open_ = scratch.keep(final.join(open_, "component").select(F.col("node").alias("rep"), "component"), "open")
        degree = all_links.select(F.col("a").alias("rep")).union(all_links.select("b")).join(open_, "rep", "left_anti").groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
        degree = degree.union(scratch.keep(all_degrees(rows, classes, open_, k, percent, block, scratch), "degrees"))
        labelled = labelled.join(degree, "rep", "left")
    scratch.drop("large-0", "large-1", "groups")
    links_ = ["n_links"] if counted else []
    labelled = labelled.select("gkey", "n", "s1", "s2", F.coalesce("component", "rep").alias("component"), *(F.coalesce(x, F.lit(0)).alias(x) for x in links_))
    done = signed.select("id", "n", "s1", "s2", "gkey").join(labelled, ["gkey", "n", "s1", "s2"], "left")
    none = F.col("id").isNull() | (F.col("n") == 0)
    return done.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(none, F.col("id")).otherwise(F.col("component")).alias("component_id"), *(F.when(none, F.lit(0)).otherwise(F.col(x)).alias(x) for x in links_))


def joined(part: DataFrame, links: DataFrame, scratch: Scratch, i: int) -> DataFrame:
    """Components (node, component) with further links (a, b): only links between different ones count, and only their components meet again."""
    own = {x: part.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"}
    ends = links.join(own["a"], "a", "left").join(own["b"], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    sums = Observation()
    bridges = scratch.keep(ends.where("a <> b").distinct().observe(sums, F.count(F.lit(1)).alias("n")), f"bridges-{i}")
    if not sums.get["n"]:
        return part
    least = scratch.keep(components(bridges, scratch, f"stars-{i}").toDF("old", "new"), f"bridged-{i}")
    moved = part.join(least, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    first = least.join(part, F.col("old") == F.col("node"), "left_anti")  # nodes that had no link before
    return scratch.keep(moved.union(first), f"parts-{i}")


def all_degrees(rows: DataFrame, classes: DataFrame, parts: DataFrame, k: int, percent: int, block: int, scratch: Scratch) -> DataFrame:
    """Rows (rep, n_links) of the nodes of parts (rep, component): with how many others of its component each links.

    A component's nodes are dealt to blocks by hash. Each two of its blocks meet, and all
    their pairs are verified; one task holds two blocks.
    """
    own = scratch.keep(classes.join(parts, "rep").select("component", "rep", "n", "s1", "s2"), "open-classes")
    blocks = own.groupBy("component").agg(F.ceil(F.sum(F.col("n") + BLOCK_SET) / block).alias("blocks"))
    # repeated keys: the class's own set decides, and the classes of one are one node in one block
    sets = _marked(rows, own.select(F.col("rep").alias("id"))).mapInArrow(_sets(k), "id long, s1 long, s2 long, shingles array<long>").withColumnRenamed("id", "rep")
    sets = own.join(blocks, "component").join(sets, ["rep", "s1", "s2"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    sets = scratch.keep(sets.dropDuplicates(["rep", "s1", "s2"]).select("component", "block", "blocks", "rep", "shingles"), "open-sets")

    def count(table: pa.Table) -> pa.Table:
        reps, blocks = (table.column(x).to_numpy() for x in ("rep", "block"))
        shingles = table.column("shingles").combine_chunks()
        flat, sizes = shingles.flatten().to_numpy(), shingles.value_lengths().to_numpy().astype(np.int64)
        order = np.argsort(sizes, kind="stable")
        ends = np.cumsum(sizes)
        flat = np.concatenate([flat[:0], *(flat[ends[i] - sizes[i] : ends[i]] for i in order)])
        reps, blocks, sizes = reps[order], blocks[order], sizes[order]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        terms, flat = np.unique(flat, return_inverse=True)
        across = table.column("block_a")[0].as_py() != table.column("block_b")[0].as_py()
        has, found = np.zeros(len(terms), bool), []
        for i in range(len(reps) - 1):
            top = int(np.searchsorted(sizes, 100 * sizes[i] // percent, "right"))  # sizes ascend: j is the larger set
            if top <= i + 1:
                continue
            mine = flat[starts[i] : starts[i + 1]]
            has[mine] = True
            common = np.add.reduceat(has[flat[starts[i + 1] : starts[top]]], starts[i + 1 : top] - starts[i + 1], dtype=np.int64)
            has[mine] = False
            j = np.arange(i + 1, top)
            j = j[(100 * common >= percent * (sizes[i] + sizes[i + 1 : top] - common)) & (reps[i + 1 : top] != reps[i])]
            j = j[blocks[j] != blocks[i]] if across else j
            found.append(np.stack((np.minimum(reps[i], reps[j]), np.maximum(reps[i], reps[j]))))
        pairs = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)
        rep, n = np.unique(pairs, return_counts=True)
        return pa.table({"rep": pa.array(rep, pa.int64()), "n": pa.array(n, pa.int64())})

    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("component", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), "block", "rep", "shingles")
    some = met.groupBy("component", "block_a", "block_b").applyInArrow(count, "rep long, n long")
    return some.groupBy("rep").agg(F.sum("n").cast("long").alias("n_links"))


@tidy
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, those whose token stands in more than one row."""
    before, held = None, None  # the token before the held last row, and that row
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        token = table.column("token").to_numpy()
        left = np.concatenate(([before is not None and before == token[0]], token[1:] == token[:-1]))
        twice = left[:-1] | left[1:]
        yield from table.filter(pa.array(twice.tolist() + [False])).to_batches()
        held, before = table.slice(len(token) - 1), token[-2] if len(token) > 1 else before
    if held is not None and before is not None and before == held.column("token")[0].as_py():
        yield from held.to_batches()


def _marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose id is wanted, and the few others of the same bit in a bitmap of MARK_BITS bits, which is broadcast."""
    page, bits = 15, 1 << MARK_BITS  # a bitmap of Spark has 2**15 bits
    mark = F.pmod(F.xxhash64("id"), F.lit(bits))
    pages = wanted.select(mark.alias("mark")).groupBy(F.shiftright("mark", page).alias("page")).agg(F.bitmap_construct_agg(F.col("mark").bitwiseAND((1 << page) - 1)).alias("bitmap"))
    place = F.col("mark").bitwiseAND((1 << page) - 1)
    byte = F.conv(F.hex(F.substring("bitmap", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("mark", mark).withColumn("page", F.shiftright("mark", page)).join(F.broadcast(pages), "page")
    return marked.where(F.getbit(byte, place.bitwiseAND(7).cast("int")) == 1).select(rows.columns)


def _sets(k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for hashes, sizes in shingle_sets(batch.column("text"), k):
                cut = np.concatenate(([0], np.cumsum(sizes)))
                with np.errstate(over="ignore"):
                    s1, s2 = (np.diff(np.concatenate(([np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(c)), dtype=np.uint64)))[cut]) for c in (0, 0x5BD1E995))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, len(sizes)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(hashes.view(np.int64)))], ["id", "s1", "s2", "shingles"])
                row += len(sizes)

    return run
