"""Token ids as fixed-width bit-packed blocks, written in key order and read back.

A file row is one block: ``range`` and ``block`` give its place, ``payload`` is a
self-describing byte string. Little-endian layout of a payload::

    magic "TKB2" | u32 bits | u64 documents | u64 ids | u64 documents of a null key, which come first
    i64 key of each document | u64 exclusive end of each document, in ids
    ids, ``bits`` bits each, least significant bit first, padded to a byte

Blocks start on byte borders and name their documents, so that any one document
is reached by its block's key range (Parquet statistics on ``first_key`` and
``last_key``) and unpacked by numpy alone.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.ranges import BUCKET_BYTES, buckets_of, total_bytes
from lodestar.llm.words import chunks, ragged, release, texts, tidy

MAGIC = b"TKB2"
BLOCK_IDS = 1 << 18
#: Pieces and words that an encoder keeps; they stay in its worker's memory from task to task.
KNOWN = 150_000
RUN = 1024
BLOCKS = "range int, block int, range_start long, n_docs long, n_ids long, first_key long, last_key long, payload binary"
#: The split of words into pieces that inside_words() knows, a fixed value of the tokenizer's file.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def bit_width(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flat.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop-1 without reading those before."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", stop - start, start * bits // 8).astype(np.uint32)
    lo = start * bits
    raw = np.frombuffer(data, np.uint8, (stop * bits + 7) // 8 - lo // 8, lo // 8)
    flat = np.unpackbits(raw, bitorder="little")[lo % 8 :][: (stop - start) * bits].reshape(-1, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def pack_block(keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, bits: int, nulls: int = 0) -> bytes:
    head = MAGIC + struct.pack("<IQQQ", bits, len(keys), len(ids), nulls)
    return head + keys.astype("<i8").tobytes() + np.cumsum(counts).astype("<u8").tobytes() + pack_bits(ids, bits)


def open_block(payload: bytes) -> tuple[np.ndarray, int, np.ndarray, Callable[[int, int], np.ndarray]]:
    """Keys, how many of the first are null, id offsets (one more than keys), and a reader of any id range."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token block")
    bits, docs, ids, nulls = struct.unpack_from("<IQQQ", payload, 4)
    keys = np.frombuffer(payload, "<i8", docs, 32)
    ends = np.frombuffer(payload, "<u8", docs, 32 + 8 * docs).astype(np.int64)
    body = memoryview(payload)[32 + 16 * docs :]
    if docs and int(ends[-1]) != ids:
        raise ValueError("a token block's offsets do not match its ids")
    return keys, nulls, np.concatenate(([0], ends)), lambda start, stop: unpack_bits(body, bits, start, stop)


#: Words of letters that no normal form changes and one code point lower-cases; without the sign that special tokens begin with.
PLAIN = r"[\x21-\x3B\x3D-\x7E\xA1\xBF-\xFF]*"


def inside_words(spec: dict) -> bool:
    """Whether a tokenizer's file shows that no token, and no rule that makes one, reaches across ASCII white space.

    Then the ids of a text are those of its white-space-delimited words, in order. It needs
    normal forms that change or join nothing across a blank, a split of which every
    alternative matches characters that are not white space and drops the rest, a byte-level
    step that adds no blank, added tokens without blanks, and neither cutting nor padding.
    As words of plain characters do not meet the whole tokenizer, every added token must
    hold a character that is not plain.
    """
    forms = (spec.get("normalizer") or {}).get("normalizers", [])
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    return (
        all(f == blanks or f in ({"type": "NFC"}, {"type": "Lowercase"}) for f in forms)
        and len(splits) == 2
        and splits[0] == {"type": "Split", "pattern": {"Regex": WORD_SPLIT}, "behavior": "Removed", "invert": True}
        and splits[1]["type"] == "ByteLevel"
        and not splits[1]["add_prefix_space"]
        and not splits[1]["use_regex"]
        and spec["model"]["type"] == "BPE"
        and not spec["model"].get("dropout")
        and not spec.get("truncation")
        and not spec.get("padding")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or len(t["content"].split()) != 1 or re.fullmatch(PLAIN, t["content"]) for t in spec.get("added_tokens", []))
    )


class TextEncoder:
    """Ids of whole texts by the tokenizers library.

    Where the tokenizer's file shows that its tokens lie inside words, and how words split
    into pieces before its merges (see inside_words), a text's ids are those of its words in
    order, and a word's those of its pieces. Words of plain Latin letters and signs are
    lower-cased and split by Arrow, and each distinct piece meets the file's merges; any other
    word goes through the whole tokenizer. The first ``memory`` pieces and words are kept for
    later texts, others until the next are asked for. With any other file each text goes through the tokenizer as it is. The library's
    own threads stay off, unless the environment asks for them: a task has one core.
    """

    #: WORD_SPLIT for Arrow's expressions.
    PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
    #: PLAIN for Arrow's expressions.
    PLAIN = r"^[\x21-\x3B\x3D-\x7E\x{A1}\x{BF}-\x{FF}]*$"
    #: Signs that WORD_SPLIT cuts, as one piece, from the letters before them.
    SIGNS = "".join(x for x in map(chr, range(0x21, 0x7F)) if not x.isalnum())
    _line = 200

    def __init__(self, path: str, memory: int = KNOWN):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            self.by_words = inside_words(json.load(f))
        self.tokenizer, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = Sequence([Split(" ", "removed"), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.memory = memory
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(1 << 20, np.uint16 if len(self.last) <= 1 << 16 else np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = self.slots = 0
        self._store(np.zeros(0, np.int64), np.zeros(1, np.int64))  # blanks at an end split off an empty piece
        self.known[""] = 0

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(len(ids), len(self.flat)), self.flat.dtype)))
        if self.slots + len(sizes) > len(self.starts):
            more = np.zeros(max(len(sizes), len(self.starts) // 4), np.int64)
            self.starts, self.sizes = np.concatenate((self.starts, more)), np.concatenate((self.sizes, more))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.slots : self.slots + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.slots : self.slots + len(sizes)] = sizes
        self.used, self.slots = self.used + len(ids), self.slots + len(sizes)

    def _learn(self, pieces: list[str]) -> None:
        for lo in range(0, len(pieces), 20 * self._line):
            part = pieces[lo : lo + 20 * self._line]
            lines = [part[i : i + self._line] for i in range(0, len(part), self._line)]
            got = self.merges.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.int64) for e in got])
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not end each piece with a word end")
            self._store(ids, np.diff(ends, prepend=0))

    def _places(self, names: list[str], learn) -> np.ndarray:
        """Where the distinct names stand in the store, until the next call; unknown ones are learned."""
        self.slots = len(self.known)  # what was not kept is written over
        self.used = int(self.starts[self.slots - 1] + self.sizes[self.slots - 1])
        found = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        at = np.flatnonzero(found < 0)
        if len(at):
            new = [names[i] for i in at.tolist()]
            found[at] = self.slots + np.arange(len(new))
            learn(new)
            some = new[: max(0, self.memory - len(self.known))]
            self.known.update(zip(some, found[at].tolist(), strict=False))
        return found

    def _whole(self, words: list[str]) -> None:
        got = [self.tokenizer.encode(w[1:], add_special_tokens=False).ids for w in words]
        self._store(np.array([i for x in got for i in x], np.int64), np.array([len(x) for x in got], np.int64))

    @staticmethod
    def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return flat[np.repeat(starts, sizes) + ragged(sizes)]

    def _spaced(self, words: pa.Array) -> pa.Array:
        """Plain words with a blank after each piece, but for the last; only words other than letters and then signs need the split itself."""
        low = pc.utf8_lower(words)
        heads = pc.ascii_rtrim(low, characters=self.SIGNS)
        simple = pc.utf8_is_alpha(heads)
        sizes, cut = (np.asarray(pc.binary_length(x), np.int64) for x in (low, heads))
        tails = np.asarray(simple) & (cut < sizes)
        data, offsets = texts(low)
        data = np.insert(data, (offsets[:-1] + cut)[tails], 0x20)
        offsets = offsets + np.concatenate(([0], np.cumsum(tails)))
        out = pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(offsets), pa.py_buffer(data)).cast(low.type)
        odd = pc.invert(simple)
        return pc.replace_with_mask(out, odd, pc.utf8_rtrim_whitespace(pc.replace_substring_regex(low.filter(odd), self.PIECES, r"\1 ")))

    def _words(self, words: pa.Array, wanted: bool) -> tuple[np.ndarray | None, np.ndarray]:
        """Ids, if wanted, and number of ids of distinct words."""
        plain = np.asarray(pc.match_substring_regex(words, self.PLAIN))
        counts, ids = np.zeros(len(words), np.int64), np.zeros(0, self.flat.dtype)
        if plain.any():
            split = pc.ascii_split_whitespace(self._spaced(words.filter(pa.array(plain))))
            offsets = np.asarray(split.offsets, np.int64)
            coded = split.flatten().dictionary_encode()
            at = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._learn)[np.asarray(coded.indices, np.int64)]
            sizes = self.sizes[at]
            ids = self._gather(self.flat, self.starts[at], sizes) if wanted else ids
            counts[plain] = np.diff(np.concatenate(([0], np.cumsum(sizes)))[offsets - offsets[0]])
        if not plain.all():
            # names of whole words begin with a blank, which no piece has
            at = self._places([f" {w}" for w in words.filter(pa.array(~plain)).to_pylist()], self._whole)
            counts[~plain] = self.sizes[at]
            if wanted:
                order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
                both = np.concatenate((ids, self._gather(self.flat, self.starts[at], self.sizes[at])))
                starts = np.zeros(len(words), np.int64)
                starts[order] = np.cumsum(counts[order]) - counts[order]
                ids = self._gather(both, starts, counts)
        return ids, counts

    def _split(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words of all texts, each word's place among them, and the words' bounds by text."""
        split = pc.ascii_split_whitespace(column)
        offsets = np.asarray(split.offsets, np.int64)
        # splitting leaves an empty word, of no ids, at a text's blank ends
        coded = split.flatten().dictionary_encode()
        return coded.dictionary, np.asarray(coded.indices, np.int64), offsets - offsets[0]

    def _texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
        return np.concatenate([*got, np.zeros(0, np.uint32)]), np.array([len(x) for x in got], np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each text has."""
        if not self.by_words:
            return self._texts(column)
        words, at, bounds = self._split(column)
        flat, sizes = self._words(words, True)
        counts = sizes[at]
        ids = self._gather(flat, (np.cumsum(sizes) - sizes)[at], counts)
        return ids, np.diff(np.concatenate(([0], np.cumsum(counts)))[bounds])

    def counts(self, column: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        if not self.by_words:
            return self._texts(column)[1]
        words, at, bounds = self._split(column)
        return np.diff(np.concatenate(([0], np.cumsum(self._words(words, False)[1][at])))[bounds])


_coders: dict[tuple[str, int], TextEncoder] = {}


def text_encoder(path: str, memory: int = KNOWN) -> TextEncoder:
    """One encoder a worker process, so that tasks share what it knows; it stays while the process lives."""
    if (path, memory) not in _coders:
        _coders[path, memory] = TextEncoder(path, memory)
    return _coders[path, memory]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1


def write_blocks(docs: DataFrame, scratch, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", name: str = "blocks", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Tokenise every whole text and write the ids as blocks in ascending key order.

    Null texts count as empty, and then have the end id alone. Rows with a null key
    come first and read back with a null key. Rows with equal keys are kept, ordered
    by their text. Other columns are ignored. An empty table writes no block.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    _, size = total_bytes(docs, text)
    ordered = rows.repartitionByRange(buckets_of(size, bucket_bytes), F.asc_nulls_first("key")).sortWithinPartitions(F.asc_nulls_first("key"), "text")

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_encoder(tokenizer_path)
        release()  # what reading its file took
        bits = bit_width(max(coder.tokenizer.get_vocab_size(), end_id + 1))
        place, number, begun, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush():
            nonlocal number, begun, held, size
            nulls, keys, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            n = int(nulls.sum())
            first, last = (None if nulls[i] else int(keys[i]) for i in (0, -1))
            row = [place, number, begun, len(keys), len(ids), first, last, pack_block(keys, counts, ids, bits, n)]
            number, begun, held, size = number + 1, begun + len(ids), [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["range", "block", "range_start", "n_docs", "n_ids", "first_key", "last_key", "payload"])

        for batch in batches:
            column = batch.column("text")
            _, offsets = texts(column)
            nulls, keys = np.asarray(batch.column("key").is_null()), np.asarray(batch.column("key").fill_null(0))
            for lo, hi in chunks(offsets, 4 << 20):
                ids, counts = with_end(*coder.encode(column.slice(lo, hi - lo)), end_id)
                held.append((nulls[lo:hi], keys[lo:hi], counts, ids))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    return scratch.keep(ordered.mapInArrow(pack, BLOCKS), name)


def read_documents(blocks: DataFrame) -> DataFrame:
    """Per document of written blocks: key, start (ids of all documents before), n_tokens, ids_crc32.

    Each block holds its start inside its range; the ranges' totals are summed in runs of
    RUN ranges, and the runs' totals before that. Documents meet the sums after they are
    unpacked, so that no payload is shuffled.
    """
    totals = blocks.groupBy("range").agg(F.sum("n_ids").alias("n")).withColumn("run", F.floor(F.col("range") / RUN))
    runs = totals.groupBy("run").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("run", before(Window.orderBy("run")).alias("earlier"))  # one row for RUN ranges
    offsets = totals.withColumn("inner", before(Window.partitionBy("run").orderBy("range"))).join(runs, "run").select("range", (F.col("earlier") + F.col("inner")).alias("before"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, at, payload in zip(batch.column("range").to_pylist(), batch.column("range_start").to_pylist(), batch.column("payload"), strict=True):
                keys, nulls, offsets, read = open_block(payload.as_py())
                ids = read(0, int(offsets[-1])).astype("<u4")
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=np.arange(len(keys)) < nulls), pa.array(np.full(len(keys), place), pa.int32()), pa.array(offsets[:-1] + at, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], ["key", "range", "at", "n_tokens", "ids_crc32"])

    read = blocks.select("range", "range_start", "payload").mapInArrow(unpack, "key long, range int, at long, n_tokens long, ids_crc32 long")
    return read.join(offsets, "range").select("key", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
