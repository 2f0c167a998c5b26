"""Token counts of sections: whole texts are encoded once, then tokens are attributed by offset."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "largest")
SECTIONS = "key long, section int, start long, stop long, n_tokens long"
_encoders: dict = {}


def encoder(path: str, pattern: str):
    """A tiktoken encoding from a rank file, one a process, and its tokens' byte lengths."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encoders[path] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[path]


def line_borders(text: str) -> np.ndarray:
    """Code point borders of the lines, each with its newline; an empty text is one empty line."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.unique(np.concatenate(([0], np.flatnonzero(codes == 10) + 1, [len(codes)]))) if len(codes) else np.array([0, 0])


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one code point that each token touches."""
    coder, lengths = encoder(path, pattern)
    sizes = lengths[coder.encode_to_numpy(text, disallowed_special=())]
    data = np.frombuffer(text.encode(), np.uint8)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points begun before each byte
    ends = np.cumsum(sizes)
    first = chars[np.minimum(ends - sizes + 1, len(data))] - 1
    return first, chars[ends]


def attribute(first: np.ndarray, last: np.ndarray, borders: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section borders[i]:borders[i + 1].

    first: a token belongs to the section that holds its first code point. largest:
    to the section that holds most of its code points, the earliest of equals.
    """
    n = len(borders) - 1
    home = np.clip(np.searchsorted(borders, first, "right") - 1, 0, n - 1)
    if rule == "largest":
        end = np.clip(np.searchsorted(borders, last - 1, "right") - 1, 0, n - 1)
        for t in np.flatnonzero(end > home):
            many = np.arange(home[t], end[t] + 1)
            home[t] = many[np.argmax(np.minimum(borders[many + 1], last[t]) - np.maximum(borders[many], first[t]))]
    return np.bincount(home, minlength=n)


def count_tokens(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", borders: Callable[[str], np.ndarray] = line_borders, rule: str = "first") -> DataFrame:
    """Rows (key, section, start, stop, n_tokens): sections tile each text, in code points.

    The counts of a text's sections add up to the tokens of the whole text. A null
    text counts as empty: one empty section without tokens. Null and repeated keys
    are kept as they are; other columns are ignored; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts = [], []
            for k, value in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                body = value.as_py() or ""
                cuts = borders(body)
                counts = attribute(*token_spans(body, path, pattern), cuts, rule) if body else np.zeros(len(cuts) - 1, np.int64)
                keys += [k] * len(counts)
                parts.append((np.arange(len(counts), dtype=np.int32), cuts[:-1], cuts[1:], counts))
            if parts:
                section, start, stop, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(section, pa.int32()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(n, pa.int64())], ["key", "section", "start", "stop", "n_tokens"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, SECTIONS).withColumnRenamed("key", key)
