"""Repetition rules: characters inside duplicated n-grams and lines, by rolling hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import bounded_batches

#: n-gram length -> most per cent of the word characters that may lie inside n-grams found twice or more,
#: the first included: one repeated line in a short clean document stays below.
GRAM_LIMITS = {5: 32, 6: 31, 7: 30, 8: 30, 9: 29, 10: 28}
#: Most per cent of the word characters that may lie in lines equal to an earlier line.
LINE_LIMIT = 30
BASE_WINDOW = 8
MIN_WORDS = 20
REPEAT_LIMIT = 30

#: Bytes of text hashed at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

# Odd multipliers of the hashes, modulo 2 ** 64.
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i for i up to n, modulo 2 ** 64."""
    up = np.full(n + 1, base, np.uint64)
    down = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble, so that every bit of a hash depends on all."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(32)


def span_hash(prefix: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end) from prefix sums of value * base ** position."""
    return mixed((prefix[end] - prefix[start]) * down[start])


def place_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [start, end) of ascending spans that do not overlap.

    A sum of one scrambled value per (byte, place in the span).  A polynomial
    modulo 2 ** 64 would not do: whatever its odd base, a Thue-Morse string of two
    letters and its complement, 1 024 letters long, come out alike.
    """
    size = end - start
    prefix = np.zeros(int(size.sum()) + 1, np.uint64)
    before = np.cumsum(size) - size
    place = np.arange(len(prefix) - 1) - np.repeat(before, size)
    value = data[place + np.repeat(start, size)].astype(np.uint64)
    np.cumsum(mixed((place.astype(np.uint64) << np.uint64(8) | value) + np.uint64(_BYTE_BASE)), out=prefix[1:])
    return mixed(prefix[before + size] - prefix[before] + size.astype(np.uint64) * np.uint64(_WORD_BASE))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Positions inside any [start, start + width)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:-1]) > 0


def measure(data: np.ndarray, offset: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each text data[offset[i]:offset[i + 1]] of UTF-8 bytes."""
    n, size = len(offset) - 1, len(data)
    doc_of_byte = np.repeat(np.arange(n), np.diff(offset))
    space = _SPACE[data]
    first = np.zeros(size + 1, bool)
    first[offset] = True
    begins = ~space & (np.concatenate([[True], space[:-1]])[:size] | first[:size])
    ends = ~space & (np.concatenate([space[1:], [True]])[:size] | first[1:size + 1])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    point = (data & 0xC0) != 0x80  # one per code point
    points = np.concatenate([[0], np.cumsum(point)])
    chars = points[end] - points[start]
    doc = doc_of_byte[start]

    def total(which: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(which, weight, n).astype(np.int64)

    out = {"n_words": total(doc), "word_chars": total(doc, chars), "n_symbols": total(doc_of_byte[_SYMBOL[data]])}

    word = place_hash(data, start, end)
    word_up, word_down = powers(_WORD_BASE, len(word))
    word_prefix = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * word_up[:len(word)], out=word_prefix[1:])
    own = mixed((np.arange(n).astype(np.uint64) + np.uint64(1)) * np.uint64(_WORD_BASE))

    def duplicated(width: int, at: np.ndarray) -> np.ndarray:
        """Those starts in ``at`` whose ``width``-gram occurs twice or more in its text."""
        at = at[at + width <= len(word)]
        at = at[doc[at] == doc[at + width - 1]]
        key = span_hash(word_prefix, word_down, at, at + width) ^ own[doc[at]]
        return at[repeated(key)]

    every = np.arange(len(word))
    at = every
    for width in sorted({*GRAM_LIMITS, BASE_WINDOW}):
        at = duplicated(width, at)  # a longer gram is found twice only where its beginning is
        inside = covered(at, width, len(word))
        if width in GRAM_LIMITS:
            out[f"gram{width}_chars"] = total(doc[inside], chars[inside])
        if width == BASE_WINDOW:
            out["n_repeat_words"] = total(doc[inside])

    newline = data == 0x0A
    line_start = np.flatnonzero(first[:size] | np.concatenate([[False], newline[:-1]])[:size])
    line_end = np.concatenate([line_start[1:], [size]]) if len(line_start) else line_start
    line_end = line_end - newline[line_end - 1] if len(line_start) else line_end
    inside = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[inside], line_end[inside]
    line_doc = doc_of_byte[line_start]
    key = place_hash(data, line_start, line_end) ^ own[line_doc]
    kept = np.zeros(len(key), bool)
    kept[np.unique(key, return_index=True)[1]] = True
    out["n_dup_lines"] = total(line_doc[~kept])
    word_points = np.concatenate([[0], np.cumsum(point & ~space)])
    out["dup_line_chars"] = total(line_doc[~kept], (word_points[line_end] - word_points[line_start])[~kept])
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[f"gram{w}_chars" for w in GRAM_LIMITS], "dup_line_chars"]


def repetition(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, the characters inside repeated n-grams and lines, base_failed and kept.

    Whole texts are measured where they are read, without a shuffle.  NULL and
    empty texts have no words and fail the base rule.  Repeated rows are judged
    one by one; other columns play no part.
    """

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            text = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            _, offsets, values = text.buffers()
            offset = np.frombuffer(offsets, np.int64)[text.offset:text.offset + len(text) + 1]
            data = np.frombuffer(values, np.uint8) if values is not None and offset[-1] else np.zeros(0, np.uint8)
            at, parts = 0, []
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(offset, offset[at] + SLICE_BYTES, "right")) - 1)
                parts.append(measure(data[offset[at]:offset[to]], offset[at:to + 1] - offset[at]))
                at = to
            columns = [np.concatenate([p[c] for p in parts]) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", *COUNTS])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_LIMIT * F.col("n_words"))
    fine = 100 * F.col("dup_line_chars") <= LINE_LIMIT * F.col("word_chars")
    for width, limit in GRAM_LIMITS.items():
        fine = fine & (100 * F.col(f"gram{width}_chars") <= limit * F.col("word_chars"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)


def drop_repetitive(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that fail a rule; rows without doc_id stay, since nothing names them."""
    bad = repetition(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
