"""Removal of byte strings that occur twice, by merging Burrows-Wheeler transforms.

Texts are never compared as wholes.  Every 200-byte window is named by its
rarest-looking piece (the gram of least hash), so equal windows meet under one
key.  Under a key, contexts found twice are settled at once; the others are
suffix-sorted in shards and the shards' transforms are merged by iterative
interleave refinement, whose blocks are the repeated intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.repetition import mixed, powers
from riskloom.llm.text import bounded_batches
from riskloom.session import materialise

#: Bytes of a string that must not occur twice.
LENGTH = 200
#: Bytes of the grams that name windows; a window has LENGTH - GRAM + 1 of them.
GRAM = 80
#: Bytes of one symbol of the transforms: LENGTH / STRIDE refinement rounds settle a window.
STRIDE = 40

#: Windows of one run, at most; a longer run goes on as the next.  A run's count is packed in 15 bits, a further
#: bit says that its gram occurs again inside it, so that its windows may repeat each other.
RUN_WINDOWS = 4096
COUNT, AGAIN = 0x7FFF, 0x8000

#: Text bytes hashed at a time.
SLICE_BYTES = 1 << 20
#: Context bytes merged at a time, and in one shard of a merge.
MERGE_BYTES, SHARD_BYTES = 2 << 20, 1 << 18
#: Contexts of one key held by a task; a fuller key goes window by window instead.
KEY_BYTES = 16 << 20

_BASE, _SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def prefix_sums(data: np.ndarray, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte * base ** position and the inverse powers, modulo 2 ** 64."""
    up, down = powers(base, len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=prefix[1:])
    return prefix, down


def window_runs(data: np.ndarray, offset: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows with equal naming grams: (text, start, count, key, context hash).

    ``data`` are texts end to end.  The context of a run is all bytes of its windows; ``count`` may have the bit AGAIN.
    """
    size, grams = len(data), length - gram + 1
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if size < length:
        return empty
    prefix, down = prefix_sums(data)
    name = mixed((prefix[gram:] - prefix[:-gram]) * down[:size - gram + 1])
    # Least hash over a window by doubling; the position in the low bits breaks ties to the left.
    low = (name & ~np.uint64(0xFFFFFF)) | np.arange(len(name), dtype=np.uint64)
    span = 1
    while 2 * span <= grams:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < grams:
        low = np.minimum(low[:-(grams - span)], low[grams - span:])
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)  # of each window start in [0, size - length]
    text = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
    fits = text[:size - length + 1] == text[length - 1:]
    start = np.flatnonzero(fits)
    if not len(start):
        return empty
    # Equal grams have one name, so a periodic passage is one run and not one per period.
    named = name[at[start]]
    new = np.concatenate([[True], (start[1:] != start[:-1] + 1) | (named[1:] != named[:-1]) | (text[start[1:]] != text[start[:-1]])])
    first = np.flatnonzero(new)
    since = np.arange(len(start)) - np.repeat(first, np.diff(np.concatenate([first, [len(start)]])))
    first = np.flatnonzero(since % RUN_WINDOWS == 0)
    moved = np.concatenate([[0], np.cumsum(at[start[1:]] != at[start[:-1]])])  # the gram was met at another place
    count = np.diff(np.concatenate([first, [len(start)]]))
    again = moved[first + count - 1] != moved[first]
    start = start[first]
    context = mixed((prefix[start + count - 1 + length] - prefix[start]) * down[start]) ^ count.astype(np.uint64)
    return text[start], start - offset[text[start]], count | np.where(again, AGAIN, 0), name[at[start]], context


def repeated_starts(data: np.ndarray, size: np.ndarray, count: np.ndarray, length: int = LENGTH, stride: int = STRIDE, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Which windows occur twice or more among contexts laid end to end in ``data``.

    Context j has ``size[j]`` bytes and ``count[j]`` windows, one at each of its
    first bytes; the result has one flag per window, in order.

    A symbol is ``stride`` bytes at any position, and the suffix at p goes on at
    p + stride.  Each shard of contexts gets its own transform.  The merged
    order is then refined: it starts as shard after shard, and each round reads
    the transforms' symbols in merged order and deals their suffixes into
    buckets stably.  After h rounds suffixes stand by their first h symbols, and
    a block ends where a symbol or the block one symbol further on changes; no
    suffix is compared or sorted again.
    """
    nodes = size + 1  # real suffixes, then ``stride`` ends
    base = np.concatenate([[0], np.cumsum(nodes)])
    byte = np.concatenate([[0], np.cumsum(size)])
    n = int(base[-1])
    context = np.repeat(np.arange(len(size)), nodes)
    place = np.arange(n) - base[context]
    real = place < (nodes - stride)[context]
    prefix, down = prefix_sums(data)
    begin = (byte[:-1][context] + place)[real]
    hashed = mixed((prefix[begin + stride] - prefix[begin]) * down[begin])
    symbol = np.zeros(n, np.int64)
    symbol[real] = np.unique(hashed, return_inverse=True)[1] + 1
    before = np.where(place >= stride, symbol[np.maximum(np.arange(n) - stride, 0)], 0)

    limits = np.unique(np.concatenate([[0], np.searchsorted(base, np.arange(shard_bytes, n, shard_bytes)), [len(size)]]))
    rounds = length // stride
    order_parts, shard_parts = [], []
    for s, (lo, hi) in enumerate(zip(limits[:-1], limits[1:])):
        a, b = int(base[lo]), int(base[hi])
        rank, depth = symbol[a:b], 1
        follow = np.zeros(b - a, bool)
        follow[:] = real[a:b]
        while depth < rounds:
            ahead = np.zeros(b - a, np.int64)
            ahead[:b - a - depth * stride] = rank[depth * stride:]
            # A suffix that has ended within ``depth`` symbols has nothing ahead.
            ahead[place[a:b] + depth * stride >= nodes[context[a:b]]] = 0
            rank = np.unique(np.where(follow, rank * (int(rank.max()) + 1) + ahead, 0), return_inverse=True)[1]
            depth *= 2
        order_parts.append(a + np.argsort(rank, kind="stable"))
        shard_parts.append(np.full(b - a, s, np.uint16))
    suffix = np.concatenate(order_parts)
    transform = before[suffix]
    shard = np.concatenate(shard_parts)
    block = np.zeros(n, np.int64)
    index = np.arange(n)
    merged = np.empty(n, np.int64)
    bits = max(1, int(n).bit_length())
    for _ in range(rounds):
        merged[np.argsort(shard, kind="stable")] = transform
        key = merged << bits | index
        key.sort()
        source = key & ((1 << bits) - 1)
        key >>= bits
        old = block[source]
        change = (key[1:] != key[:-1]) | ((old[1:] != old[:-1]) & (key[1:] != 0))
        block = np.concatenate([[0], np.cumsum(change)])
        shard = shard[source]
    twice = np.bincount(block)[block] > 1
    flag = np.empty(n, bool)
    # The k-th suffix of a shard in merged order is the k-th of its own order.
    flag[suffix] = twice[np.argsort(shard, kind="stable")]
    return flag[place < count[context]]


# ------------------------------------------------------------------ table jobs

def _row_id() -> Column:
    """A document's doc_id; a text hash stands in for NULL."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text"))


def _mark() -> Column:
    """16 bits of the text's hash tell rows apart that share a doc_id by mistake."""
    return F.xxhash64("text").bitwiseAND(F.lit(0xFFFF).cast("bigint"))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).select("doc_id", _row_id().alias("rid"), _mark().alias("mark"), F.col("text").cast("binary").alias("text"))


def runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, context, rid, spot) of every run of windows; ``spot`` packs start, count and mark."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            rid, mark = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            text = batch.column(2).cast(pa.large_binary())
            _, offsets, values = text.buffers()
            offset = np.frombuffer(offsets, np.int64)[text.offset:text.offset + len(text) + 1]
            data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(offset, offset[at] + SLICE_BYTES, "right")) - 1)
                for which, start, count, key, context in pieces(data[offset[at]:offset[to]], offset[at:to + 1] - offset[at], length, gram):
                    row = at + which
                    spot = start << 32 | count << 16 | mark[row]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), pa.array(rid[row]), pa.array(spot)], ["key", "context", "rid", "spot"])
                at = to

    return _texts(docs).select("rid", "mark", "text").mapInArrow(run, "key bigint, context bigint, rid bigint, spot bigint")


def pieces(data: np.ndarray, offset: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``window_runs`` of texts; a single text beyond SLICE_BYTES goes in pieces that overlap by a window less a byte.

    A run cut by a piece's end becomes two runs, each with its own windows.
    """
    if len(offset) > 2 or len(data) <= 4 * SLICE_BYTES:
        yield window_runs(data, offset, length, gram)
        return
    for at in range(0, len(data) - length + 1, SLICE_BYTES):
        part = data[at:at + SLICE_BYTES + length - 1]
        which, start, count, key, context = window_runs(part, np.array([0, len(part)]), length, gram)
        yield which, start + at, count, key, context


def classify(found: DataFrame) -> DataFrame:
    """Runs whose key occurs again, in another run or their own: (key, rid, spot, full, fetch).

    ``full``: another run has the very same context, so all its windows repeat.
    ``fetch``: the run's bytes must be compared with others of its key: those
    without an equal context, and one of each set of equal ones.  Sorted
    neighbours tell it all, so a key of any size passes as a stream.
    """

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judge(key, context, rid, spot, before, after) -> pa.RecordBatch:
            """Rows between the neighbours ``before`` and ``after`` ((key, context) or None)."""
            new_key = np.concatenate([[before is None or before[0] != key[0]], key[1:] != key[:-1], [after is None or after[0] != key[-1]]])
            same = np.concatenate([[before is not None and before == (key[0], context[0])], (key[1:] == key[:-1]) & (context[1:] == context[:-1]), [after is not None and after == (key[-1], context[-1])]])
            keep = ~(new_key[:-1] & new_key[1:]) | (spot >> 16 & AGAIN != 0)
            full = same[:-1] | same[1:]
            fetch = ~same[:-1]
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, rid, spot, full, fetch)], ["key", "rid", "spot", "full", "fetch"])

        held, before = None, None
        for batch in it:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                yield judge(*held, before, (rows[0][0], rows[1][0]))
                before = (held[0][-1], held[1][-1])
            held = rows
        if held is not None:
            yield judge(*held, before, None)

    spark = found.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = found.repartition(n, "key").sortWithinPartitions("key", "context")
    return ordered.mapInArrow(run, "key bigint, rid bigint, spot bigint, full boolean, fetch boolean")


def contexts(docs: DataFrame, wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, rid, spot, bytes) for the runs of ``wanted`` (key, rid, spot)."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for rid, text, keys, spots in zip(*(c.to_pylist() for c in batch.columns)):
                parts = [text[s >> 32:(s >> 32) + (s >> 16 & COUNT) - 1 + length] for s in spots]
                for i in range(0, len(parts), 4096):
                    j = min(i + 4096, len(parts))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i:j], pa.int64()), pa.array([rid] * (j - i), pa.int64()), pa.array(spots[i:j], pa.int64()), pa.array(parts[i:j], pa.binary())], ["key", "rid", "spot", "bytes"])

    mark = F.col("spot").bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    by_text = wanted.withColumn("mark", mark).groupBy("rid", "mark").agg(F.collect_list("key").alias("keys"), F.collect_list("spot").alias("spots"))
    joined = _texts(docs).join(by_text, ["rid", "mark"]).select("rid", "text", "keys", "spots")
    return joined.mapInArrow(run, "key bigint, rid bigint, spot bigint, bytes binary")


INTERVAL = "rid bigint, mark bigint, from_byte bigint, to_byte bigint, h1 bigint, h2 bigint"


def merge_keys(fetched: DataFrame, length: int = LENGTH) -> DataFrame:
    """Intervals of repeated windows by merging transforms key by key; see INTERVAL.

    Whole keys are gathered up to MERGE_BYTES and merged together.  A key beyond
    KEY_BYTES is not held: its windows come out one by one with two hashes, to
    be counted by Spark.
    """

    def intervals(rid, spot, start, stop) -> pa.RecordBatch:
        zero = pa.array(np.zeros(len(rid), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(spot & 0xFFFF), pa.array(start), pa.array(stop), pa.nulls(len(rid), pa.int64()), zero], [c.split()[0] for c in INTERVAL.split(", ")])

    def merged(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        key, rid, spot = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        alone = np.concatenate([[True], key[1:] != key[:-1]]) & np.concatenate([key[1:] != key[:-1], [True]])
        keep = np.flatnonzero(~alone | (spot >> 16 & AGAIN != 0))
        if not len(keep):
            return intervals(*(np.zeros(0, np.int64),) * 4)
        key, rid, spot = key[keep], rid[keep], spot[keep]
        parts = [rows[i][3] for i in keep]
        size = np.array([len(p) for p in parts], np.int64)
        count = spot >> 16 & COUNT
        flag = repeated_starts(np.frombuffer(b"".join(parts), np.uint8), size, count, length)
        which = np.repeat(np.arange(len(rid)), count)
        first = np.cumsum(count) - count
        at = np.flatnonzero(flag)
        if not len(at):
            return intervals(*(np.zeros(0, np.int64),) * 4)
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (which[at[1:]] != which[at[:-1]])])
        begin, end = at[new], at[np.concatenate([new[1:], [True]])]
        row = which[begin]
        shift = (spot >> 32)[row] - first[row]
        return intervals(rid[row], spot[row], begin + shift, end + shift + length)

    def windows(rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        for _, rid, spot, part in rows:
            data, count = np.frombuffer(part, np.uint8), spot >> 16 & COUNT
            i = np.arange(count)
            hashes = []
            for base in (_BASE, _SECOND):
                prefix, down = prefix_sums(data, base)
                hashes.append(mixed((prefix[i + length] - prefix[i]) * down[i]).view(np.int64))
            start = i + (spot >> 32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(count, rid)), pa.array(np.full(count, spot & 0xFFFF)), pa.array(start), pa.array(start + length), *map(pa.array, hashes)], [c.split()[0] for c in INTERVAL.split(", ")])

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list = []  # whole keys
        last: list = []  # rows of the key being read
        ready_bytes = last_bytes = 0
        crowded = None
        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if last and row[0] != last[0][0]:
                    ready += last
                    ready_bytes += last_bytes
                    last, last_bytes = [], 0
                    if ready_bytes >= MERGE_BYTES:
                        yield merged(ready)
                        ready, ready_bytes = [], 0
                if row[0] == crowded:
                    yield from windows([row])
                    continue
                last.append(row)
                last_bytes += len(row[3])
                if last_bytes > KEY_BYTES:
                    crowded = row[0]
                    yield from windows(last)
                    last, last_bytes = [], 0
        if ready or last:
            yield merged(ready + last)

    spark = fetched.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return fetched.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, INTERVAL)


def repeated_intervals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, mark, from_byte, to_byte): byte intervals covered by strings of ``length`` bytes that also start elsewhere."""
    bounded_batches(docs.sparkSession)
    judged = materialise(classify(runs(docs, length)), "runs")
    spot, mark = F.col("spot"), F.col("spot").bitwiseAND(F.lit(0xFFFF).cast("bigint")).alias("mark")
    start = F.shiftright(spot, 32)
    stop = start + F.shiftright(spot, 16).bitwiseAND(F.lit(COUNT).cast("bigint")) - 1 + length
    full = judged.where("full").select("rid", mark, start.alias("from_byte"), stop.alias("to_byte"))
    fetched = contexts(docs, judged.where("fetch").select("key", "rid", "spot"), length)
    found = materialise(merge_keys(fetched, length), "intervals")
    merged = found.where("h1 is null").select("rid", "mark", "from_byte", "to_byte")
    crowded = found.where("h1 is not null")
    twice = crowded.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    counted = crowded.join(twice, ["h1", "h2"]).select("rid", "mark", "from_byte", "to_byte")
    return full.unionByName(merged).unionByName(counted)


def _kept(text: bytes, starts: list[int] | None, stops: list[int] | None) -> tuple[list[bytes], int, int]:
    """(kept pieces, bytes removed, maximal removed runs)."""
    keep, at, gone, n = [], 0, 0, 0
    end = -1
    for s, e in sorted(zip(starts or (), stops or ())):
        if s > end:
            keep.append(text[at:s])
            n += 1
            gone += e - s
            at = end = e
        elif e > end:
            gone += e - end
            at = end = e
    keep.append(text[at:])
    return keep, gone, n


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each text as UTF-8 bytes.

    Removed is each byte covered by a ``length``-byte string that also starts
    anywhere else in the table, the same text included; strings are judged on
    the input and never cross texts.  A NULL text is empty.  Of equal texts,
    repeated rows included, every one loses what the other has.
    """
    covered = repeated_intervals(docs, length).groupBy("rid", "mark").agg(F.collect_list("from_byte").alias("starts"), F.collect_list("to_byte").alias("stops"))

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for text, starts, stops in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                keep, gone, n = _kept(text, starts, stops)
                kept = b"".join(keep)
                rows.append((len(text), gone, n, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = _texts(docs).join(covered, ["rid", "mark"], "left").select("doc_id", "text", "starts", "stops")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
