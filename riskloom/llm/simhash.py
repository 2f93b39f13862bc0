"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import components
from riskloom.llm.text import batches, bounded_batches, word_blocks
from riskloom.session import materialise

SEED = 42
SHINGLE = 3

#: Perfect binary codes as (length, generator polynomial, covering radius).
GOLAY = (23, 0b110001110101, 3)
HAMMING = (15, 0b10011, 1)

#: Members of one anchor held in memory; fuller anchors are linked over shared midpoints instead.
ANCHOR_LIMIT = 20_000
#: So many ids of dropped documents are sent to all tasks, 8 MB of them.
BROADCAST_IDS = 1_000_000
#: Up to this size home and member fingerprints of an anchor are compared directly.
PAIRWISE = 64


# ---------------------------------------------------------------- fingerprints

def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text; 0 when it has no word."""
    votes, total, carry = np.zeros(64, np.int64), 0, []
    for words in word_blocks((raw or b"").lower()):
        words = carry + words
        carry = words if len(words) < shingle else words[len(words) - shingle + 1:]
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(start, end[shingle - 1:].tolist())], np.uint64)
        total += len(h)
        for i in range(0, len(h), 1 << 15):
            part = h[i:i + (1 << 15)]
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not total:
        if not carry:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED)
    bits = np.packbits(2 * votes > total, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp BIGINT): the SimHash of each whole text; NULL and empty texts have fingerprint 0."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(it, "doc_id", "text"):
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


# --------------------------------------------------------------- covering code

@dataclass
class Block:
    """Error patterns of a perfect code on some bits of the fingerprint, by syndrome and excess.

    ``excess`` of a pattern is how far its weight exceeds the covering radius.
    Excess 0 has exactly one pattern per syndrome: the way to the home anchor.
    """

    shift: int
    length: int
    remainder: np.ndarray  # of each byte-sized piece of a block value
    starts: list[np.ndarray]  # per excess: first pattern of each syndrome, plus the end
    patterns: list[np.ndarray]

    @classmethod
    def of(cls, code: tuple[int, int, int], shift: int, threshold: int) -> Block:
        length, generator, radius = code
        degree = generator.bit_length() - 1
        single = []
        r = 1
        for _ in range(length):
            single.append(r)
            r <<= 1
            if r >> degree:
                r ^= generator
        remainder = np.zeros((3, 256), np.int64)
        for piece in range(3):
            for value in range(256):
                for bit in range(8):
                    if value >> bit & 1 and 8 * piece + bit < length:
                        remainder[piece, value] ^= single[8 * piece + bit]
        found: list[list[tuple[int, int]]] = [[] for _ in range(threshold + 1)]
        for weight in range(radius + threshold + 1):
            for bits in combinations(range(length), weight):
                s = e = 0
                for b in bits:
                    s ^= single[b]
                    e |= 1 << b
                found[max(0, weight - radius)].append((s, e))
        starts, patterns = [], []
        for level in found:
            table = np.array(sorted(level), np.int64)
            starts.append(np.searchsorted(table[:, 0], np.arange((1 << degree) + 1)))
            patterns.append(table[:, 1])
        return cls(shift, length, remainder, starts, patterns)

    def split(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of the block and its syndrome."""
        value = (fp >> np.uint64(self.shift)).astype(np.int64) & ((1 << self.length) - 1)
        r = self.remainder
        return value, r[0][value & 255] ^ r[1][value >> 8 & 255] ^ r[2][value >> 16 & 255]


def code_blocks(codes: list[tuple[int, int, int]], threshold: int) -> list[Block]:
    blocks, at = [], 0
    for code in codes:
        blocks.append(Block.of(code, at, threshold))
        at += code[0]
    if at > 63:
        raise ValueError("the codes cover more bits than a fingerprint can spare")
    return blocks


def replicate(fp: np.ndarray, blocks: list[Block], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of each fingerprint: (anchor, fingerprint, is it the home anchor).

    An anchor is one codeword per block.  The home anchor is within the covering
    radius in every block; replicas go to all anchors whose excesses over the
    radii add up to ``threshold`` at most, so the home anchor of every
    fingerprint within ``threshold`` bits is among them.
    """
    index = np.arange(len(fp))
    anchor = np.zeros(len(fp), np.int64)
    spent = np.zeros(len(fp), np.int64)
    for block in blocks:
        value, syndrome = block.split(fp)
        grown = []
        for excess in range(threshold + 1):
            keep = spent + excess <= threshold
            i, a, s = index[keep], anchor[keep], spent[keep]
            first = block.starts[excess][syndrome[i]]
            count = block.starts[excess][syndrome[i] + 1] - first
            row = np.repeat(np.arange(len(i)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            word = value[i[row]] ^ block.patterns[excess][first[row] + nth]
            grown.append((i[row], a[row] << block.length | word, s[row] + excess))
        index, anchor, spent = (np.concatenate(x) for x in zip(*grown))
    return anchor, fp[index], spent == 0


# --------------------------------------------------------------------- linking

def link_members(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint, root) among distinct fingerprints at 2 or fewer bits.

    Two words differ in at most two bits exactly if some midpoint is within one
    bit of both, so members sharing a midpoint are joined: linear work, however
    dense the group.
    """
    n = len(fp)
    flips = np.concatenate([np.zeros(1, np.uint64), np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))])
    middle = (fp[:, None] ^ flips[None, :]).ravel()
    member = np.repeat(np.arange(n), 65)
    order = np.argsort(middle, kind="stable")
    middle, member = middle[order], member[order]
    same = np.flatnonzero(middle[1:] == middle[:-1])
    a, b = member[same], member[same + 1]
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(n))
    return fp[moved], fp[root[moved]]


def link_anchors(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole anchors, whose rows stand together."""
    edge = np.flatnonzero(np.diff(anchor)) + 1
    start = np.concatenate([[0], edge])
    size = np.diff(np.concatenate([start, [len(anchor)]]))
    homes = np.add.reduceat(home.astype(np.int64), start)
    out_a, out_b = [], []
    if threshold == 2:
        for g in np.flatnonzero((size > PAIRWISE) & (homes > 0)):
            a, b = link_members(fp[start[g]:start[g] + size[g]])
            out_a.append(a)
            out_b.append(b)
        small = (size <= PAIRWISE) & (size > 1) & (homes > 0)
    else:
        small = (size > 1) & (homes > 0)
    group = np.repeat(np.arange(len(start)), size)
    left = np.flatnonzero(home & small[group])
    for i in range(0, len(left), 1 << 13):
        part = left[i:i + (1 << 13)]
        count = size[group[part]]
        x = np.repeat(part, count)
        y = start[group[x]] + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
        near = (np.bitwise_count(fp[x] ^ fp[y]) <= threshold) & (fp[x] != fp[y])
        out_a.append(fp[x[near]])
        out_b.append(fp[y[near]])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def links(nodes: DataFrame, threshold: int = 2, codes: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, enough to connect all at ``threshold`` or fewer bits.

    Replicas are shuffled by anchor and compared as sorted streams; a task holds
    one anchor up to ANCHOR_LIMIT members.  The members of a fuller anchor come
    out as rows without ``b`` and are linked over shared midpoints, at most 65
    fingerprints each, so nothing is capped.
    """
    if threshold not in (1, 2):
        raise ValueError("links at one or two bits are supported")
    codes = codes or [GOLAY, GOLAY]

    def spread(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = code_blocks(codes, threshold)
        for batch in it:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 4096):
                anchor, fp, home = replicate(fps[i:i + 4096], blocks, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp.view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    def compare(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            right = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), right], ["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        count, overflow = 0, None
        for batch in it:
            anchor = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(anchor):
                continue
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            home = batch.column(2).to_numpy(zero_copy_only=False)
            if overflow is not None:
                rest = int(np.searchsorted(anchor, overflow, "right"))
                if rest:
                    yield out(fp[:rest], None)
                anchor, fp, home = anchor[rest:], fp[rest:], home[rest:]
                if not len(anchor):
                    continue
                overflow = None
            last = int(np.searchsorted(anchor, anchor[-1], "left"))
            if held and (last or anchor[0] != held[0][0][0]):
                first = int(np.searchsorted(anchor, held[0][0][0], "right"))
                whole = [np.concatenate(x) for x in zip(*held, (anchor[:first], fp[:first], home[:first]))]
                yield out(*link_anchors(*whole, threshold))
                held, count = [], 0
                if first < last:
                    yield out(*link_anchors(anchor[first:last], fp[first:last], home[first:last], threshold))
            elif last:
                yield out(*link_anchors(anchor[:last], fp[:last], home[:last], threshold))
            held.append((anchor[last:], fp[last:], home[last:]))
            count += len(anchor) - last
            if count > ANCHOR_LIMIT:
                overflow = anchor[-1]
                for _, kept, _ in held:
                    yield out(kept, None)
                held, count = [], 0
        if held:
            yield out(*link_anchors(*(np.concatenate(x) for x in zip(*held)), threshold))

    spark = nodes.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    replicas = nodes.select("fp").mapInArrow(spread, "anchor bigint, fp bigint, home boolean")
    found = materialise(replicas.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a bigint, b bigint"), "links")
    near = found.where("b is not null")
    crowded = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)])
    around = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    shared = around.groupBy("middle").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    shared = shared.select("a", F.explode("fps").alias("b"))
    if threshold == 1:
        shared = shared.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 1)
    return near.unionByName(shared)


def near_duplicates(docs: DataFrame, threshold: int = 2, codes: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints chain together within ``threshold`` bits.

    ``component_id`` is the smallest doc_id of the component.  Repeated rows are
    repeated in the result; a NULL doc_id belongs to its component but never
    names it unless the component has no other id; NULL and empty texts share
    fingerprint 0.  Other columns, whatever their names, are ignored.
    """
    marked = materialise(fingerprints(docs), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(links(nodes, threshold, codes))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", "root")
    least = linked.where("root is not null").groupBy("root").agg(F.min("first_id").alias("least_id"))
    classes = linked.join(least, "root", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    # A fingerprint may hold a third of all rows: this join's partitions are split by adaptive execution.
    return marked.join(materialise(classes, "classes"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """One document of each component of ``docs``, columns unchanged; the rows themselves are judged, not their ids.

    A component keeps a row of its smallest doc_id and, among rows that share
    that id, of the smallest fingerprint and text; of equal rows one stays,
    which of them is all the same.  So a text without a copy stays whatever its
    id, NULL or repeated.  NULL and empty texts are copies of each other; a
    component without any id keeps one row too.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    numbered = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")  # written, so a row keeps its number

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, ids, texts in batches(it, "row", "doc_id", "text"):
            fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            order = np.array([xxhash.xxh64_intdigest(t or b"") for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(ids, pa.int64()), pa.array(fp), pa.array(order)], ["row", "doc_id", "fp", "text_hash"])

    rows = numbered.select(F.col("__row").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    marked = materialise(rows.mapInArrow(run, "row bigint, doc_id bigint, fp bigint, text_hash bigint"), "marked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", "text_hash", "row"))
    nodes = materialise(marked.groupBy("fp").agg(first.alias("first")), "nodes")  # combined before the shuffle
    roots = materialise(components(links(nodes, threshold)).select(F.col("node").alias("fp"), "root"), "roots")
    alone = nodes.join(roots, "fp", "left_anti").select(F.col("first.row").alias("__row"))
    joined = nodes.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first"))
    stay = alone.unionByName(joined.select(F.col("first.row").alias("__row")))
    gone = marked.select(F.col("row").alias("__row")).join(stay, "__row", "left_anti")
    gone = materialise(gone, "gone")
    few = gone.count() <= BROADCAST_IDS  # numbers alone; else the texts are shuffled to them
    left = numbered.join(F.broadcast(gone) if few else gone, "__row", "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
