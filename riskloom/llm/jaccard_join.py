"""Near-duplicate documents by n-gram Jaccard similarity: universe partition and pigeonhole.

Tokens are hashed shingles.  Two sets of sizes r and s that link differ in at
most H = (1 - t) / (1 + t) * (r + s) tokens.  The universe is cut into H + 1
segments (by size band), so at least one segment holds the same tokens in both
sets: sets meet where the subset of a segment is the same.

Where many sets meet by chance, a set may leave out up to e of its crowded
segments.  For that, e segments of the band are matched with one token more or
less (the subset and its one-deletion neighbourhood), which raises what the
segments add up to by e.  Equal segments are equally crowded, so of two linked
sets that leave segments out, each still shows one of the others.  The measured
crowding decides e and the segments (``allocate``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.components import components
from riskloom.llm.text import bounded_batches, word_blocks
from riskloom.session import materialise

SHINGLE = 3
#: Links at intersection / union >= NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 90, 100
#: Sizes of a band grow by this share.  A set is a guest of the next band if a partner may stand there.
BAND_GROWTH = 1.4
#: Signatures held by more sets are crowded: their sets are compared as a group, not pair by pair.
CROWD = 16
#: Most crowded segments that a set may leave out.
MAX_SLACK = 8
#: Rows of one-deletion neighbourhoods that a comparison saved is worth: a row is shuffled, a comparison is a few bytes in a task.
PAIR_COST = 0.05
#: Tokens of one block of a group; blocks of a group meet two at a time.
BLOCK_TOKENS = 1 << 17
#: So many doc_ids are sent to all tasks, 8 MB of them.
BROADCAST_IDS = 1_000_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def tokens(raw: bytes | None, shingle: int = SHINGLE, salt: int = 0) -> np.ndarray:
    """Sorted distinct 64-bit tokens of a whole text: its word shingles, or the whole sequence if it is shorter."""
    found, carry = [], []
    digest = xxhash.xxh64_intdigest
    for words in word_blocks((raw or b"").lower()):
        words = carry + words
        carry = words if len(words) < shingle else words[len(words) - shingle + 1:]
        if len(words) >= shingle:
            h = np.fromiter((digest(w, salt) for w in words), np.uint64, len(words))
            t = np.zeros(len(h) - shingle + 1, np.uint64)
            for k in range(shingle):
                t = mix(t + h[k:len(h) - shingle + 1 + k] + _A)
            found.append(np.unique(t))
    if not found and carry:
        t = np.full(1, len(carry), np.uint64)
        for w in carry:
            t = mix(t + np.uint64(digest(w, salt)) + _A)
        found.append(mix(t))
    if not found:
        return np.zeros(0, np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def names(t: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums that name a set of tokens."""
    return int(mix(mix(t ^ _A).sum(keepdims=True) + np.uint64(len(t)))[0]), int(mix(t ^ _C).sum())


@dataclass(frozen=True)
class Bands:
    """Size bands; ``limit`` is the most tokens in which two linked sets of a band differ."""

    numerator: int = NUMERATOR
    denominator: int = DENOMINATOR

    def start(self, band: int) -> int:
        size = 1
        for _ in range(band):
            size = max(size + 1, int(size * BAND_GROWTH))
        return size

    def of(self, size: int) -> int:
        band, at = 0, 1
        while (following := max(at + 1, int(at * BAND_GROWTH))) <= size:
            band, at = band + 1, following
        return band

    def differ(self, both: int) -> int:
        """Most tokens in which linked sets of ``both`` tokens together differ."""
        return (self.denominator - self.numerator) * both // (self.denominator + self.numerator)

    def segments(self, band: int) -> int:
        return self.differ(2 * (self.start(band + 1) - 1)) + 1

    def shown(self, size: int) -> int:
        """How many segments, the first ones, a set has to show: one more than it may differ in from its largest partner."""
        return self.differ(size + size * self.denominator // self.numerator) + 1

    def joined(self, size: int) -> list[int]:
        """The bands in which a set of ``size`` tokens is indexed."""
        home = self.of(size)
        guest = size * self.denominator // self.numerator >= self.start(home + 1)
        return [home, home + 1] if guest else [home]


def split(t: np.ndarray, band: int, segments: int) -> np.ndarray:
    """Segment of each token."""
    return ((mix(t + np.uint64(band)) >> np.uint64(16)) % np.uint64(segments)).astype(np.int64)


def signatures(t: np.ndarray, band: int, segments: int, shown: int) -> np.ndarray:
    """One signature for each of the first ``shown`` segments: equal segments have equal ones."""
    sums = np.zeros(segments, np.uint64)
    np.add.at(sums, split(t, band, segments), mix(t))
    sums = sums[:shown]
    return mix(sums + np.arange(len(sums), dtype=np.uint64) * _A + np.full(1, band, np.uint64) * _B)


def deletions(t: np.ndarray, band: int, segments: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, is it the whole segment, segment) of the chosen segments and of them without one token each."""
    at = split(t, band, segments)
    sums = np.zeros(segments, np.uint64)
    np.add.at(sums, at, mix(t))
    inside = np.flatnonzero(np.isin(at, chosen))
    value = np.concatenate([sums[chosen], sums[at[inside]] - mix(t[inside])])
    segment = np.concatenate([chosen, at[inside]])
    whole = np.arange(len(value)) < len(chosen)
    return mix(value + segment.astype(np.uint64) * _C + np.full(1, band, np.uint64) * _A + np.uint64(1)), whole, segment


def sketch(t: np.ndarray, segments: int) -> np.ndarray:
    """One byte per segment; two sets differ in at least as many tokens as bytes."""
    sums = np.zeros(segments, np.uint64)
    np.add.at(sums, split(t, 1 << 20, segments), mix(t))
    return mix(sums).astype(np.uint8)


# ---------------------------------------------------------------------- index

_BAND = T.StructType([T.StructField("band", T.IntegerType()), T.StructField("sigs", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
_INDEX = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("check", T.LongType()), T.StructField("bands", T.ArrayType(_BAND))])
_BAND_ARROW = pa.struct([("band", pa.int32()), ("sigs", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _texts(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def index(docs: DataFrame, bands: Bands, salt: int) -> DataFrame:
    """(doc_id, n, node, check, bands): size and name of each document's set, and once per task and set its signatures."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in it:
            rows: list[tuple] = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = tokens(raw.as_py(), salt=salt)
                if not len(t):
                    rows.append((doc, 0, None, None, None))
                    continue
                node, check = map(_signed, names(t))
                entries = None
                if node not in seen:
                    seen.add(node)
                    entries = []
                    for band in bands.joined(len(t)):
                        m = bands.segments(band)
                        entries.append({"band": band, "sigs": signatures(t, band, m, bands.shown(len(t))).view(np.int64), "sketch": sketch(t, 2 * m).tobytes()})
                rows.append((doc, len(t), node, check, entries))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.list_(_BAND_ARROW)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], _INDEX.names)

    return _texts(docs).mapInArrow(run, _INDEX)


def meeting(rows: DataFrame) -> DataFrame:
    """``rows`` (key, node, own, ...) whose key is held by two different nodes, one of them with a whole segment.

    Most keys stand alone.  They go by counts of 48 bits of the key, which are
    small and add up before the shuffle; what is left is then decided exactly.
    """
    part = F.shiftright("key", 16).alias("part")
    several = rows.groupBy(part).agg(F.count("*").alias("rows")).where("rows > 1").select("part")
    rows = materialise(rows.withColumn("part", part).join(several, "part", "left_semi").drop("part"), "several")
    held = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("own").alias("own"))
    return rows.join(held.where("low < high and own").select("key"), "key", "left_semi").distinct()


def allocate(rows: DataFrame, sets: DataFrame, bands: Bands) -> tuple[DataFrame, dict[int, int], dict[int, list[int]]]:
    """(crowded segments per set, slack e of each band, its e segments for one-deletion neighbourhoods).

    Leaving out what up to e crowded segments bring saves their comparisons and
    costs e neighbourhoods of every set in the band: e is where most is gained.
    """
    crowded = materialise(rows.where(F.col("c") > CROWD).groupBy("node", "band").agg(F.count("*").alias("crowded"), F.sum("c").alias("met")), "crowded")
    size = {r.band: (r.sets, r.tokens) for r in sets.groupBy("band").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")).collect()}
    saved: dict[int, dict[int, int]] = {}
    for r in crowded.where(F.col("crowded") <= MAX_SLACK).groupBy("band", "crowded").agg(F.sum("met").alias("met")).collect():
        saved.setdefault(r.band, {})[r.crowded] = r.met
    slack: dict[int, int] = {}
    for band, met in saved.items():
        n, held = size[band]
        m = bands.segments(band)
        gain = {e: PAIR_COST * sum(v for k, v in met.items() if k <= e) - e * (n + held / m) for e in range(1, min(MAX_SLACK, m) + 1)}
        e = max(gain, key=lambda k: (gain[k], -k))
        if gain[e] > 0:
            slack[band] = e
    chosen: dict[int, list[int]] = {}
    if slack:
        load = rows.where(F.col("band").isin(list(slack))).groupBy("band", "segment").agg(F.sum("c").alias("met")).collect()
        met_at = {(r.band, r.segment): r.met for r in load}
        for band, e in slack.items():
            chosen[band] = sorted(sorted(range(bands.segments(band)), key=lambda s: (met_at.get((band, s), 0), s))[:e])
    return crowded, slack, chosen


def neighbourhoods(docs: DataFrame, bands: Bands, salt: int, chosen: dict[int, list[int]]) -> DataFrame:
    """(key, node, band, own): the chosen segments whole (own) and without one token each."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in it:
            key, node, at, own = [], [], [], []
            for raw in batch.column(1):
                t = tokens(raw.as_py(), salt=salt)
                mine = [b for b in (bands.joined(len(t)) if len(t) else []) if b in chosen]
                if mine and (name := _signed(names(t)[0])) not in seen:
                    seen.add(name)
                    for band in mine:
                        value, whole, _ = deletions(t, band, bands.segments(band), np.array(chosen[band]))
                        key.append(value.view(np.int64))
                        own.append(whole)
                        node.append(np.full(len(value), name, np.int64))
                        at.append(np.full(len(value), band, np.int32))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (key, node, at, own)], ["key", "node", "band", "own"])

    return _texts(docs).mapInArrow(run, "key bigint, node bigint, band int, own boolean")


def candidates(docs: DataFrame, found: DataFrame, bands: Bands, salt: int) -> DataFrame:
    """(key, node, band, own, c): where sets meet; every two linked sets stand under one key at least."""
    each = found.where("bands is not null").select("node", "n", F.explode("bands").alias("b")).select("node", "n", "b.*")
    rows = each.select("node", F.posexplode("sigs").alias("segment", "key"), "band").select("key", "node", F.shiftleft(F.col("band").cast("bigint"), 32).bitwiseOR(F.col("segment")).alias("at"))
    met = materialise(meeting(rows.withColumn("own", F.lit(True))), "meeting")
    met = met.join(met.groupBy("key").agg(F.count("*").alias("c")), "key")
    met = materialise(met.select("key", "node", F.shiftright("at", 32).cast("int").alias("band"), F.col("at").bitwiseAND((1 << 32) - 1).cast("int").alias("segment"), "own", "c"), "met")
    crowded, slack, chosen = allocate(met, each.select("node", "band", "n"), bands)
    if not slack:
        return met.drop("segment")
    pair = F.struct("band", "segment")
    spare = [F.struct(F.lit(b).alias("band"), F.lit(s).alias("segment")) for b, at in chosen.items() for s in at]
    allowed = F.coalesce(F.create_map(*[F.lit(x) for item in slack.items() for x in item])[F.col("band")], F.lit(0))
    left_out = (F.col("c") > CROWD) & (F.coalesce("crowded", F.lit(0)) <= allowed) & F.col("crowded").isNotNull()
    kept = met.where(~pair.isin(*spare)).join(crowded.select("node", "band", "crowded"), ["node", "band"], "left").where(~left_out).select("key", "node", "band", "own", "c")
    near = materialise(meeting(neighbourhoods(docs, bands, salt, chosen)), "neighbourhoods")
    near = near.groupBy("key", "node", "band").agg(F.max("own").alias("own"))
    near = near.join(near.groupBy("key").agg(F.count("*").alias("c")), "key")
    return materialise(kept.unionByName(near.select(*kept.columns)), "candidates")


# -------------------------------------------------------------------- linking

def near_pairs(live: DataFrame, found: DataFrame, bands: Bands) -> DataFrame:
    """(a, b): pairs under keys that few sets hold, as far as sizes and sketches leave a link possible."""
    x = live.where(F.col("c") <= CROWD).select("key", "node", "band", "own")
    y = x.toDF("key", "other", "b2", "own2")
    pairs = x.join(y, "key").where("node < other and (own or own2)").select(F.col("node").alias("a"), F.col("other").alias("b"), "band").distinct()
    pairs = materialise(pairs, "pairs")
    sk = found.where("bands is not null").select("node", "n", F.explode("bands").alias("x")).select("node", "n", F.col("x.band").alias("band"), F.col("x.sketch").alias("s"))
    sk = sk.join(pairs.select("a").unionAll(pairs.select("b")).distinct().toDF("node"), "node", "left_semi")
    sk = materialise(sk.dropDuplicates(["node", "band"]), "sketches")
    both = pairs.join(sk.toDF("a", "na", "band", "sa"), ["a", "band"]).join(sk.toDF("b", "nb", "band", "sb"), ["b", "band"])

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b, na, sa, nb, sb = (batch.column(i).to_pylist() if i > 1 else batch.column(i) for i in range(6))
            keep = [
                i for i, (n, s, k, u) in enumerate(zip(na, sa, nb, sb))
                if bands.denominator * min(n, k) >= bands.numerator * max(n, k) and np.count_nonzero(np.frombuffer(s, np.uint8) != np.frombuffer(u, np.uint8)) <= bands.differ(n + k)
            ]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], ["a", "b"])

    return both.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a bigint, b bigint")


def group_edges(live: DataFrame) -> DataFrame:
    """(a, b): the sets under a crowded key, each with the least one."""
    x = live.where(F.col("c") > CROWD)
    least = x.groupBy("key").agg(F.min("node").alias("a"))
    return x.join(least, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def connect(n: np.ndarray, sketches: np.ndarray, left: list[bool] | None, bands: Bands, linked: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """Links that connect what is linked among the sets, or between those on the left and the others; sizes and sketches are tried first."""
    label = np.arange(len(n))
    side = None if left is None else np.array(left)
    for i in range(len(n) - 1):
        rest = slice(i + 1, len(n))
        most = (bands.denominator - bands.numerator) * (n[rest] + n[i]) // (bands.denominator + bands.numerator)
        able = (label[rest] != label[i]) & (bands.denominator * np.minimum(n[rest], n[i]) >= bands.numerator * np.maximum(n[rest], n[i]))
        if side is not None:
            able &= side[rest] != side[i]
        at = np.flatnonzero(able)
        at = at[np.count_nonzero(sketches[i + 1 + at] != sketches[i], axis=1) <= most[at]] + i + 1
        for j in at.tolist():
            if label[j] != label[i] and linked(i, j):
                yield i, j
                label[label == label[j]] = label[i]


def link_sets(node: list[int], sets: list[np.ndarray], left: list[bool] | None, bands: Bands) -> list[tuple[int, int]]:
    """Links that connect what is linked among the sets, or between those on the left and the others."""
    n = np.array([len(t) for t in sets])
    m = 4 * (bands.differ(2 * int(n.max())) + 1)

    def linked(i: int, j: int) -> bool:
        same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return bands.denominator * same >= bands.numerator * (n[i] + n[j] - same)

    return [(node[i], node[j]) for i, j in connect(n, np.stack([sketch(t, m) for t in sets]), left, bands, linked)]


def link_sketches(found: DataFrame, large: DataFrame, bands: Bands) -> DataFrame:
    """(a, b): links that connect those sets of a group (node, grp) whose sizes and sketches leave a link possible.

    Two sets that link stand in one band at least, so the sets of a group and
    band meet, in blocks two at a time.  A sketch has about a fortieth of the
    bytes of its set.
    """

    def compare(rows: pa.Table) -> pa.Table:
        node, block = rows["node"].to_pylist(), rows["block"].to_pylist()
        left = None if rows["low"][0] == rows["high"][0] else [b == rows["low"][0].as_py() for b in block]
        sketches = np.stack([np.frombuffer(x, np.uint8) for x in rows["s"].to_pylist()])
        edges = list(connect(rows["n"].to_numpy(), sketches, left, bands, lambda i, j: True))
        return pa.table({"a": pa.array([node[i] for i, _ in edges], pa.int64()), "b": pa.array([node[j] for _, j in edges], pa.int64())})

    sk = found.where("bands is not null").select("node", "n", F.explode("bands").alias("x")).select("node", "n", F.col("x.band").alias("band"), F.col("x.sketch").alias("s"))
    sk = materialise(sk.join(large, "node").dropDuplicates(["node", "band"]), "group-sketches")
    blocks = sk.groupBy("grp", "band").agg(F.ceil(F.sum(F.length("s")) / (8 * BLOCK_TOKENS)).cast("int").alias("blocks"))
    return in_blocks(sk.join(blocks, ["grp", "band"]), ["grp", "band"], ["node", "n", "s"]).applyInArrow(compare, "a bigint, b bigint")


def in_blocks(sets: DataFrame, keys: list[str], columns: list[str]) -> GroupedData:
    """``sets`` (node, blocks, keys, columns) in groups of two blocks (low, high) each, or of one."""
    sets = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = sets.select(*keys, *columns, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    met = met.select(*keys, *columns, "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    return met.groupBy(*keys, "low", "high")


def links(docs: DataFrame, found: DataFrame, nodes: DataFrame, bands: Bands, salt: int) -> DataFrame:
    """Links (a, b) between sets, enough to connect all that are linked.

    What may be linked forms groups.  Crowded keys, such as those of empty
    segments, chain sets that have little in common to large groups, so what is
    larger than a block is first cut to what its sketches leave possible.  A
    group is then cut into blocks of bounded size by hash, blocks meet two at a
    time, and a task returns the links that connect its sets, at most one per set.
    """
    spark = docs.sparkSession
    live = candidates(docs, found, bands, salt)
    edges = near_pairs(live, found, bands).unionByName(group_edges(live))
    groups = components(edges).withColumnRenamed("root", "grp")
    member = materialise(nodes.join(groups, "node"), "members")

    def sized(member: DataFrame) -> DataFrame:
        blocks = member.groupBy("grp").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
        return member.join(blocks, "grp").select("node", "first_id", "n", "grp", "blocks")

    member = materialise(sized(member), "grouped")
    large = member.where("blocks > 1").select("node", "grp")
    if not large.isEmpty():
        parts = components(link_sketches(found, large, bands)).withColumnRenamed("root", "grp")
        member = materialise(member.where("blocks = 1").unionByName(sized(nodes.join(parts, "node"))), "regrouped")
    ids = materialise(member.select("first_id").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    wanted = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").cast("bigint").eqNullSafe(F.col("first_id")), "left_semi")

    def read(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in it:
            rows = []
            for raw in batch.column(1):
                t = tokens(raw.as_py(), salt=salt)
                if len(t) and (name := _signed(names(t)[0])) not in seen:
                    seen.add(name)
                    rows.append((name, t.tobytes()))
            cols = list(zip(*rows)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], ["node", "tokens"])

    def compare(rows: pa.Table) -> pa.Table:
        node, sets, block = rows["node"].to_pylist(), [np.frombuffer(x, np.uint64) for x in rows["tokens"].to_pylist()], rows["block"].to_pylist()
        left = None if rows["low"][0] == rows["high"][0] else [b == rows["low"][0].as_py() for b in block]
        edges = link_sets(node, sets, left, bands)
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    sets = _texts(wanted).mapInArrow(read, "node bigint, tokens binary").join(member.select("node", "grp", "blocks"), "node")
    return in_blocks(sets, ["grp"], ["node", "tokens"]).applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents whose shingle sets chain together at the threshold.

    ``component_id`` is the smallest doc_id of the component.  A document without
    words (NULL, empty, blank) has no shingle and is linked with nothing: its own
    id is its component.  Repeated rows are repeated; a NULL doc_id belongs to its
    component but names it only if no other id does.  Other columns, whatever
    their names, are ignored.  Sets are compared by 64-bit tokens.
    """
    if not 0 < numerator < denominator:
        raise ValueError("the threshold lies between 0 and 1")
    bands = Bands(numerator, denominator)
    salt = 0
    while True:
        found = materialise(index(docs, bands, salt), "index")
        named = found.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n"), F.max("n").alias("n2"), F.min("check").alias("c1"), F.max("check").alias("c2"))
        nodes = materialise(named, "nodes")
        if nodes.where("n <> n2 or c1 <> c2").isEmpty():
            break
        salt += 1  # two sets share a 64-bit name: take other hashes
    nodes = nodes.select("node", "first_id", "n")
    roots = components(links(docs, found, nodes, bands, salt))
    linked = nodes.join(roots, "node", "left").select("node", "first_id", "root")
    least = linked.where("root is not null").groupBy("root").agg(F.min("first_id").alias("least_id"))
    classes = materialise(linked.join(least, "root", "left").select("node", F.coalesce("least_id", "first_id").alias("component_id")), "classes")
    rows = found.select("doc_id", "n", "node")
    # A set may belong to a third of all rows: this join's partitions are split by adaptive execution.
    some = rows.where("n > 0").join(classes, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
