"""Ranked lexical search of many items at once: term sets shared by items are summed once per document."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.text import bounded_batches, word_blocks
from riskloom.session import materialise

TOP = 10
#: Item terms evaluated in one pass over the documents, so what a pass broadcasts is a few megabytes.
BLOCK_TERMS = 100_000
#: Nodes of one item that take part in mining; the others are added one by one.
MINED = 256
#: Bytes of the accumulators of one step in a task.
STEP_BYTES = 32 << 20
#: First merge of the tasks' best documents runs by item and so many salts.
SALTS = 32
#: Letters and digits stay, capitals are lower-cased, other ASCII separates.
NORMAL = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def term_counts(raw: bytes | None, wanted: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """(number of terms, occurrences of the wanted ones by number) of one whole text."""
    n, found = 0, Counter()
    for words in word_blocks((raw or b"").translate(NORMAL)):
        n += len(words)
        for word, k in Counter(words).items():
            t = wanted.get(word)
            if t is not None:
                found[t] += k
    return n, found


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) once each.  Rows that share an item_id, NULL included, are one item with the terms of all."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows, terms = [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                own = {w for words in word_blocks((raw or b"").translate(NORMAL)) for w in words}
                rows.extend([i] * len(own))
                terms.extend(sorted(own))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.binary())], ["item_id", "term"])

    rows = items.select("item_id", F.col("text").cast("binary").alias("text"))
    kind = T.StructType([items.schema["item_id"], T.StructField("term", T.BinaryType())])
    return rows.mapInArrow(run, T.StructType([T.StructField("item_id", kind[0].dataType), kind[1]])).distinct()


# -------------------------------------------------------------------- sharing

def sharing_dag(items: list[list[int]], leaves: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(nodes, parts): node ``leaves + i`` is the sum of the two earlier nodes ``nodes[i]``; an item is the sum of its parts.

    The pair of nodes that most items hold together becomes a node of its own,
    again and again, as long as two items share one; so larger shared term sets
    grow out of smaller ones and each is summed once.  What is mined changes the
    number of additions only, never a sum.
    """
    held: dict[int, set[int]] = {}
    for i, terms in enumerate(items):
        for t in terms:
            held.setdefault(t, set()).add(i)
    parts = [set(terms) for terms in items]
    shared = [sorted((t for t in terms if len(held[t]) > 1), key=lambda t: (-len(held[t]), t))[:MINED] for terms in items]
    pairs = Counter(p for terms in shared for p in combinations(sorted(terms), 2))
    heap = [(-c, a, b) for (a, b), c in pairs.items() if c > 1]
    heapq.heapify(heap)
    nodes: list[tuple[int, int]] = []
    while heap:
        count, a, b = heapq.heappop(heap)
        both = held[a] & held[b]
        if len(both) < -count:
            if len(both) > 1:
                heapq.heappush(heap, (-len(both), a, b))
            continue
        new = leaves + len(nodes)
        nodes.append((a, b))
        held[a] -= both
        held[b] -= both
        held[new] = both
        beside: Counter = Counter()
        for i in both:
            parts[i] -= {a, b}
            beside.update(x for x in parts[i] if len(held[x]) > 1)
            parts[i].add(new)
        for x, c in beside.most_common(MINED):
            if c > 1:
                heapq.heappush(heap, (-c, x, new))
    return nodes, [sorted(p) for p in parts]


# --------------------------------------------------------------------- search

def postings(docs: DataFrame, wanted: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of each document with a term: its length and its occurrences of the wanted terms."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows, sizes, ends, terms, counts = [], [], [0], [], []
            for i, raw in enumerate(batch.column(1)):
                n, found = term_counts(raw.as_py(), shared.value)
                if n:
                    rows.append(i)
                    sizes.append(n)
                    terms.extend(found)
                    counts.extend(found.values())
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind)) for v, kind in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


def best(score: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, top: int) -> np.ndarray:
    """Positions of the ``top`` highest positive scores; ties by ascending id, rows without id last."""
    if len(score) > top:
        least = max(1, int(np.partition(score, len(score) - top)[len(score) - top]))
        at = np.flatnonzero(score >= least)
    else:
        at = np.flatnonzero(score > 0)
    return at[np.lexsort((ids[at], unnamed[at], -score[at]))[:top]]


def best_of_tasks(found: DataFrame, weights: np.ndarray, nodes: list[tuple[int, int]], parts: list[list[int]], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): the ``top`` documents of each item in every task."""
    leaves = len(weights)
    step = max(16, STEP_BYTES // (8 * (leaves + len(nodes) + 1)))
    shared = found.sparkSession.sparkContext.broadcast((weights, nodes, parts))

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, dag, sums = shared.value
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        leaders = [none] * len(sums)
        for batch in it:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                unnamed = part.column(0).is_null().to_numpy(zero_copy_only=False)
                norm = np.array([10 + 90 * n * n_docs // n_terms for n in part.column(1).to_pylist()], np.int64)
                size = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(ids)), size)
                term = part.column(2).flatten().to_numpy(zero_copy_only=False)
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False)
                acc = np.zeros((leaves + len(dag), len(ids)), np.int64)
                acc[term, row] = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[row]))
                for i, (a, b) in enumerate(dag):  # each shared partial sum once
                    np.add(acc[a], acc[b], out=acc[leaves + i])
                for q, own in enumerate(sums):
                    score = acc[own].sum(axis=0)
                    now = best(score, ids, unnamed, top)
                    if len(now):
                        both = [np.concatenate(x) for x in zip(leaders[q], (score[now], ids[now], unnamed[now]))]
                        keep = best(*both, top)
                        leaders[q] = tuple(x[keep] for x in both)
        size = [len(x[0]) for x in leaders]
        if sum(size):
            score, ids, unnamed = (np.concatenate(x) for x in zip(*leaders))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(size), dtype=np.int32), size)), pa.array(ids, mask=unnamed), pa.array(score)], ["item", "doc_id", "score"]
            )

    return found.mapInArrow(run, "item int, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item, ranked among all documents.

    Equal scores rank by ascending doc_id, rows without one last; repeated rows
    are documents of their own.  NULL and empty texts have no terms: such a
    document is not counted, such an item has no result.  Other columns of either
    table, whatever their names, are ignored.  The texts are read once per
    BLOCK_TERMS item terms; an item stays in one block.
    """
    spark = docs.sparkSession
    own = materialise(item_terms(items), "item-terms")
    blocks = max(1, -(-own.count() // BLOCK_TERMS))
    out = None
    for k in range(blocks):
        part = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        rows = [(r.item_id, bytes(r.term)) for r in part.collect()]
        wanted = {t: i for i, t in enumerate(sorted({t for _, t in rows}))}
        names = sorted({i for i, _ in rows}, key=lambda i: (i is None, i))
        terms: dict = {i: [] for i in names}
        for i, t in rows:
            terms[i].append(wanted[t])
        found = materialise(postings(docs, wanted), "postings")
        total = found.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        held = np.zeros(len(wanted), np.int64)
        for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            held[r.t] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)
        nodes, parts = sharing_dag([sorted(terms[i]) for i in names], len(wanted))
        leaders = best_of_tasks(found, weights, nodes, parts, total.docs, total.terms, top)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        salted = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
        few = leaders.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
        ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        kind = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", items.schema["item_id"].dataType)])
        named = ranked.join(F.broadcast(spark.createDataFrame(list(enumerate(names)), kind)), "item").select("item_id", "rank", "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    return out
