"""Token ids packed into fixed-length sequences: best-fit decreasing with a segment tree over capacities."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.text import batches, bounded_batches

#: Vocabulary of ranks; a parameter of the operator, read by the driver and sent to the tasks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEQUENCE = 4096
#: Tokens that one packing round holds; a round's packs are filled before the next begins.
ROUND_TOKENS = 4_000_000
#: Largest vocabulary file that is sent to tasks.
VOCABULARY_BYTES = 64 << 20

PACK_SCHEMA = (
    "shard int, pack bigint, n_tokens int, n_segments int, input_ids binary, position_ids binary, "
    "cu_seqlens array<int>, doc_ids array<bigint>, piece array<int>"
)


class Capacities:
    """Open packs by the room left in them, with a segment tree that finds the tightest fit."""

    def __init__(self, most: int) -> None:
        self.leaf = 1
        while self.leaf < most + 1:
            self.leaf *= 2
        self.count = [0] * (2 * self.leaf)
        self.packs: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, pack: int) -> None:
        self.packs[room].append(pack)
        i = self.leaf + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, pack) of the open pack with the least room of ``need`` or more."""
        i = self.leaf + need
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaf:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaf
        pack = self.packs[room].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, pack


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``sizes`` (each from 1 to ``capacity``) by pack."""
    packs: list[list[int]] = []
    open_packs = Capacities(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = open_packs.take(sizes[i])
        room, pack = found if found else (capacity, len(packs))
        if not found:
            packs.append([])
        packs[pack].append(i)
        if room > sizes[i]:
            open_packs.put(room - sizes[i], pack)
    return packs


def read_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast variable; refused beyond VOCABULARY_BYTES."""
    raw = Path(path).read_bytes()
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has {len(raw)} bytes; {VOCABULARY_BYTES} is the most that is sent to tasks")
    return spark.sparkContext.broadcast(raw)


def encoder(raw: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, sequence: int = SEQUENCE, pattern: str = PATTERN) -> DataFrame:
    """One row per packed sequence, see PACK_SCHEMA.

    ``input_ids`` and ``position_ids`` are little-endian rows of a matrix with
    ``sequence`` columns (uint16, or uint32 for larger vocabularies or
    sequences); positions start at 0 in each segment.  ``cu_seqlens`` are the
    segments' cumulative lengths.  Each document ends with the id after the
    vocabulary's last, which also fills the rest of a sequence.  A document
    longer than a sequence is cut into pieces, numbered by ``piece``: its full
    pieces fill sequences of their own and nothing is lost.  NULL and empty
    texts have no tokens and are in no pack.  Repeated rows are packed again.

    Tokens never leave the task that made them: rounds of ROUND_TOKENS tokens
    are packed within a partition, so memory is bounded, there is no shuffle,
    and a task that is run again gives the same packs.
    """
    bounded_batches(docs.sparkSession)
    if sequence < 2:
        raise ValueError("a sequence has two ids at least")
    shared = read_vocabulary(docs.sparkSession, vocabulary)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value, pattern)
        end = coder.n_vocab
        id_type = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")
        place_type = np.dtype("<u2") if sequence <= 1 << 16 else np.dtype("<u4")
        context = TaskContext.get()
        shard = context.partitionId() if context else 0
        held: list[tuple[int | None, int, np.ndarray]] = []
        count = serial = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, count, serial
            packs = best_fit_decreasing([len(ids) for _, _, ids in held], sequence)
            for at in range(0, len(packs), 256):
                rows = []
                for pack in packs[at:at + 256]:
                    parts = [held[i] for i in pack]
                    ids = np.full(sequence, end, id_type)
                    places = np.zeros(sequence, place_type)
                    bounds = np.cumsum([0, *(len(x) for _, _, x in parts)])
                    for (_, _, x), s in zip(parts, bounds):
                        ids[s:s + len(x)] = x
                        places[s:s + len(x)] = np.arange(len(x))
                    rows.append((shard, serial, int(bounds[-1]), len(parts), ids.tobytes(), places.tobytes(), bounds.tolist(), [d for d, _, _ in parts], [p for _, p, _ in parts]))
                    serial += 1
                types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
                names = [c.split()[0] for c in PACK_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)
            held, count = [], 0

        for doc_ids, texts in batches(it, "doc_id", "text"):
            for doc_id, text in zip(doc_ids, texts):
                if not text:
                    continue
                ids = np.array([*coder.encode_ordinary(text), end], id_type)
                for piece, at in enumerate(range(0, len(ids), sequence)):
                    held.append((doc_id, piece, ids[at:at + sequence]))
                    count += len(held[-1][2])
                    if count >= ROUND_TOKENS:
                        yield from flush()
        if held:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, PACK_SCHEMA)


def write_packs(packs: DataFrame, path: str) -> None:
    """Write packs as Parquet; any reader of binary columns gets the matrices."""
    packs.write.mode("overwrite").parquet(path)
