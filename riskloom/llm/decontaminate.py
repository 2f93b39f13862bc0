"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.text import bounded_batches, word_blocks
from riskloom.session import materialise

WINDOW = 10
#: Item words per automaton.  More words make more automata, each passed over the documents in turn.
SHARD_WORDS = 200_000

#: Lower-cases A-Z and turns every ASCII byte other than letters and digits into a space.
NORMAL = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
_WORD = re.compile(rb"[^ ]+")


class Automaton:
    """Suffix automaton of several word sequences.

    States keep the longest string, the suffix link and the transitions.  After
    ``finish``: ``least[state]`` is the shortest match length that says
    something there, ``full[state]`` the items having the window of WINDOW words
    that ends the match, ``short[state]`` the short items ending the match.
    """

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.size, self.link, self.next = [0], [-1], [{}]
        self.vocabulary: dict[bytes, int] = {}

    def _state(self, size: int, link: int, moves: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(moves)
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
        return new

    def build(self, items: list[tuple[str, list[bytes]]]) -> Automaton:
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items]
        for _, word_ids in coded:
            last = 0
            for c in word_ids:
                last = self._extend(last, c)
        n, window = len(self.size), self.window
        self.at_window = [-1] * n  # the state whose strings include the last ``window`` words of the match
        for v in sorted(range(1, n), key=self.size.__getitem__):
            if self.size[v] >= window:
                self.at_window[v] = v if self.size[self.link[v]] < window else self.at_window[self.link[v]]
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, word_ids in coded:
            state = 0
            for i, c in enumerate(word_ids):
                state = self.next[state][c]
                if i + 1 >= window:
                    self.full.setdefault(self.at_window[state], set()).add(item)
            if 0 < len(word_ids) < window:
                self.short.setdefault(state, []).append((len(word_ids), item))
        self.least = [window] * n
        for v in sorted(range(1, n), key=self.size.__getitem__):
            own = min((m for m, _ in self.short.get(v, ())), default=window)
            self.least[v] = min(own, self.least[self.link[v]] if self.link[v] > 0 else window)
        return self

    def scan(self, raw: bytes | None) -> tuple[int, list[list[int]], set[str], int]:
        """(words, merged hit spans of word positions, items met, longest match) of one text."""
        spans: list[list[int]] = []
        items: set[str] = set()
        size, link, moves, least = self.size, self.link, self.next, self.least
        code = self.vocabulary.get
        state = length = longest = i = 0
        for words in word_blocks((raw or b"").translate(NORMAL)):
            for w in words:
                c = code(w)
                if c is None:
                    state = length = 0
                else:
                    step = moves[state].get(c)
                    while step is None and state:
                        state = link[state]
                        length = size[state]
                        step = moves[state].get(c)
                    if step is None:
                        length = 0
                    else:
                        state = step
                        length += 1
                        if length > longest:
                            longest = length
                        if length >= least[state]:
                            self._record(state, length, i, spans, items)
                i += 1
        return i, merge(spans), items, longest

    def _record(self, state: int, length: int, i: int, spans: list[list[int]], items: set[str]) -> None:
        start = i + 1
        if length >= self.window:
            start = i + 1 - self.window
            items |= self.full[self.at_window[state]]
        u = state
        while u > 0:
            for m, item in self.short.get(u, ()):
                if m <= length:
                    start = min(start, i + 1 - m)
                    items.add(item)
            u = self.link[u]
        if start > i:
            return
        if spans and start <= spans[-1][1]:
            spans[-1] = [min(start, spans[-1][0]), i + 1]
        else:
            spans.append([start, i + 1])


def merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


def item_shards(benchmark: DataFrame, window: int = WINDOW) -> Iterator[list[tuple[str, bytes]]]:
    """Items in lists of about SHARD_WORDS words; longer items come in pieces that overlap by a window less one word."""
    step = SHARD_WORDS // 4

    def pieces(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[tuple[str, bytes, int]] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or b"").translate(NORMAL).split()
                for at in range(0, max(1, len(words) - window + 1), step):
                    part = words[at:at + step + window - 1]
                    if part:
                        out.append((item or "", b" ".join(part), len(part)))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], ["item", "words", "n"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    parts = materialise(rows.mapInArrow(pieces, "item string, words binary, n bigint"), "items")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // SHARD_WORDS))
    for s in range(shards):
        one = parts.where(F.pmod(F.xxhash64("item", "words"), F.lit(shards)) == s)
        yield [(r["item"], bytes(r["words"])) for r in one.select("item", "words").collect()]


#: Columns that carry the matches beside the columns of the documents.
FOUND = {"__dc_words": pa.int64(), "__dc_from": pa.list_(pa.int32()), "__dc_to": pa.list_(pa.int32()), "__dc_items": pa.list_(pa.string()), "__dc_longest": pa.int32()}


_INTS, _STRINGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
_ADDED = [T.StructField(n, t) for n, t in zip(FOUND, [T.LongType(), _INTS, _INTS, _STRINGS, T.IntegerType()])]


def with_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """``docs`` with the columns of FOUND: hit word spans, items met and the longest match of each whole text.

    One pass over the texts per automaton, without a shuffle; a benchmark up to
    SHARD_WORDS words needs one.  A later pass adds to what earlier ones found.
    ``finish`` turns the batches of the last pass into rows with the columns of ``docs``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shards = list(item_shards(benchmark, window))
    out = docs
    for at, shard in enumerate(shards):
        shared = spark.sparkContext.broadcast(shard)
        last = finish if at == len(shards) - 1 else None

        def run(it: Iterable[pa.RecordBatch], shared=shared, first=at == 0, last=last) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(window).build([(item, words.split()) for item, words in shared.value])
            for batch in it:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                old = [None] * len(texts) if first else list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in FOUND)))
                rows = []
                for text, before in zip(texts, old):
                    n, spans, items, longest = automaton.scan(None if text is None else text.encode("utf-8", "surrogatepass"))
                    if before:
                        spans = merge(spans + [list(x) for x in zip(before[1], before[2])])
                        items |= set(before[3])
                        longest = max(longest, before[4])
                    rows.append((n, [s for s, _ in spans], [e for _, e in spans], sorted(items), longest))
                kept = [c for c in batch.schema.names if c not in FOUND]
                cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                new = list(zip(*rows)) or [()] * len(FOUND)
                done = pa.RecordBatch.from_arrays(cols + [pa.array(v, t) for v, t in zip(new, FOUND.values())], kept + list(FOUND))
                yield last(done) if last else done

        if at:
            out = materialise(out, "matches")
        out = out.mapInArrow(run, docs.schema if last else T.StructType(docs.schema.fields + _ADDED))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, hit_from, hit_to, items.

    A NULL or empty text has no words and is clean; so is every document of an
    empty benchmark.  Items without words are ignored, equal items all count.
    Repeated rows are judged one by one.
    """
    found = with_matches(docs.select("doc_id", "text"), benchmark, window).drop("text")
    width = F.aggregate(F.zip_with("__dc_from", "__dc_to", lambda a, b: (b - a).cast("bigint")), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    ids = F.array_sort("__dc_items")
    return found.select(
        "doc_id", F.col("__dc_words").alias("n_words"), width.alias("n_hit"), F.size("__dc_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("__dc_from") > 0).alias("contaminated"),
        F.col("__dc_longest").alias("longest_match"), F.col("__dc_from").alias("hit_from"), F.col("__dc_to").alias("hit_to"), ids.alias("items"),
    )


def cut(text: str, starts: list[int], ends: list[int]) -> str:
    """``text`` without the words from each start up to its end, separators inside included."""
    raw = text.encode("utf-8", "surrogatepass")
    keep, at, spans = [], 0, iter(zip(starts, ends))
    span = next(spans)
    for i, m in enumerate(_WORD.finditer(raw.translate(NORMAL))):
        if i == span[0]:
            keep.append(raw[at:m.start()])
        if i == span[1] - 1:
            at = m.end()
            span = next(spans, None)
            if span is None:
                break
    keep.append(raw[at:])
    return b"".join(keep).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without the matched spans; documents hit in more than ``max_coverage`` of their words go.

    Clean documents pass unchanged, NULL texts included.  ``n_chars`` follows a
    changed text where that column exists.
    """
    names = docs.columns

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
        texts = col["text"]
        keep, changed = [], {}
        for i, (n, starts, ends) in enumerate(zip(*(col[c].to_pylist() for c in ("__dc_words", "__dc_from", "__dc_to")))):
            hit = sum(ends) - sum(starts)
            if hit > max_coverage * n:
                continue
            if hit:
                changed[i] = cut(texts[i].as_py(), starts, ends)
            keep.append(i)
        cols = {c: col[c] for c in names}
        if changed:
            cols["text"] = pa.array([changed[i] if i in changed else t for i, t in enumerate(texts.to_pylist())], texts.type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(col["n_chars"].to_pylist())], col["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols)).take(pa.array(keep, pa.int32()))

    return with_matches(docs, benchmark, window, apply)
