"""Toxicity from a learnt lexicon, misspellings and quotation context."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.decontaminate import NORMAL
from riskloom.llm.labels import labelled_sample, remainder
from riskloom.llm.text import bounded_batches, word_blocks
from riskloom.session import materialise

#: Labelled documents learnt from, at most.
TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
#: A term must be this unlikely (natural log) to stand so often in toxic documents by chance.
EVIDENCE = 14.0
FOLDS = 5

#: Words each side of a term in which a cue verb and a straight mark make it quoted.
CONTEXT = 8
#: Marks and verbs that introduce somebody else's words.
OPENERS = ["“", "„", "«"]
CLOSERS = ["”", "“", "»"]
CUES = ["said", "says", "wrote", "called", "quote", "quoted", "reported", "sagte", "schrieb", "nannte", "zitat", "dit", "cita", "dijo", "escribió"]

#: Prior means of the score's coefficients: bias, plain, misspelt and quoted hits (log counts), hits per 100 words.
PRIOR = (-4.0, 5.0, 4.0, 1.0, 0.5)


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 6 else 1 if len(term) < 11 else 2


class Misspellings:
    """Levenshtein automata of all terms intersected with their trie, determinised as words are read.

    A state maps trie nodes to the least number of edits spent.  Characters
    outside the lexicon's alphabet are one symbol, so states are finite and most
    words die after a few characters.
    """

    def __init__(self, terms: Iterable[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.slack = [0]
        for t in terms:
            node, k = 0, edits_allowed(t)
            self.slack[0] = max(self.slack[0], k)
            for ch in t:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.slack.append(0)
                node = self.children[node][ch]
                self.slack[node] = max(self.slack[node], k)
            self.term[node] = t
        self.alphabet = {ch for c in self.children for ch in c}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.accept: list[tuple[int, str] | None] = []
        self.start = self._state({0: 0})

    def _state(self, spent: dict[int, int]) -> int:
        """Closes over missing characters and interns the state; -1 if nothing is left."""
        todo = list(spent)
        while todo:
            node = todo.pop()
            e = spent[node] + 1
            for child in self.children[node].values():
                if e <= self.slack[child] and e < spent.get(child, 99):
                    spent[child] = e
                    todo.append(child)
        key = tuple(sorted(spent.items()))
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] is not None and e <= edits_allowed(self.term[n])]
            self.accept.append(min(ends, default=None))
        return self.ids[key]

    def _step(self, state: int, ch: str) -> int:
        spent: dict[int, int] = {}
        for node, e in self.states[state]:
            same = self.children[node].get(ch)
            if same is not None:
                spent[same] = min(e, spent.get(same, 99))
            if e + 1 <= self.slack[node]:
                spent[node] = min(e + 1, spent.get(node, 99))
            for child in self.children[node].values():
                if e + 1 <= self.slack[child]:
                    spent[child] = min(e + 1, spent.get(child, 99))
        return self._state(spent)

    def find(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the closest term, or None."""
        state = self.start
        for ch in word:
            if ch not in self.alphabet:
                ch = ""
            moves = self.moves[state]
            nxt = moves.get(ch)
            if nxt is None:
                nxt = moves[ch] = self._step(state, ch)
            if nxt < 0:
                return None
            state = nxt
        return self.accept[state]


@dataclass
class Model:
    """What scoring needs; all of it comes from the bounded sample of labelled rows, which bounds its size."""

    terms: list[str] = field(default_factory=list)
    benign: list[str] = field(default_factory=list)
    coefficients: tuple[float, ...] = PRIOR


_MARK = re.compile("|".join(map(re.escape, ["\n", '"', *dict.fromkeys(OPENERS + CLOSERS)])).encode())


def quotations(raw: bytes) -> Iterator[tuple[int, int]]:
    """Byte ranges inside quotation marks, ascending, from one pass over the whole text.

    Typographic marks may span lines; straight ones pair up within a
    line, opened after a space or bracket and closed after anything else.  A
    line that begins with ``>`` is quoted whole.  Marks that stay open quote nothing.
    """
    openers, closers = {c.encode() for c in OPENERS}, {c.encode() for c in CLOSERS}
    found: list[tuple[int, int]] = []
    opened = straight = -1
    line = 0
    for m in _MARK.finditer(raw):
        mark, at = m[0], m.start()
        if mark == b"\n":
            if raw[line:at].lstrip(b" \t").startswith(b">"):
                found.append((line, at))
            line, straight = at + 1, -1
        elif mark == b'"':
            after_word = at > line and raw[at - 1:at] not in b" \t([{"
            if straight < 0 and not after_word:
                straight = at
            elif straight >= 0 and after_word:
                found.append((straight, at))
                straight = -1
        elif opened >= 0 and mark in closers:
            found.append((opened, at))
            opened = -1
        elif mark in openers:
            opened = at
    if raw[line:].lstrip(b" \t").startswith(b">"):
        found.append((line, len(raw)))
    return iter(sorted(found))


def words_near(flat: bytes, start: int, end: int, most: int) -> tuple[int, int]:
    """Where the ``most`` words before a word begin and those after it end, wherever they stand."""
    low, reach = start, 256
    while low and len(flat[low:start].split()) <= most:
        low = max(0, start - reach)
        reach *= 2
    parts = list(re.finditer(rb"[^ ]+", flat[low:start]))
    low = low + parts[-most].start() if len(parts) >= most else 0
    high, reach = end, 256
    while high < len(flat) and len(flat[end:high].split()) <= most:
        high = min(len(flat), end + reach)
        reach *= 2
    parts = list(re.finditer(rb"[^ ]+", flat[end:high]))
    high = end + parts[most - 1].end() if len(parts) >= most else len(flat)
    return low, high


class Scorer:
    """Counts of plain, misspelt and quoted hits of a text."""

    CACHE = 100_000

    def __init__(self, model: Model) -> None:
        self.model = model
        self.near = Misspellings(model.terms)
        self.benign = frozenset(model.benign)
        self.cache: dict[bytes, tuple[int, str] | None] = {}
        self.cues = frozenset(CUES)

    def lookup(self, w: bytes) -> tuple[int, str] | None:
        try:
            return self.cache[w]
        except KeyError:
            pass
        word = w.decode("utf-8", "replace").lower()
        found = self.near.find(word)
        if found and found[0] and word in self.benign:
            found = None
        if len(self.cache) >= self.CACHE:
            self.cache.clear()
        self.cache[w] = found
        return found

    def features(self, text: str | None) -> tuple[int, float, float, float]:
        """(words, plain, misspelt, quoted hits)."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        n, hits = 0, False
        for words in word_blocks(raw.translate(NORMAL)):
            n += len(words)
            if not hits:
                hits = any(self.lookup(w) for w in set(words))
        if not hits:
            return n, 0.0, 0.0, 0.0
        return n, *self.in_context(raw)

    def in_context(self, raw: bytes) -> tuple[float, float, float]:
        """(plain, misspelt, quoted) hits; quotations count over the whole text, cue verbs within CONTEXT words."""
        plain = misspelt = quoted = 0.0
        flat = raw.translate(NORMAL)
        spans = quotations(raw)
        inside: list[int] = []  # ends of the quotations begun so far that may still hold the word
        span = next(spans, None)
        for m in re.finditer(rb"[^ ]+", flat):
            found = self.lookup(m[0])
            if not found:
                continue
            s, e = m.span()
            while span and span[0] <= s:
                inside.append(span[1])
                span = next(spans, None)
            inside = [x for x in inside if x >= e]
            if not inside:
                low, high = words_near(flat, s, e, CONTEXT)
                said = any(w.decode("utf-8", "replace") in self.cues for w in flat[low:s].split())
            if inside or (said and b'"' in raw[low:high]):
                quoted += 1
            elif found[0]:
                misspelt += 1
            else:
                plain += 1
        return plain, misspelt, quoted


def design(rows: np.ndarray) -> np.ndarray:
    """Columns of the score from (words, plain, misspelt, quoted)."""
    n, plain, misspelt, quoted = rows.T
    dense = np.minimum(5.0, 100.0 * (plain + misspelt) / np.maximum(n, 1))
    return np.column_stack([np.ones(len(rows)), np.log1p(plain), np.log1p(misspelt), np.log1p(quoted), dense])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> tuple[float, ...]:
    """Logistic coefficients by Newton steps, drawn towards PRIOR where labels say little."""
    prior = np.array(PRIOR)
    beta = prior.copy()
    for _ in range(30):
        p = sigmoid(x @ beta)
        gradient = x.T @ (p - y) + strength * (beta - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(round(float(b), 9) for b in beta)


def word_contexts(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): distinct contexts (neighbouring words) of each word, copies of a passage counting once."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for text, mark in zip(texts, marks):
                for words in word_blocks((text or b"").translate(NORMAL)):
                    rows = set(zip(words, [b"", *words[:-1]], [*words[1:], b""]))
                    out = [w.decode("utf-8", "replace").lower() for w, _, _ in rows]
                    around = [b"\x00".join((a, b)) for _, a, b in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(around, pa.binary()), pa.array([mark] * len(out), pa.int32())], ["word", "around", "label"])

    rows = sample.select(F.col("text").cast("binary").alias("text"), "__label").mapInArrow(run, "word string, around binary, label int")
    each = rows.select("word", F.xxhash64("around").alias("around"), "label").distinct()
    return each.groupBy("word").agg(F.sum((F.col("label") == 1).cast("bigint")).alias("toxic"), F.sum((F.col("label") == 0).cast("bigint")).alias("clean"))


def learn(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """Lexicon, harmless look-alikes and coefficients from a bounded sample of labelled rows of the learning folds.

    A term stands in toxic documents far more often than chance allows, counted
    by distinct contexts so that copies of one document prove nothing.  Words of
    clean documents within edit reach of a term are harmless look-alikes.
    Without toxic labels the lexicon is empty and the prior alone speaks.
    """
    bounded_batches(docs.sparkSession)
    sample = materialise(labelled_sample(docs, labels, "toxic", remainder(FOLDS) != 0, {1: toxic_rows, 0: clean_rows}), "toxic-sample")
    words = materialise(word_contexts(sample), "toxic-words")
    total = words.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    base = (total["t"] or 0) / max(1, (total["t"] or 0) + (total["c"] or 0))
    if not 0 < base < 1:
        return Model()
    k, c = F.col("toxic"), F.col("clean")
    n = k + c
    surprise = k * F.log(k / (n * base)) + F.when(c > 0, c * F.log(c / (n * (1 - base)))).otherwise(0.0)
    strong = words.where((k >= 4) & (k / n > base) & (k >= 9 * c)).withColumn("evidence", surprise).where(F.col("evidence") >= EVIDENCE)
    terms = sorted(r["word"] for r in strong.select("word").collect())

    def near(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = Misspellings(terms)
        for batch in it:
            keep = [i for i, w in enumerate(batch.column(0).to_pylist()) if (reach.find(w) or (0,))[0]]
            yield batch.take(pa.array(keep, pa.int32()))

    benign = sorted(r["word"] for r in words.where(c > 0).select("word").mapInArrow(near, "word string").collect())
    model = Model(terms, benign)

    def measure(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in it:
            rows = np.array([scorer.features(t) for t in batch.column(0).to_pylist()], float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in rows.T), batch.column(1)], ["n", "plain", "misspelt", "quoted", "label"])

    found = sample.select("text", "__label").mapInArrow(measure, "n double, plain double, misspelt double, quoted double, label int")
    rows = np.array(sorted(tuple(r) for r in found.collect()), float)
    model.coefficients = fit(design(rows[:, :4]), rows[:, 4])
    return model


def scored(docs: DataFrame, model: Model, only_clean: bool = False, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``__tox`` (score) and ``__hits``; or, with ``only_clean``, just the documents under ``threshold``."""
    # Plain values: a broadcast class would have to be importable on the executors.
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.benign, model.coefficients))

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        beta = np.array(scorer.model.coefficients)
        for batch in it:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            rows = np.array([scorer.features(t) for t in texts], float).reshape(-1, 4)
            score = sigmoid(design(rows) @ beta)
            if only_clean:
                yield batch.take(pa.array(np.flatnonzero(score < threshold)))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(rows[:, 1:].sum(axis=1).astype(np.int64))], [*batch.schema.names, "__tox", "__hits"])

    more = [T.StructField("__tox", T.DoubleType()), T.StructField("__hits", T.LongType())]
    return docs.mapInArrow(run, docs.schema if only_clean else T.StructType(docs.schema.fields + more))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_terms) of each whole text.

    NULL and empty texts have no hit and get the score of the bias alone;
    repeated rows are scored one by one; other columns play no part.
    """
    found = scored(docs.select("doc_id", "text"), learn(docs, labels))
    return found.select(
        "doc_id", (remainder(FOLDS) == 0).alias("held_out"), F.col("__tox").alias("score"),
        (F.col("__tox") >= threshold).cast("int").alias("predicted"), F.col("__hits").alias("n_terms"),
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents scored ``threshold`` or more, columns unchanged."""
    return scored(docs, learn(docs, labels), only_clean=True, threshold=threshold)
