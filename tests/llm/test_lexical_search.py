import math
import random
import re
from collections import Counter

import pytest

from riskloom.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top=10):
    """Every item against every document."""
    words = [(i, terms(t)) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    N, L = len(words), sum(len(w) for _, w in words)
    found = [(i, len(w), Counter(w)) for i, w in words]
    df = Counter(t for _, _, c in found for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, query in wanted.items():
        scores = []
        for doc, n, c in found:
            m, score = 10 + 90 * n * N // L, 0
            for t in query & c.keys():
                score += math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r, None if no else doc, -s) for r, (s, no, doc) in enumerate(sorted(scores)[:top], 1)]
    return out


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("block, step", [(100_000, 32 << 20), (40, 2_000)])
def test_equals_every_item_against_every_document(spark, monkeypatch, block, step):
    """Also in several blocks of items and small steps."""
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical_search, "STEP_BYTES", step)
    rng = random.Random(4)
    word = lambda: f"w{int(rng.expovariate(0.06))}"
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(150)]
    docs += [(900 + i, docs[i][1].upper()) for i in range(20)]  # ties
    common = " ".join(word() for _ in range(8))
    items = [(i, common + ", " + " ".join(word() for _ in range(rng.randint(1, 20)))) for i in range(25)]
    got = rows(lexical_search.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")))
    assert got == sorted(plain_search(docs, items), key=str)


def test_the_dag_adds_up_to_each_item_and_shares():
    rng = random.Random(2)
    sets = [rng.sample(range(100, 130), 9) for _ in range(5)]
    items = [sorted(set(sets[i % 5]) | set(rng.sample(range(100), 12))) for i in range(60)]
    nodes, parts = lexical_search.sharing_dag(items, 130)

    def leaves(x):
        return [x] if x < 130 else leaves(nodes[x - 130][0]) + leaves(nodes[x - 130][1])

    assert [sorted(t for p in own for t in leaves(p)) for own in parts] == items
    assert len(nodes) + sum(len(p) - 1 for p in parts) < 0.6 * sum(len(t) - 1 for t in items)
    assert lexical_search.sharing_dag([], 0) == ([], []) and lexical_search.sharing_dag([[], [0]], 1) == ([], [[], [0]])


def test_blocks_of_a_long_text_do_not_change_its_counts(monkeypatch):
    raw = " ".join(f"W{i % 89}-é{i % 7}" for i in range(3000)).encode()
    wanted = {b"w5": 0, "é3".encode(): 1, b"none": 2}
    whole = lexical_search.term_counts(raw, wanted)
    real = lexical_search.word_blocks
    monkeypatch.setattr(lexical_search, "word_blocks", lambda r: real(r, 50))
    assert lexical_search.term_counts(raw, wanted) == whole == (6000, {0: 34, 1: 429})


def test_odd_rows(spark, odd, none):
    kind = "text string, item_id bigint, doc_id string, score int"
    asked = [("quick FOX word", 1, "x", 1), (None, 2, None, None), ("", 3, "", 0), ("lorem", None, "y", 2), ("the river", 5, "a", 1), ("bank", 5, "b", 1), ("quick FOX word", 1, "x", 1), (" ... ", 6, "", 0)]
    items = spark.createDataFrame(asked, kind)
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows(lexical_search.search(odd, items)) == sorted(plain_search(docs, [(r[1], r[0]) for r in asked]), key=str)
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(odd, items.limit(0)).count() == 0
    assert lexical_search.search(odd, items).columns == ["item_id", "rank", "doc_id", "score"]
