import hashlib
import re

import pytest

from riskloom.llm import decontaminate as D


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, window=10):
    w, hit, met = words_of(text), set(), set()
    for item, t in items:
        v = words_of(t)
        n = min(len(v), window)
        grams = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if grams and tuple(w[i:i + n]) in grams:
                hit.update(range(i, i + n))
                met.add(str(item))
    return len(w), len(hit), sorted(met)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, ""), (4, None), (5, "Short, item!"), (30, "a b a b a b a b a b a b a"), (6, "solo")]
TEXTS = [
    "zero one two three four five six seven eight nine ten eleven zero", "a short item here", "short items", "a b a b a b a b a b a b", "b a b a b a b a b a", "SOLO", "", None,
    "one two three four five six seven eight nine", "two three four five six seven eight nine ten eleven short item solo", "é ünï short\x00item", "one " * 3000 + "two",
]


def check(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, items string")
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, doc_id string")
    for r in D.contamination(docs, bench).collect():
        n, hit, met = plain(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r["items"]) == (n, hit, len(met), met), texts[r.doc_id]
        assert r.items_sha256 == hashlib.sha256(",".join(met).encode()).hexdigest() and r.contaminated == (hit > 0)


def test_matches_the_definition(spark):
    check(spark, TEXTS, ITEMS)


@pytest.mark.parametrize("shard", [8, 40])
def test_several_automata_give_the_same(spark, monkeypatch, shard):
    monkeypatch.setattr(D, "SHARD_WORDS", shard)
    check(spark, TEXTS, ITEMS)


def test_random_words_against_the_definition():
    import random
    rng = random.Random(6)
    for _ in range(200):
        items = [(str(i), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 16)))) for i in range(4)]
        text = " ".join(rng.choice("abc" if rng.random() < 0.05 else "ab") for _ in range(rng.randint(0, 60)))
        a = D.Automaton().build([(i, t.encode().split()) for i, t in items])
        n, spans, met, _ = a.scan(text.encode())
        assert (n, sum(e - s for s, e in spans), sorted(met)) == plain(text, items)


def test_decontaminate_cuts_the_spans(spark):
    clean = "Nothing to see, here!\n At  all."
    docs = spark.createDataFrame(
        [(1, clean, 31, "k"), (2, "Before: " + ITEMS[0][1] + "; and then so much more text follows this that it stays below half", 1, "k"), (3, "short item", 10, "k"), (4, None, None, "k"), (5, "", 0, None)],
        "doc_id bigint, text string, n_chars bigint, items string")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = {r.doc_id: r for r in D.decontaminate(docs, bench).collect()}
    assert set(got) == {1, 2, 4, 5} and got[1].text == clean and got[4].text is None
    assert got[2].text == "Before: ; and then so much more text follows this that it stays below half" and got[2].n_chars == len(got[2].text)


def test_odd_and_empty_tables(spark, odd, none):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    empty = bench.limit(0)
    rows = odd.collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit) for r in D.contamination(odd, bench).collect())
    assert got == sorted((str(r.doc_id), *plain(r.text, ITEMS)[:2]) for r in rows)
    assert D.contamination(none, bench).count() == 0
    assert D.contamination(odd, empty).where("contaminated").count() == 0
    out = D.decontaminate(odd, empty)
    assert out.columns == odd.columns and out.count() == len(rows)
