import random
import re
from collections import defaultdict

import numpy as np
import pytest

from riskloom.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def plain(rows, num=90, den=100):
    """All pairs of different sets, by an inverted list, and chains of links."""
    sets = [shingles(t) for _, t in rows]
    index = defaultdict(set)
    parent = {s: s for s in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for s in parent:
        for g in s:
            index[g].add(s)
    for s in parent:
        for u in set().union(*(index[g] for g in s)) if s else ():
            if den * len(s & u) >= num * len(s | u):
                parent[find(s)] = find(u)
    least = {}
    for (i, _), s in zip(rows, sets):
        r = find(s)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted(((i, len(s), least[find(s)] if s else i) for (i, _), s in zip(rows, sets)), key=str)


def got(docs, **at):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(docs, **at).collect()), key=str)


def copies(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(w))
        if kind == 0:
            w[at] = f"e{rng.randrange(10**6)}"
        elif kind == 1:
            w.insert(at, f"e{rng.randrange(10**6)}")
        elif len(w) > 1:
            del w[at]
    return w


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for size in (1, 2, 3, 5, 11, 12, 19, 20, 30, 57, 58, 110, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        texts += [" ".join(copies(rng, base, rng.randrange(1 + max(1, size // 15)))) for _ in range(14)]
    dense = [f"w{rng.randrange(10**6)}" for _ in range(80)]  # a group of copies of which only some link
    texts += [" ".join(copies(rng, dense, rng.randrange(9))) for _ in range(70)]
    texts += ["common line of a licence text " + " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(4, 30))) for _ in range(60)]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("crowd, cost, block, num", [(16, 1.0, 1 << 17, 90), (3, 1e6, 700, 90), (2, 1e6, 1 << 17, 80), (10**9, 0.0, 500, 97)])
def test_equals_all_pairs(spark, monkeypatch, crowd, cost, block, num):
    """Also with crowded keys from three sets on, forced one-deletion neighbourhoods and groups of many blocks."""
    monkeypatch.setattr(J, "CROWD", crowd)
    monkeypatch.setattr(J, "PAIR_COST", cost)
    monkeypatch.setattr(J, "BLOCK_TOKENS", block)
    used = []
    real = J.neighbourhoods
    monkeypatch.setattr(J, "neighbourhoods", lambda *a: used.append(a[-1]) or real(*a))
    rows = corpus(num)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert got(docs, numerator=num) == plain(rows, num)
    assert bool(used) == (cost > 1)


def test_a_crowded_key_does_not_make_unlike_sets_meet_by_their_tokens(spark, monkeypatch):
    """All sets stand under one key, as those with an empty segment do; whose sketches differ is not read again."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 90)))) for i in range(80)]
    rows += [(100 + i, " ".join(copies(rng, base, 1))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    both = lambda docs, found, bands, salt: found.select(J.F.lit(1).alias("key"), "node", J.F.explode("bands.band").alias("band"), J.F.lit(True).alias("own"), J.F.lit(len(rows)).alias("c"))
    monkeypatch.setattr(J, "candidates", both)
    monkeypatch.setattr(J, "BLOCK_TOKENS", 500)
    read = []
    real = J.materialise
    monkeypatch.setattr(J, "materialise", lambda df, label: read.append(df.count()) or real(df, label) if label == "ids" else real(df, label))
    assert got(docs) == plain(rows)
    assert read == [6]


def test_table_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("num", [80, 90, 95])
def test_linked_sizes_share_a_band_with_enough_segments(num):
    bands = J.Bands(num, 100)
    for s in range(1, 700):
        for r in range(-(-num * s // 100), s + 1):
            shared = set(bands.joined(r)) & set(bands.joined(s))
            assert shared and all(bands.segments(b) >= min(bands.shown(r), bands.segments(b)) > bands.differ(r + s) for b in shared)
            assert bands.shown(s) > bands.differ(r + s)


def test_deletions_meet_where_one_token_differs():
    rng = np.random.default_rng(1)
    t = np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64))
    chosen = np.arange(4)
    sig = lambda x: J.deletions(x, 5, 4, chosen)
    a, own_a, _ = sig(t)
    for i in range(len(t)):
        b, own_b, _ = sig(np.delete(t, i))
        at = int(J.split(t[i:i + 1], 5, 4)[0])
        assert set(b[own_b].tolist()) <= set(a.tolist()) and b[own_b][at] in a[~own_a]


def test_blocks_do_not_change_tokens(monkeypatch):
    raw = " ".join(f"w{i % 97}" for i in range(3000)).encode()
    whole = J.tokens(raw)
    real = J.word_blocks
    monkeypatch.setattr(J, "word_blocks", lambda r: real(r, 50))
    assert np.array_equal(J.tokens(raw), whole) and len(whole) == 97


def test_equal_names_of_different_sets_are_noticed(spark, monkeypatch):
    real = J.tokens
    seen = []
    monkeypatch.setattr(J, "index", lambda docs, bands, salt, f=J.index: seen.append(salt) or f(docs, bands, salt).withColumn("node", J.F.when(J.F.lit(salt == 0) & J.F.col("node").isNotNull(), 1).otherwise(J.F.col("node"))))
    rows = [(1, "a b c d"), (2, "x y z"), (3, "a b c d")]
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == plain(rows) and seen == [0, 1] and real


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert got(odd) == plain(rows)
    assert J.near_duplicates(none).count() == 0
    assert J.near_duplicates(odd).columns == ["doc_id", "n_shingles", "component_id"]
