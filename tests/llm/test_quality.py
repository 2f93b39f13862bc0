import random

import numpy as np
import pytest

from riskloom.llm import quality as Q


def test_score_equals_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    width = Q.BUCKETS + len(Q.STATISTICS)
    m = Q.Machine(0.3, rng.normal(0, 0.1, width), rng.normal(0, 0.1, (width, Q.FACTORS)), np.zeros(len(Q.STATISTICS)), np.ones(len(Q.STATISTICS)))
    index, value, stats = Q.extract(b"some words and Some more words, with | marks%%% and 12 digits")
    at = np.concatenate([index, Q.BUCKETS + np.arange(len(stats))])
    x = np.concatenate([value, np.clip(stats, -4, 4)])
    z = m.bias + sum(m.linear[i] * v for i, v in zip(at, x))
    z += sum(m.factors[at[a]] @ m.factors[at[b]] * x[a] * x[b] for a in range(len(at)) for b in range(a))
    assert abs(m.score(index, value, stats) - 1 / (1 + np.exp(-z))) < 1e-12


def test_blocks_do_not_change_features(monkeypatch):
    raw = " ".join(f"w{i % 31} w{i % 31}" for i in range(500)).encode()
    whole = Q.extract(raw)
    real = Q.word_blocks
    monkeypatch.setattr(Q, "word_blocks", lambda r: real(r, 40))
    assert all(np.allclose(a, b) for a, b in zip(whole, Q.extract(raw)))


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        poor = i % 4 == 0
        if poor:
            w = [x + rng.choice(["%%%", "$$$"]) for x in w] if i % 8 else [x for x in w[:9] for _ in range(8)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not poor), 0))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(made):
    docs, labels = made
    rows = Q.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r.predicted == r.quality for r in rows) >= 0.98 * len(rows)
    again = {r.doc_id: r.score for r in Q.quality(docs.repartition(5), labels.repartition(3)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in rows)


def test_odd_and_empty_tables(odd, none, no_labels, odd_labels):
    for labels in (no_labels, odd_labels):
        got = Q.quality(odd, labels).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert Q.quality(none, odd_labels).count() == 0
