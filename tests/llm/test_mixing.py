import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.llm import mixing as M


def plain_exponent(tokens, target, repetition, budget):
    total = sum(tokens)
    s = [t / total for t in tokens]

    def more(a):
        z = sum(x ** a for x in s)
        p = [x ** a / z for x in s]
        return -sum(x * math.log(x) for x in p) >= target * math.log(len(s)) or max(budget * x / y for x, y in zip(p, s)) > repetition

    if more(1.0):
        return 1.0
    low, high = 0.0, 1.0
    if not more(0.0):
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if more(mid) else (low, mid)
    return low


def plain_copies(rows, alpha, budget, seed=M.SEED):
    """Copies of (doc_id, source, n) by sorting each source's keys."""
    total = Counter()
    for _, s, n in rows:
        if n:
            total[s] += n
    everything = sum(total.values())
    power = {s: (t / everything) ** alpha for s, t in total.items()}
    z = sum(power.values())
    out = []
    for i, s, n in rows:
        if not n:
            out.append((i, 1))
            continue
        want = math.floor(power[s] / z * budget * everything + 0.5)
        passes, rest = divmod(want, total[s])
        key = lambda d: hashlib.md5(f"{seed}|{'' if d is None else d}".encode()).hexdigest()
        upto = sum(m for d, t, m in rows if t == s and key(d) <= key(i))
        out.append((i, passes + (upto <= rest)))
    return out


@pytest.mark.parametrize("targets", [{}, {"target_entropy": 1.0}, {"target_entropy": 0.99, "max_repetition": 1.5}, {"budget": 2.5, "max_repetition": 3.0}, {"target_entropy": 0.0}])
def test_copies_of_skewed_sources(spark, monkeypatch, targets):
    monkeypatch.setattr(M, "BLOCK_DOCS", 3)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}" if i % 5 else None, "w " * (i % 11) + ("x" * 9)) for i in range(300)] + [(400, "tiny", "one"), (401, "blank", ""), (402, "hot", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, source string, text string, weight int")
    counted = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows]
    total = Counter()
    for _, s, n in counted:
        if n:
            total[s] += n
    goals = {"target_entropy": M.TARGET_ENTROPY, "max_repetition": M.MAX_REPETITION, "budget": M.BUDGET} | targets
    want = plain_exponent(list(total.values()), goals["target_entropy"], goals["max_repetition"], goals["budget"])
    mix = M.mixture(docs, **targets)
    assert abs(mix.alpha - want) < 1e-8
    assert abs(mix.plan.agg(F.sum("weight")).first()[0] - 1) < 1e-9
    got = M.copies(docs, **targets).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted(plain_copies(counted, mix.alpha, goals["budget"]))
    for r in mix.plan.collect():  # budgets are met to within one document
        used = sum(g.n_tokens * g.copies for g in got if g.source == r.source)
        assert -20 <= used - r.weight * goals["budget"] * sum(total.values()) <= 1
    out = M.mix(docs, **targets)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_odd_and_empty_tables(spark, odd, none):
    got = M.copies(odd).collect()
    assert len(got) == odd.count() and all(r.copies == 1 for r in got if not r.n_tokens)
    assert M.mix(odd).columns == odd.columns and M.mix(odd).count() == sum(r.copies for r in got)
    assert M.copies(none).count() == 0 and M.mix(none).count() == 0
    blank = spark.createDataFrame([(1, "s", None), (2, None, " ")], "doc_id bigint, source string, text string")
    assert [r.copies for r in M.copies(blank).collect()] == [1, 1]
