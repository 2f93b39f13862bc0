import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import suffix_dedup as S


def plain(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i:i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        change = np.zeros(len(x) + 1, int)
        for i in range(len(x) - length + 1):
            if count[x[i:i + length]] > 1:
                change[i] += 1
                change[i + length] -= 1
        gone = np.cumsum(change)[:-1] > 0
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id bigint, text string, key int, mark string").repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.suffix_dedup(docs).collect())
    assert got == sorted((str(d), *p) for (d, _), p in zip(rows, plain([t for _, t in rows])))


def made(seed, alphabet="abcdefgh é\n"):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [word(rng.choice([60, 150, 199, 200, 201, 260, 500])) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [word(rng.randint(0, 200)) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[3][1]), (101, "z" * 450), (102, "z" * 199), (103, word(1) * 200), (104, None), (105, ""), (106, shared[6][5:] + "q"), (107, "xy" * 150)]
    return rows


@pytest.mark.parametrize("seed, alphabet", [(1, "abcdefgh é\n"), (2, "ab"), (3, "a")])
def test_removal_equals_brute_force(spark, seed, alphabet):
    check(spark, made(seed, alphabet))


def test_crowded_keys_are_counted_window_by_window(spark, monkeypatch):
    monkeypatch.setattr(S, "KEY_BYTES", 900)
    monkeypatch.setattr(S, "MERGE_BYTES", 500)
    check(spark, made(4) + [(200 + i, f"{i} " * 60 + made(4)[7][1]) for i in range(12)])


def test_pieces_of_a_long_text_and_small_slices(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE_BYTES", 300)
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    check(spark, [(1, long + long[1000:1400]), (2, long[3000:3800]), (3, "tail" + long[5500:])] + made(6)[:20])


@pytest.mark.parametrize("shard", [250, 1000, 1 << 18])
def test_merged_transforms_equal_counting(shard):
    rng = random.Random(shard)
    base = [bytes(rng.choice(b"ab") for _ in range(320)) for _ in range(3)]
    for _ in range(15):
        parts, counts = [], []
        for _ in range(rng.randint(2, 12)):
            c = rng.randint(1, 60)
            b, o = rng.choice(base), rng.randint(0, 20)
            t = bytearray((b[o:] + b)[:c + 199])
            if rng.random() < 0.7:
                t[rng.randrange(len(t))] = 99
            parts.append(bytes(t))
            counts.append(c)
        seen = Counter(p[i:i + 200] for p, c in zip(parts, counts) for i in range(c))
        want = [seen[p[i:i + 200]] > 1 for p, c in zip(parts, counts) for i in range(c)]
        got = S.repeated_starts(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), np.array(counts), shard_bytes=shard)
        assert got.tolist() == want


def test_odd_and_empty_tables(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.where("doc_id is null or doc_id not in (6, 10)").collect()]
    check(spark, rows)
    long = {r.doc_id: r for r in S.suffix_dedup(odd).where("doc_id in (6, 10)").collect()}
    assert long[6].n_bytes == long[6].n_removed and long[10].n_spans == 1 and long[10].n_removed == 300_000
    assert S.suffix_dedup(none).count() == 0
