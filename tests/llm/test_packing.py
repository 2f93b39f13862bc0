import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from riskloom.llm import packing as P

pytestmark = pytest.mark.skipif(not Path(P.VOCABULARY).exists(), reason="the vocabulary is not here")


def test_best_fit_equals_a_plain_search():
    rng = random.Random(3)
    for _ in range(100):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(0, 120))]
        rooms, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fit = min((r for r in rooms if r >= sizes[i]), default=None)
            if fit is None:
                rooms.append(50 - sizes[i])
            else:
                rooms[rooms.index(fit)] -= sizes[i]
            want.append(fit)
        packs = P.best_fit_decreasing(sizes, 50)
        assert sorted(i for p in packs for i in p) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in p) <= 50 for p in packs) and len(packs) == len(rooms)
        assert sorted(50 - sum(sizes[i] for i in p) for p in packs) == sorted(rooms)


def unpack(packs, sequence):
    parts = defaultdict(list)
    for r in packs:
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == sequence and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= sequence
        assert r.n_segments == len(r.doc_ids) == len(r.piece) == len(r.cu_seqlens) - 1
        for d, p, a, b in zip(r.doc_ids, r.piece, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (places[a:b] == np.arange(b - a)).all()
            parts[d].append((p, ids[a:b].tolist()))
        assert (ids[r.n_tokens:] == 50256).all()
    return parts


@pytest.mark.parametrize("sequence, held", [(64, 4_000_000), (512, 700)])
def test_round_trip(spark, monkeypatch, sequence, held):
    monkeypatch.setattr(P, "ROUND_TOKENS", held)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packs = P.pack_documents(docs, sequence=sequence).collect()
    coder = P.encoder(Path(P.VOCABULARY).read_bytes())
    parts = unpack(packs, sequence)
    for r in docs.collect():
        pieces = sorted(parts[r.doc_id])
        assert [p for p, _ in pieces] == list(range(len(pieces))) and all(len(x) == sequence for _, x in pieces[:-1])
        ids = [t for _, x in pieces for t in x]
        assert ids[-1] == 50256 and coder.decode(ids[:-1]) == r.text
    assert len({(r.shard, r.pack) for r in packs}) == len(packs)
    if held > 10_000:
        assert sum(r.n_tokens for r in packs) / (len(packs) * sequence) > 0.95


def test_odd_and_empty_tables(odd, none):
    parts = unpack(P.pack_documents(odd, sequence=128).collect(), 128)
    coder = P.encoder(Path(P.VOCABULARY).read_bytes())
    want = defaultdict(list)
    for r in odd.collect():
        if r.text:
            want[r.doc_id].append(coder.encode_ordinary(r.text) + [50256])
    for d, texts in want.items():
        assert sum(len(x) for _, x in parts[d]) == sum(map(len, texts))
    assert set(parts) == set(want) and P.pack_documents(none).count() == 0
