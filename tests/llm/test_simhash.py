import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import simhash
from riskloom.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, threshold=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = d if r not in least or least[r] is None else least[r] if d is None else min(d, least[r])
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprints_equal_the_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(docs).collect()}
    assert got == {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}


def test_spark_hash_is_the_same(spark):
    value = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first().h
    assert value % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_blocks_do_not_change_a_fingerprint(monkeypatch):
    raw = " ".join(f"w{i % 97}" for i in range(3000)).encode()
    whole = simhash.fingerprint(raw)
    real = simhash.word_blocks
    monkeypatch.setattr(simhash, "word_blocks", lambda r: real(r, 50))
    assert simhash.fingerprint(raw) == whole == plain_fingerprint(raw.decode())


@pytest.mark.parametrize("codes", [[simhash.GOLAY], [simhash.GOLAY, simhash.GOLAY], [simhash.GOLAY, simhash.GOLAY, simhash.HAMMING]])
def test_home_anchor_is_among_the_replicas_of_every_near_fingerprint(codes):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64))
    blocks = simhash.code_blocks(codes, 2)
    anchor, fp, home = simhash.replicate(x, blocks, 2)
    homes = dict(zip(fp[home].tolist(), anchor[home].tolist()))
    assert len(homes) == len(x)
    anchor, fp, _ = simhash.replicate(y, blocks, 2)
    reach = set(zip(fp.tolist(), anchor.tolist()))
    assert all((b, homes[a]) in reach for a, b in zip(x.tolist(), y.tolist()))


@pytest.mark.parametrize("limit, pairwise", [(20_000, 64), (50, 8)])
def test_components_of_dense_and_sparse_fingerprints(spark, monkeypatch, limit, pairwise):
    """Chains, a dense ball and scattered values; with a low limit crowded anchors take the midpoint way."""
    monkeypatch.setattr(simhash, "ANCHOR_LIMIT", limit)
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre}
    for _ in range(250):
        v = centre
        for b in rng.integers(0, 12, rng.integers(1, 7)):
            v ^= 1 << int(b)
        fps.add(v)
    chain = int(rng.integers(0, 1 << 62))
    for i in range(0, 40, 2):
        fps.add(chain)
        chain ^= 3 << i
    fps |= {int(v) for v in rng.integers(0, 1 << 62, 200)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f if f < 1 << 63 else f - (1 << 64),) for f in fps], "fp bigint")
    roots = {r.node % (1 << 64): r.root for r in components(simhash.links(nodes)).collect()}
    want = plain_components(fps, fps)
    groups = {}
    for f, c in zip(fps, want):
        groups.setdefault(c, set()).add(f)
    got = {}
    for f in fps:
        got.setdefault(roots.get(f, ("own", f)), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_long_chain_contracts(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 1001), (None, 5), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert len({got[i] for i in range(501)}) == 1 and got[1000] == got[1001] != got[0] and len(got) == 503


def test_odd_documents(odd, none):
    rows = odd.select("doc_id", "text").collect()
    got = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(odd).collect())
    fps = [plain_fingerprint(r.text) for r in rows]
    assert got == sorted((str(r.doc_id), f, c) for r, f, c in zip(rows, fps, plain_components([r.doc_id for r in rows], fps)))
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9, 10] and ids.count(None) == 1
    assert simhash.drop_near_duplicates(none).count() == 0


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    """A text without a copy stays, whatever else its id stands for; the same rows stay in any order."""
    x, y, z = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine", "red green blue yellow black white pink")
    rows = [(3, x), (5, x), (5, y), (None, z), (None, x), (8, y), (9, z), (9, "quite another text with words of its own")]
    want = [(3, x), (5, y), (9, "quite another text with words of its own"), (9, z)]
    for part in (rows, rows[::-1]):
        kept = simhash.drop_near_duplicates(spark.createDataFrame(part, "doc_id bigint, text string").repartition(3))
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == want
