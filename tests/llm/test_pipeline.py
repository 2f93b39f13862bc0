import corpus_pipeline as C
import __spark_entry__ as entry
from riskloom.llm import toxicity
from riskloom.session import materialise
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "source mixing", "token packing"]
    clean = materialise(stages["toxicity"](spark, docs, SF), "t")
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    rows = clean.collect()
    assert {r.doc_id for r in rows} == {d for d, p in scores.items() if not p} and clean.columns == docs.columns
    single = materialise(stages["simhash near-dedup"](spark, clean, SF), "t")
    ids, fps = [r.doc_id for r in rows], [plain_fingerprint(r.text) for r in rows]
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, c in zip(ids, plain_components(ids, fps)) if d == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    pure = materialise(stages["benchmark decontamination"](spark, single, SF), "t")
    before = {r.doc_id: r for r in single.collect()}
    after = {r.doc_id: r for r in pure.collect()}
    for d, r in before.items():
        n, hit, _ = plain_hits(r.text, items)
        assert (d in after) == (hit <= 0.5 * n)
        if d in after:
            assert (after[d].text == r.text) == (hit == 0) and plain_hits(after[d].text, items)[1] == 0
    mixed = materialise(stages["source mixing"](spark, pure, SF), "t")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= set(after)
    packed = stages["token packing"](spark, mixed, SF)
    assert {d for r in packed.select("doc_ids").collect() for d in r.doc_ids} == {r.doc_id for r in mixed.collect()}


def test_run_and_registration(spark):
    assert entry.queries()["pipeline"] is C.run and C.ORACLE_SQL is None
    assert C.run(spark, SF).count() > 0
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
