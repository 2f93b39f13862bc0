import random

import pytest

from riskloom.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(5)
    terms = ["".join(rng.choice("abcé") for _ in range(rng.randint(3, 13))) for _ in range(30)]
    near = X.Misspellings(terms)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i:i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "z", "漢"])
        w = "".join(w)
        want = min(((distance(w, t), t) for t in terms if distance(w, t) <= X.edits_allowed(t)), default=None)
        assert near.find(w) == want, w


def test_quotation_is_not_abuse():
    s = X.Scorer(X.Model(["pathetic", "moron"], []))
    assert s.features("You pathetic moron")[1:] == (2, 0, 0)
    assert s.features("You pathetik moron")[1:] == (1, 1, 0)
    assert s.features('She said "pathetic moron" and left')[1:] == (0, 0, 2)
    assert s.features("> you moron\nI do not agree with that")[1:] == (0, 0, 1)
    assert s.features("nothing at all")[1:] == (0, 0, 0)


def test_a_long_text_counts_alike_wherever_its_terms_stand():
    s = X.Scorer(X.Model(["pathetic", "moron"], []))
    assert s.features("some é words and a moron " * 400) == (2400, 400, 0, 0)
    for pad in (0, 1, 150_000, 200_000, 262_142, 262_143, 262_144, 500_000):  # about and beyond 1 MB
        assert s.features("foo " * pad + 'He said "you moron are here" and went. ' + "bar " * 9)[1:] == (0, 0, 1), pad
        assert s.features("foo " * pad + "you moron are here. " + "bar " * 9)[1:] == (1, 0, 0), pad


def test_long_quotations_on_both_sides():
    s = X.Scorer(X.Model(["moron"], []))
    far = "word " * 30
    for a, b in ['""', "“”", "„“", "«»"]:
        assert s.features(f"He wrote {a}{far}moron {far}end{b} today")[1:] == (0, 0, 1), a
        assert s.features(f"He wrote {a}{far}end{b} today. You moron. {far} {a}short text{b}")[1:] == (1, 0, 0), a
        assert s.features(f"An open {a} mark and a moron {far}")[1:] == (1, 0, 0), a
    assert s.features(f'a 5" pipe and a moron with a 3" pipe, {far}')[1:] == (1, 0, 0)
    assert s.features(f'"{far}\nmoron {far}"')[1:] == (1, 0, 0)


@pytest.fixture(scope="module")
def made(spark):
    """Half of the toxic documents are learnt from; some held-out ones misspell their term."""
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(60)]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(60), rng.choice(["gurkzapf", "blortish", "vexwump"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, " ".join(words[:30]) + " gurkzaf blortlsh gurrkzapf vexwumpp " + " ".join(words[30:60])), (5001, " ".join(words[:60]))]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_misspellings(made):
    docs, labels = made
    rows = X.toxicity(docs, labels).join(labels, "doc_id", "left").collect()
    held = [r for r in rows if r.held_out and r.toxic is not None]
    assert len(held) > 100 and all(r.predicted == r.toxic for r in held)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5000].predicted == 1 and by_id[5001].predicted == 0
    kept = {r.doc_id for r in X.reject_toxic(docs, labels).collect()}
    assert kept == {r.doc_id for r in rows if r.predicted == 0}


def test_copies_of_one_document_prove_nothing(spark, made):
    docs, labels = made
    copy = [(6000 + i, "quonset hermeneutic parallax glyph") for i in range(60)]
    more = docs.unionByName(spark.createDataFrame(copy, "doc_id bigint, text string"))
    marked = labels.unionByName(spark.createDataFrame([(i, 1, 1) for i, _ in copy], "doc_id bigint, quality int, toxic int"))
    assert set(X.learn(more, marked).terms) == {"gurkzapf", "blortish", "vexwump"}


def test_odd_documents(odd, none, no_labels, odd_labels):
    for labels in (no_labels, odd_labels):
        got = X.toxicity(odd, labels).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert {r.predicted for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert X.toxicity(none, odd_labels).count() == 0
    out = X.reject_toxic(odd, odd_labels)
    assert out.columns == odd.columns and out.count() == odd.count()
