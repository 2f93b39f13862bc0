import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, edits):
    s = list(text)
    for _ in range(edits):
        i, kind = rng.randrange(len(s) + 1), rng.random()
        if kind < 0.4:
            s.insert(i, rng.choice("abé"))
        elif s:
            s[min(i, len(s) - 1)] = rng.choice(["", "a", "ñ"])
    return "".join(s)


def plain_classes(rows, edits=L.EDITS):
    occ = [(d, i, line) for d, t in rows for i, line in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", line)]
    where, links = {}, {}
    for d, i, line in occ:
        where.setdefault(line, []).append((d is not None, d or 0, i))
    distinct = sorted(where)
    root = {u: u for u in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            short = min(len(a), len(b))
            if abs(len(a) - len(b)) <= edits and distance(a, b) <= min(edits, short // L.CHARS_PER_EDIT):
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                root[find(a)] = find(b)
    first = {}
    for u in distinct:
        r = find(u)
        first[r] = min(first.get(r, (True, 1 << 60, 0)), min(where[u]))
    return sorted((str(d), i, str(first[find(x)][1] if first[find(x)][0] else None), first[find(x)][2], len(where[x]), links.get(x, 0)) for d, i, x in occ)


def found(df):
    return sorted((str(r.doc_id), r.line_no, str(r.class_doc_id), r.class_line_no, r.n_copies, r.n_links) for r in df.collect())


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_automaton_equals_edit_distance(spark, edits):
    rng = random.Random(4)
    rows = []
    while len(rows) < 1500:
        a = "".join(rng.choice("abé") for _ in range(rng.randint(1, 16)))
        b = edited(rng, a, rng.randint(0, edits + 2))
        if b:
            rows.append((a, b))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", L.edit_distance(F.split("a", ""), F.split("b", ""), edits).alias("d")).collect()
    assert all(r.d == (d if (d := distance(r.a, r.b)) <= edits else None) for r in got)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_classes_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(L, "BROADCAST_LINES", most)
    rng = random.Random(11)
    lines = ["".join(rng.choice("abcdefgh éñ") for _ in range(rng.choice([3, 9, 10, 11, 19, 20, 21, 40, 90]))) for _ in range(60)]
    lines += [edited(rng, rng.choice(lines), rng.randint(1, 4)) for _ in range(160)] + ["a" * n for n in (9, 10, 11, 19, 20, 21, 22, 23)] + ["ab" * 15, "ba" * 15, "b" + "ab" * 14]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, id string")
    assert found(L.line_classes(docs)) == plain_classes(rows)


def test_near_lines_with_the_same_tag_are_linked(spark):
    """Different lines whose tags are equal by hash: two edits apart, and one pair out of reach."""
    lines = ["Part number 2-R is kept in the north hall.", "Part number y-V is kept in the north hall."]
    rows = [(1, lines[0]), (2, lines[1]), (3, lines[0] + "\n" + "Part number 2-R is kept in the north ward.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    tags = {r.line: r.tag for r in L.distinct_lines(docs).collect()}
    assert tags[lines[0]] == tags[lines[1]] and len(tags) == 3
    assert found(L.line_classes(docs)) == plain_classes(rows)
    distinct = L.distinct_lines(docs).withColumn("tag", F.lit(0).cast("bigint"))  # every line under one tag
    names = {r.id: r.line for r in distinct.collect()}
    assert [(names[r.a], names[r.b], r.distance) for r in L.line_links(distinct).collect()] in ([(*lines, 2)], [(*lines[::-1], 2)])


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_signatures_never_exclude_a_pair_in_reach(spark, edits):
    rng = random.Random(8)
    rows = []
    while len(rows) < 3000:
        a = "".join(rng.choice(L.LETTERS + "éñ 7") for _ in range(rng.choice([10, 15, 16, 17, 40])))
        s = list(a)
        for _ in range(edits):
            i = rng.randrange(len(s))
            s[i : i + rng.randint(0, 1)] = rng.choice(["", "", *L.LETTERS])
        rows.append((a, "".join(s)))
    rows += [(a[::-1], b) for a, b in rows]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", L.letters_agree(L.tag(F.col("a")), L.tag(F.col("b")), edits).alias("ok")).collect()
    assert all(r.ok for r in got if distance(r.a, r.b) <= edits)
    assert not signatures_agree(spark, "etna" * 5, "shdl" * 5, edits) and not signatures_agree(spark, "etna" * 5, "etna" * 5 + "7" * (edits + 1), edits)


def signatures_agree(spark, a, b, edits):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    return df.select(L.letters_agree(L.tag(F.col("a")), L.tag(F.col("b")), edits).alias("ok")).first().ok


def test_native_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = L.line_classes(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_odd_and_empty_tables(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(L.line_classes(odd)) == plain_classes(rows)
    assert L.line_classes(none).count() == 0
    docs = spark.createDataFrame([(1, "the first line of all\n\nanother line here"), (2, "the first lime of all\nnew words in a line"), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in L.drop_near_lines(docs).collect()}
    assert got == {1: "the first line of all\n\nanother line here", 2: "new words in a line", 3: None}


def test_near_lines_are_dropped_by_row(spark, odd, none):
    """NULL and repeated ids, texts that are repeats as a whole, other columns."""
    one, two = "a line that comes again and again", "some other words of another line"
    rows = [(None, f"{one}\nkept without an id", "n"), (5, one, "a"), (5, two, "b"), (6, f"{two}\n\n{one}", "c"), (7, None, "d"), (5, two, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id string").coalesce(1)
    got = sorted((str(r.doc_id), r.text, r.id) for r in L.drop_near_lines(docs).collect() if r.text is not None)
    assert got == [("5", "", "a"), ("5", "", "e"), ("5", two, "b"), ("6", "", "c"), ("None", f"{one}\nkept without an id", "n")]
    assert L.drop_near_lines(docs).where("text IS NULL").count() == 1
    left = L.drop_near_lines(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert L.drop_near_lines(none).count() == 0
