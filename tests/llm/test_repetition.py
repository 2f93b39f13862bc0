import random
import re
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import repetition as R


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>")}
    seen, dup, chars = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            if line in seen:
                dup += 1
                chars += len(re.sub(r"[\x20\x09-\x0D]+", "", line))
            seen.add(line)
    out |= {"n_dup_lines": dup, "dup_line_chars": chars}
    for n in sorted({*R.GRAM_LIMITS, 8}):
        count = Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
        inside = {j for i in range(len(w) - n + 1) if count[tuple(w[i:i + n])] > 1 for j in range(i, i + n)}
        if n in R.GRAM_LIMITS:
            out[f"gram{n}_chars"] = sum(len(w[j]) for j in inside)
        if n == 8:
            out["n_repeat_words"] = len(inside)
    out["base_failed"] = len(w) < 20 or 100 * out["n_repeat_words"] > 30 * len(w)
    out["kept"] = not out["base_failed"] and 100 * chars <= R.LINE_LIMIT * out["word_chars"] and all(100 * out[f"gram{n}_chars"] <= p * out["word_chars"] for n, p in R.GRAM_LIMITS.items())
    return out


@pytest.mark.parametrize("size", [1, 300, 4 << 20])
def test_random_texts_equal_the_definition(spark, monkeypatch, size):
    monkeypatch.setattr(R, "SLICE_BYTES", size)
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a ", "b ", "é ", "ab\n", "|", "漢\n", "\n", "\t", " #"]) for _ in range(rng.randint(0, 80))) for _ in range(150)] + [None, "", "\n", "a\n", "\na", "x " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(2)
    for r in R.repetition(docs).collect():
        want = plain(texts[r.doc_id])
        assert {k: r[k] for k in want} == want, texts[r.doc_id]


def test_odd_and_empty_tables(odd, none):
    rows = {str((r.doc_id, r.text)): plain(r.text) for r in odd.collect()}
    got = R.repetition(odd).collect()
    assert Counter((str(r.doc_id), r.n_words, r.kept) for r in got) == Counter((k.split(",")[0][1:], v["n_words"], v["kept"]) for k, v in ((str((r.doc_id, r.text)), rows[str((r.doc_id, r.text))]) for r in odd.collect()))
    assert R.repetition(none).count() == 0
    assert R.drop_repetitive(odd).columns == odd.columns and R.drop_repetitive(none).count() == 0


def test_no_hash_is_shared_by_different_words():
    words = [bytes([a, b]) for a in range(97, 123) for b in range(97, 123)]
    data = np.frombuffer(b"".join(words), np.uint8)
    up, down = R.powers(R._BYTE_BASE, len(data))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])])
    start = np.arange(0, len(data), 2)
    assert len(set(R.span_hash(prefix, down, start, start + 2).tolist())) == len(words)


def test_lines_and_words_of_a_thue_morse_string_differ(spark):
    """Polynomial hashes modulo 2 ** 64 take such a string and its complement for equal."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    rows = [(1, a + "\n" + b), (2, a + "\n" + a), (3, " ".join([a, b] * 5)), (4, " ".join(["x", a] * 8))]
    got = {r.doc_id: r for r in R.repetition(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i].n_dup_lines for i in (1, 2)] == [0, 1]
    assert [got[i].n_repeat_words for i in (1, 2, 3, 4)] == [0, 0, 10, 16]
