"""Removal of repeated passages against all windows by force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from corpusmill.llm import passage_dedup


def passages_by_force(rows, length):
    """rows: distinct (doc_id, text). Windows of all documents in order; of equal ones the first stays."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen, out = set(), []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1):
            window = tuple(w[i : i + length])
            if window in seen:
                gone.update(range(i, i + length))
            seen.add(window)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        runs = sum(j - 1 not in gone for j in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), runs))
    return out


def noise(rng, n, letters):
    return [rng.choice(letters) for _ in range(n)]


@pytest.mark.parametrize(("length", "letters", "seed"), [(20, 400, 0), (20, 2, 1), (20, 1, 2), (8, 3, 3), (4, 2, 4), (7, 4, 5), (13, 2, 6)])
def test_removal_equals_force(spark, length, letters, seed):
    rng = random.Random(seed)
    alphabet = [f"w{i}é" if i % 3 else f"W{i}" for i in range(letters)]
    passages = [noise(rng, n, alphabet) for n in (length - 1, length, length + 1, 2 * length, 5 * length)]
    texts = []
    for i in range(60):
        body = noise(rng, rng.randrange(0, 90), alphabet)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice(passages)
        texts.append(rng.choice([" ", "\n", " \t ", "\x0b\x0c"]).join(body))
    texts += [None, "", "   \n", "   ", texts[3], texts[3], " ".join(passages[4] * 3), "\x1c".join(passages[4]), "\x85 ".join(passages[4])]
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rng.sample(rows, len(rows))], "doc_id long, text string, rank string, did long, n long").repartition(7)
    got = passage_dedup.remove_passages(docs, length=length)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "n_passages"]
    assert sorted(map(tuple, got.collect())) == sorted(passages_by_force(rows, length))


def test_rows_that_repeat_and_null_ids(spark):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(5, text), (5, text), (9, text + " tail"), (None, "a b " * 12), (None, text)]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in passage_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(5, 30, 30): 2, (9, 31, 30): 1, (None, 24, 22): 1, (None, 30, 0): 1}
    twice = passage_dedup.remove_passages(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()
    assert [r.n_removed for r in twice] == [0, 0]


def test_texts_that_are_left_and_no_rows(spark):
    text = " ".join(f"x{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, "before\n" + text + "\nafter"), (3, "one  two")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in passage_dedup.remove_passages(docs, with_text=True).collect()}
    assert got == {1: text, 2: "before after", 3: "one two"}
    assert passage_dedup.remove_passages(docs.limit(0)).collect() == []


def test_very_long_text_among_copies(spark):
    rng = random.Random(9)
    long = " ".join(f"{rng.randrange(1 << 30):x}" for _ in range(300_000))
    rows = [(1, long), (2, long.replace(" ", "\n")), (3, "short"), (4, long[:200_000])]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in passage_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (300_000, 0) and got[2] == (300_000, 300_000) and got[4][0] - got[4][1] <= 1


def test_hot_passage_in_thousands_of_texts(spark):
    hot = [f"h{i}" for i in range(25)]
    rows = [(i, " ".join([f"a{i}", f"b{i % 7}", *hot, f"c{i % 5}", f"d{i}"])) for i in range(3000)]
    got = passage_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(passages_by_force(rows, 20))
