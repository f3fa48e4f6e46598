"""Very long texts in every operator that reads documents; odd rows and tables in every stage of the pipeline."""

import random
from collections import Counter

import pytest

from corpusmill.llm import bpe, decontaminate, exact_dedup, near_dedup, quality, suffix_dedup, token_counts, token_files
from corpusmill.llm.store import new_path
from tests.llm.test_operators import BYTE_BPE, WORD_BPE, lower, prose, public  # noqa: F401

SIZE = 2 << 20


@pytest.fixture(scope="module")
def long(spark):
    """Two near copies beyond a slice, one with a passage of a test item, and two short texts."""
    base = "\n".join(prose(400, i) for i in range(900))
    item = prose(30, 5001)
    texts = [base, base.replace("alpha1 ", "omega ", 3) + " " + item, "short", base.encode().upper().decode(), None]
    assert len(base.encode()) > SIZE
    return texts, item, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_long_texts_in_every_operator(spark, long):
    texts, item, docs = long
    assert [r.group_id for r in near_dedup.near_dedup(docs).orderBy("doc_id").collect()] == [0, 0, 2, 0, 4]
    assert [r.keep_id for r in exact_dedup.exact_dedup(docs).orderBy("doc_id").collect()] == [3, 1, 2, 3, 4]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [r.n_items for r in decontaminate.contamination(docs, bench).orderBy("doc_id").collect()] == [0, 1, 0, 0, 0]
    removed = suffix_dedup.remove_repeats(docs).orderBy("doc_id").collect()
    assert [r.n_bytes for r in removed] == [len((t or "").encode()) for t in texts]
    assert removed[0].n_removed > 0.99 * removed[0].n_bytes and removed[2].n_removed == removed[4].n_removed == 0
    out = new_path(spark, "tokens")
    token_files.write_token_files(docs, out, BYTE_BPE)
    sizes = [r.n_tokens - 1 for r in token_files.read_token_files(spark, out).orderBy("doc_id").collect()]
    assert sorted(sizes) == sorted(r.length for r in token_counts.length_histogram(docs, BYTE_BPE).collect() for _ in range(r.n_docs))
    assert [r.n_tokens > 500_000 for r in bpe.encode_decode(docs, WORD_BPE).orderBy("doc_id").collect()] == [True, True, False, True, False]
    blank = quality.train(docs.limit(0), docs.select("doc_id").selectExpr("doc_id", "1 as quality"))
    assert [r.score for r in quality.score_quality(docs, blank).collect()] == [0.5] * 5


def test_many_short_lines_take_bounded_memory():
    """A chain of 300,000 lines; features are made a block at a time."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    field = quality.Field(rng.normal(size=quality.N_FEATURES) * 0.1, np.zeros((2, 2)))
    tracemalloc.start()
    score = field.score(pa.array(["a\n" * 300_000, "b c\nd"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(score) == 2 and peak < 250 << 20


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    clean = [prose(60, rng.random()) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(50, clean[0].encode().upper().decode()), (51, clean[1] + " tail"), (51, clean[1] + " tail"), (52, None), (53, ""), (None, clean[2]), (None, None), (54, "x" * 5000)]
    extra = "n_chars long, kept string, score string, node long, __id2 string, signature string, text_sha256 string"
    return spark.createDataFrame([(*r, "en", "s", 1, "k", "s", 3, "i", "g", "h") for r in rows], f"doc_id long, text string, lang string, source string, {extra}")


def test_stages_take_odd_rows_and_tables(spark, odd, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(20, 5)), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    known = Counter((r.doc_id, r.text) for r in odd.collect())
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, odd, str(tmp_path)), stage(spark, odd.limit(0), str(tmp_path))
        assert none.count() == 0
        if name == "bpe":
            assert got.count() == odd.count()
            continue
        assert got.columns == odd.columns and none.columns == odd.columns
        kept = Counter((r.doc_id, r.text) for r in got.collect())
        assert not kept - known
        if name == "exact_dedup":
            assert sorted(lower(t) for _, t in kept.elements()) == sorted({lower(t) for _, t in known})
        if name == "near_dedup":
            assert (None, odd.filter("doc_id = 2").first().text) in kept and (None, None) in kept and (52, None) in kept and (50, odd.filter("doc_id = 50").first().text) not in kept
        if name == "decontaminate":
            assert kept == known
