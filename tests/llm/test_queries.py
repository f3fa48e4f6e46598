"""Registered queries against their SQL, and the pipeline against its stages done by force, on the smallest tables."""

import hashlib
import os
from collections import Counter

import duckdb
import pytest

from corpusmill.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.fetchall())


def test_pipeline_stages(spark):
    import corpus_pipeline
    from tests.llm.test_operators import contaminated_by_force, lower, shingle_counts, similarity

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    docs = queries.table(spark, SF, "documents")
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    scores = {r.doc_id: r.predicted for r in queries.op2_quality(spark, SF).collect()}
    left = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] == 1}
    last = {}
    for i in sorted(left):
        last[lower(left[i])] = i
    left = {i: left[i] for i in last.values()}
    counts = {i: shingle_counts(t) for i, t in left.items()}
    label = {i: i for i in left}
    pairs = [(i, j) for i in left for j in left if j < i and abs(len(left[i]) - len(left[j])) < 0.3 * max(len(left[i]), len(left[j])) and similarity(counts[i], counts[j]) >= 0.8]
    for _ in pairs:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    left = {i: t for i, t in left.items() if label[i] == i and not contaminated_by_force(t, items)[4]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(left) and len(got) > 50
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    for i in sorted(left)[:40]:
        ids = tok.encode(left[i], add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
