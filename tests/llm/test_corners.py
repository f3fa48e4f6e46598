"""Corners of the counters, archives, token files and the classifier's sample."""

import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import quality, token_counts, token_files, warc
from corpusmill.llm.store import new_path
from tests.llm.test_operators import BYTE_BPE, prose


def test_quantiles_of_all_hundredths(spark):
    rows = spark.range(1, 101).select(F.col("id").alias("length"), F.lit(1).cast("long").alias("n_docs"), F.lit(100).cast("long").alias("docs_total"), (101 - F.col("id")).alias("docs_at_least")).cache()
    for i in range(1, 101, 3):
        for share in (i / 100, f"{i / 100:.2f}"):
            assert token_counts.length_quantile(rows, share).first().length == i
    assert token_counts.length_quantile(rows.limit(0), 0.5).first().length is None


def records(n):
    return b"".join(warc._record(i, f"http://x/{i}", b"p" * 50, "0" * 40, None, False, "d") for i in range(n))


def test_cut_archives_are_errors():
    whole = warc.deflate(records(3))
    assert len(list(warc.split_records(warc.inflate(io.BytesIO(whole))))) == 3
    assert len(list(warc.split_records(warc.inflate(io.BytesIO(whole + whole))))) == 6
    assert list(warc.inflate(io.BytesIO(b""))) == []
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    cut = engine.compress(records(2)) + engine.flush(zlib.Z_SYNC_FLUSH)  # ends with a record, not with the member
    for bad in (cut, whole[:-4], whole + whole[:40]):
        with pytest.raises(ValueError, match="inside"):
            list(warc.split_records(warc.inflate(io.BytesIO(bad))))


def test_lost_records_are_errors(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(warc.deflate(records(2)))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    normal = lambda *rows: warc.normalise_archives(spark.createDataFrame(list(rows), warc.FILES), f"file://{tmp_path}", new_path(spark, "warc"))
    assert [r.n_records for r in normal(("a", None)).collect()] == [r.n_records for r in normal(("a", 2)).collect()] == [2]
    for bad in (("a", 3), ("empty", 1)):
        with pytest.raises(Exception, match="where"):
            normal(bad)


def test_null_and_repeated_ids_are_spread(spark):
    rows = [(None, prose(5, i)) for i in range(200)] + [(7, prose(5, i)) for i in range(200)] + [(8, None), (8, "")]
    docs, out = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), new_path(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_token_files(docs, out, BYTE_BPE)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert token_files.shards(spark, out).filter("n_docs > 0").count() >= 3
    got = token_files.read_token_files(spark, out).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == [None] * 200 + [7] * 200 + [8] * 2
    assert [r.start for r in got] == np.append(0, np.cumsum([r.n_tokens for r in got]))[:-1].tolist()


def test_rows_that_repeat_an_id_count_once(spark):
    docs = spark.createDataFrame([(i, prose(30, i) if i % 2 else "buy now !!! $$$ " * 9) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    one, many = quality.train(docs, labels), quality.train(docs.union(docs).union(docs), labels.union(labels))
    assert np.array_equal(one.weights, many.weights) and np.array_equal(one.steps, many.steps) and (one.slope, one.offset) == (many.slope, many.offset)
