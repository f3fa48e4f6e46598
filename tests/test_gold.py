"""Gold pairs of items of any length, by force."""

from corpusmill.plans import retrieval


def test_items_of_any_length_are_found(spark, tmp_path):
    texts = ["one two three four five six", "xone two threex", "the\ttwo\nthree", None, "", "five six one two three four five six.", "a.b[c", " one  two "]
    items = ["one two three four five six", "two three", "one two three", "two", "a.b[", " one  two", "four five six one two three", "", "  ", None, "absent words here", "three"]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.query_id, int(r.gold_key.split(":")[2])) for r in retrieval._gold(spark, str(tmp_path)).collect())
    assert got == [(i, d) for i, x in enumerate(items) if x and x.strip(" ") for d, t in enumerate(texts) if x in (t or "")]
