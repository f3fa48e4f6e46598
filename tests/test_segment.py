"""Segmentation of ideographs against all routes by force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import segment
from corpusmill.functions.text import CJK
from corpusmill.operators import bounded

LETTERS = "南京市长江大桥"


def cut_by_force(freq, run):
    total = sum(freq.values())
    price = lambda w: math.floor(segment.UNIT * math.log(total / freq.get(w, 1)) + 0.5)
    routes = []
    for breaks in itertools.product([False, True], repeat=len(run) - 1):
        edges = [0, *(i + 1 for i, b in enumerate(breaks) if b), len(run)]
        words = [run[a:b] for a, b in zip(edges, edges[1:])]
        if all(len(w) == 1 or w in freq for w in words):
            routes.append((sum(map(price, words)), [-len(w) for w in words], words))
    return min(routes)[2]


@pytest.mark.parametrize("seed", range(6))
def test_route_is_the_cheapest(seed):
    rng = random.Random(seed)
    freq = {"".join(rng.choice(LETTERS[: 3 + seed % 4]) for _ in range(rng.randrange(1, 6))): rng.choice([1, 1, 2, 5, 100]) for _ in range(25)}
    lexicon = segment.Lexicon(freq.items())
    for _ in range(120):
        run = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 12)))
        assert lexicon.cut(run) == cut_by_force(freq, run)
    assert lexicon.cut("") == []


def test_sub_words_and_odd_terms(spark):
    terms = [("南京", 10), ("京市", 5), ("南京市", 20), ("长江", 9), ("大桥", 9), ("长江大桥", 30), ("江大", 1), ("江大桥", 2), (None, 5), ("", 5), ("市长", 0), ("市长", None), ("ＡB", 3)]
    table = spark.createDataFrame(terms, "term string, freq long")
    lexicon = segment.read_lexicon(table)
    assert lexicon.search_tokens("南京市长江大桥") == ["南京", "京市", "南京市", "长江", "江大", "大桥", "江大桥", "长江大桥"]
    assert lexicon.search_tokens("市长") == ["市", "长"]
    natural = segment.segmenter(table)
    rows = spark.createDataFrame([(1, "看ABC 南京市x1 长江大桥"), (2, "Plain-text Ab1"), (3, None), (4, ""), (5, "y" * 41 + " 南京")], "id long, text string")
    got = {r.id: r.t for r in rows.select("id", natural(F.col("text")).alias("t")).collect()}
    assert got == {1: ["看", "abc", "南京", "京市", "南京市", "x1", "长江", "江大", "大桥", "江大桥", "长江大桥"], 2: ["plain", "text", "ab1"], 3: None, 4: [], 5: ["南京"]}


def test_an_empty_or_too_large_lexicon(spark, monkeypatch):
    empty = spark.createDataFrame([], "term string, freq long")
    assert segment.read_lexicon(empty).search_tokens("南京") == ["南", "京"]
    monkeypatch.setattr(segment, "LEXICON_BYTES", 10)
    with pytest.raises(ValueError, match="lexicon"):
        segment.read_lexicon(spark.createDataFrame([("南京", 1)], "term string, freq long"))


def test_search_with_a_lexicon(spark):
    """The sub-word finds the document whose word is longer; grams across words find nothing."""
    natural = segment.segmenter(spark.createDataFrame([("长江大桥", 9), ("大桥", 9), ("长江", 9)], "term string, freq long"))
    fields = spark.createDataFrame([("s", "s:d:1", "长江大桥", "", ""), ("s", "s:d:2", "江大", "", "")], "source string, identity string, title string, body string, source_path string")
    queries = spark.createDataFrame([(1, "大桥"), (2, "江大桥")], "query_id long, text string")
    got = bounded.best(bounded.match(queries, fields, natural), 5).collect()
    assert {(r.query_id, r.identity) for r in got} == {(1, "s:d:1"), (2, "s:d:1"), (2, "s:d:2")}


def test_long_runs(spark):
    lexicon = segment.Lexicon([("南京", 3), ("京南京", 2)])
    assert len("".join(lexicon.cut("南京" * 200_000))) == 400_000
    assert CJK.startswith(r"[\x{3400}-\x{4DBF}")


def test_cutting_takes_memory_by_the_words_not_by_their_copies(monkeypatch):
    """A batch as Spark gives it, of few words that stand many times; lists over edges of parts, null and empty ones."""
    import tracemalloc

    import pyarrow as pa

    lexicon = segment.Lexicon([("南京", 3), ("长江", 2), ("长江大桥", 9)])
    batch = pa.array([["南京长江大桥", "abc", "长江", "江" * 3] * 5000] * 20, pa.list_(pa.string()))
    tracemalloc.start()
    got = segment.cut_lists(batch, lexicon)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20
    assert got[19].as_py()[:9] == ["南京", "长江", "长江大桥", "abc", "长江", "江", "江", "江", "南京"] and len(got[0]) == 40_000
    monkeypatch.setattr(segment, "AT_ONCE", 3)
    rows = [["南京", "x"], None, [], ["长江大桥"], ["a"] * 7, None]
    want = [None if ws is None else [t for w in ws for t in lexicon.tokens(w)] for ws in rows]
    for part in (pa.array(rows, pa.list_(pa.string())), pa.array([["y"], *rows], pa.list_(pa.string())).slice(1)):
        assert segment.cut_lists(part, lexicon).to_pylist() == want
    assert segment.cut_lists(pa.array([], pa.list_(pa.string())), lexicon).to_pylist() == []


def test_long_terms_are_found_whole():
    long = "".join(chr(0x4E00 + i % 50) for i in range(3 * segment.PREFIX))
    lexicon = segment.Lexicon([(long, 5), (long[:2], 1)])
    assert lexicon.cut("京" + long + "京") == ["京", long, "京"] and len(lexicon.begins) == segment.PREFIX


def test_texts_in_pieces_give_the_same_tokens(spark):
    table = spark.createDataFrame([("南京", 3), ("长江", 2)], "term string, freq long")
    rows = spark.createDataFrame([(1, "南京长江 ab " * 300), (2, ""), (3, None), (4, "长江")], "id long, text string")
    natural, cut = segment.segmenter(table), segment.cutter(table)
    parts = segment.pieces(rows.select("id", segment.words(F.col("text")).alias("words")))
    assert parts.agg(F.max(F.size("words"))).first()[0] <= segment.PIECE
    count = lambda d: {tuple(r) for r in d.groupBy("id", "t").count().collect()}
    assert count(parts.select("id", F.explode(cut(F.col("words"))).alias("t"))) == count(rows.select("id", F.explode(natural(F.col("text"))).alias("t"))) != set()
