"""Edge cases of the operators on small tables of our own."""

import hashlib
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import headers, text
from corpusmill.operators import audit, checks, conform, corpus, evaluate, fusion, lexical, lifecycle, semantic, sync
from corpusmill.operators import compile as compile_
from corpusmill.sources import ndjson, notes, snapshots


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [("a\r\nb\rc\n", "a\nb\nc\n"), ("", ""), ("\r", "\n")])
def test_line_ends(spark, raw, want):
    assert one(spark, text.normalize_lf(F.col("t")), t=raw) == want


def test_hashes_and_ids(spark):
    for name in ("s:d:x", "s:d:é", ""):
        assert one(spark, text.point_id(F.col("t")), t=name) == str(uuid.uuid5(text.POINT_NAMESPACE, f"{name}:whole"))
        raw = name.encode()
        assert one(spark, text.blob_sha256(F.col("t")), t=name) == hashlib.sha256(b"blob %d\0" % len(raw) + raw).hexdigest()


@pytest.mark.parametrize("value", ["Straße", "É", "é", "ABC", "ﬁ", ""])
def test_fold_and_nfc(spark, value):
    want = unicodedata.normalize("NFC", unicodedata.normalize("NFC", value).casefold())
    assert one(spark, text.fold(F.col("t")), t=value) == want
    assert one(spark, text.nfc(F.col("t")), t=value) == unicodedata.normalize("NFC", value)


@pytest.mark.parametrize("body, want", [("# A b \nx", "A b"), ("#x\n# y", "y"), ("x", "stem"), ("", "stem"), ("# \n", "stem"), ("#\tT", "T")])
def test_titles(spark, body, want):
    assert one(spark, text.title_of(F.col("t"), F.lit("stem")), t=body) == want


def test_tokens(spark):
    assert one(spark, text.natural_tokens(F.col("t")), t="Ab1 " + "x" * 40 + " " + "y" * 41 + " 南京市 a") == ["ab1", "x" * 40, "南京", "京市", "南京市", "a"]
    assert one(spark, text.natural_tokens(F.col("t"), frozenset({"南京", "南京市"})), t="南京市长") == ["南京", "南京市", "长"]
    assert one(spark, text.slug_tokens(F.col("t")), t="a:B/c_d-e.F") == ["a", "b", "c", "d", "e", "f"]


def test_domains_skip_directories_without_an_index(spark):
    paths = spark.createDataFrame([("s", p) for p in ("INDEX.md", "a/INDEX.md", "a/x/b/INDEX.md", "a/x/b/n.md", "a/x/m.md", "o/p.md", "A/INDEX.md")], "source string, path string")
    domains = corpus.discover_domains(corpus.index_directories(paths))
    assert {(r.dir, r.domain) for r in domains.collect()} == {("a", "a"), ("a/x/b", "a/b"), ("A", "A")}
    near = {r.path: r.domain for r in corpus.nearest_domain(paths, domains).collect()}
    assert near["a/x/b/n.md"] == "a/b" and near["a/x/m.md"] == "a" and "o/p.md" not in near and "INDEX.md" not in near
    assert {r.path for r in corpus.duplicate_domains(domains).collect()} == {"a/INDEX.md", "A/INDEX.md"}
    assert [(r.source, r.n_stray) for r in corpus.stray_notes(paths, domains).collect()] == [("s", 1)]


def test_identity_collisions_use_full_folding(spark):
    rows = spark.createDataFrame([("s", "1", "s:d:straße"), ("s", "2", "s:d:STRASSE"), ("s", "3", "s:d:x"), ("t", "4", "s:d:x")], "source string, path string, identity string")
    assert {r.path for r in corpus.identity_collisions(rows).collect()} == {"1", "2"}


def test_strict_headers():
    fields = dict(headers.parse_strict("a: 'it''s' # c\nb: [x, 'y z', \"q\\n\", ~]\nc:\n  - one\n  - \"two\"\nd: |\n  l1\n\n  l2\ne: >\n  f1\n  f2\n\n  f3\nf:\ng: null\nh: repo/x#y\nk: [a,\n  b]\n"))
    assert fields["a"] == ("scalar", "it's", None) and fields["b"] == ("list", None, ["x", "y z", "q\n", None])
    assert fields["c"][2] == ["one", "two"] and fields["d"][1] == "l1\n\nl2" and fields["e"][1] == "f1 f2\nf3"
    assert fields["f"][0] == "empty" and fields["g"][0] == "null" and fields["h"][1] == "repo/x#y" and fields["k"][2] == ["a", "b"]
    for bad in ("a", " a: 1", "a: [x", "a: [,x]", "a: [x,,y]", "a: [x,]", "a: 'x' y", "a: &x", "a: {b: c}", 'a: "\\q"', 'a: "\\ud800"', "a: |2\n  x", "a: b: c", "a: x\rb"):
        with pytest.raises(headers.HeaderError):
            headers.parse_strict(bad)
    with pytest.raises(headers.HeaderError) as e:
        headers.parse_strict("a: 1\na: 2")
    assert (e.value.code, e.value.field) == ("DUPLICATE", "a")


def test_loose_headers():
    fields = dict(headers.parse_loose("a: \"x # y\" # c\n junk\nb: [1,\n 2]\nc:\n  - x\n  - null\nd: >\n  p\n  q\ne:\nb2: 'it'\n"))
    assert fields == {"a": ("scalar", "x # y", None), "b": ("list", None, ["1", "2"]), "c": ("list", None, ["x", None]), "d": ("scalar", "p q", None), "e": ("null", None, None), "b2": ("scalar", "it", None)}


def test_envelopes(spark):
    cases = {"---\na: 1\n---\nbody": "ok", "﻿---\r\na: 1\r\n---\r\nbody": "ok", "--- \nx": "missing", "x": "missing", "": "missing", "---\na": "unterminated", "---\n---": "ok", "---": "unterminated"}
    rows = spark.createDataFrame([(k,) for k in cases], "content string")
    got = {r.content: (r.state, r.body) for r in conform.with_envelope(rows).collect()}
    assert {k: v[0] for k, v in got.items()} == cases
    assert got["---\na: 1\n---\nbody"][1] == "body" and got["---\n---"][1] == ""


def test_migration_keeps_everything_else(spark):
    note = "---\n# c\ntitle: t\ndescription: d\ndomain:\n  - a\n  - b\nstatus: draft\nhash2: x\n---\nbody\r\n"
    rows = spark.createDataFrame([("s", "p", note), ("s", "q", "no header")], "source string, path string, content string")
    got = {r.path: r for r in conform.strip_fields(rows).collect()}
    assert got["p"].new_content == "---\n# c\ndescription: d\nhash2: x\n---\nbody\r\n" and got["p"].removed == ["domain", "status", "title"]
    assert got["q"].new_content == "no header" and got["q"].removed == []


def test_rewrites_keep_fences_and_line_ends(spark):
    note = "\ufeff---\r\nstatus: raw\r\nkeep: a\u2028b\r\nevidence:\r\n  - old\r\ntitle: x\r\n---\r\nbody\r\n"
    value = "map<string,struct<scalar:string,items:array<string>>>"
    rows = spark.createDataFrame([("s", "p", note, {"status": ("derived", None), "evidence": (None, ["n"]), "new": ("é", None)})], f"source string, path string, content string, updates {value}")
    got = conform.rewrite_fields(rows).first().new_content
    assert got == "\ufeff---\r\nstatus: derived\r\nkeep: a\u2028b\r\nevidence: [\"n\"]\r\ntitle: x\r\nnew: \"é\"\r\n---\r\nbody\r\n"
    assert conform.strip_fields(rows).first().new_content == note.replace("title: x\r\n", "").replace("status: raw\r\n", "")


def test_rendered_notes_read_back(spark):
    row = spark.createDataFrame([(("say \"hi\"\t\\ é\x01", ["a", "1x", "no", "x y"], "spec", [], ["b/c.py"], [], None, "frozen"), "\n\nbody\r\nend\n\n")], "meta struct<description:string,keywords:array<string>,kind:string,links:array<string>,code:array<string>,assets:array<string>,supersedes:string,status:string>, body string")
    out = row.select(conform.render_note().alias("t")).first()["t"]
    assert out.endswith("---\n\nbody\nend\n") and "\\u0001" in out and "links" not in out
    fields = dict(headers.parse_strict(out.split("---\n")[1]))
    assert fields["description"][1] == "say \"hi\"\t\\ é\x01" and fields["keywords"][2] == ["a", "1x", "no", "x y"] and fields["status"][1] == "frozen"


def docs_table(spark, rows):
    return spark.createDataFrame(rows, "source string, identity string, title string, description string, keywords array<string>, body_text string, source_path string, kind string, status string, domain_prefixes array<string>")


def test_bm25_by_hand(spark):
    import math

    docs = docs_table(spark, [("s", "s:d:1", "apple", "", [], "", "x", "spec", None, ["d"]), ("s", "s:d:2", "pear", "", [], "", "x", "note", "frozen", ["d", "d/e"])])
    fields = lexical.lexical_fields(docs)
    queries = spark.createDataFrame([(1, "apple apple", None, None, None, None, None), (2, "nothing", None, None, None, None, None)], "query_id int, text string, source string, domain string, kind string, tag string, status string")
    got = lexical.bm25_scores(queries, lexical.token_lists(fields)).collect()
    assert len(got) == 1 and got[0].identity == "s:d:1"
    assert got[0].score == pytest.approx(2 * 5 * math.log(1 + 1.5 / 1.5) / (1 + 1.5))


def test_facets_never_underfill(spark):
    docs = docs_table(spark, [("s", f"s:d:{i}", "word", "", ["Tag"], "", "x", "spec" if i == 5 else "note", None, ["foo"] if i else ["foo-private"]) for i in range(6)])
    fields = lexical.lexical_fields(docs)
    q = spark.createDataFrame([(1, "word", None, None, " /spec", None, None), (2, "word", None, "/foo/", None, "TAG", None)], "query_id int, text string, source string, domain string, kind string, tag string, status string")
    scored = lexical.bm25_scores(q, lexical.token_lists(fields))
    top = lexical.search(lexical.with_facets(scored, q, docs), 1).collect()
    assert {(r.query_id, r.identity) for r in top} == {(1, "s:d:5"), (2, "s:d:1")}


def test_planner(spark):
    q = spark.createDataFrame([(1, "中文 问题"), (2, "uuid_v5 camelCase x"), (3, "I A plain"), (4, "ABC 中"), (5, None)], "query_id int, text string")
    got = {r.query_id: r for r in fusion.query_features(q).collect()}
    assert got[1].low_anchor and got[1].w_semantic == 2.0 and got[1].n_cjk == 4
    assert got[2].strong_anchor and got[2].w_lexical == 2.0 and got[3].n_code == 0
    assert not got[4].low_anchor and got[4].n_code == 1 and got[5].n_identifiers == 0


def test_stale_reasons_in_order(spark):
    docs = spark.createDataFrame([("s", i, "h", "c") for i in "abcdefh"] + [("s", "n", "h", None)], "source string, identity string, source_hash string, compiled_hash string")
    rows = [(1, "s", "a", 1.0, None, None, "x", "x"), (1, "s", "gone", 1.0, "whole", "t", "h", "c"), (1, "s", "n", 1.0, "chunk", "", "x", "x"), (1, "s", "b", 1.0, "chunk", "t", "h", "c"), (1, "s", "c", 1.0, "whole", "", "h", "c"), (1, "s", "d", 1.0, "whole", "t", "x", "c"), (1, "s", "e", 1.0, "whole", "t", None, "x"), (1, "s", "f", 1.0, "whole", "t", "h", "c")]
    hits = spark.createDataFrame(rows, "query_id int, source string, identity string, score double, unit_mode string, text_hash string, source_hash string, compiled_hash string")
    got = {r.identity: r.reason for r in fusion.gate(hits, docs).collect()}
    assert got == {"a": None, "gone": "compiled_doc_missing", "n": None, "b": "embedding_unit_mismatch", "c": "text_hash_missing", "d": "source_hash_mismatch", "e": "compiled_hash_mismatch", "f": None}


def test_fusion_is_over_the_union(spark):
    lane = lambda rows: spark.createDataFrame([(1, "s", i, s) for i, s in rows], "query_id int, source string, identity string, score double")
    w = spark.createDataFrame([(1, 1.0, 1.0)], "query_id int, w_lexical double, w_semantic double")
    a, b = lane([("x", 9.0), ("y", 8.0)]), lane([("y", 0.9), ("z", 0.8)])
    got = fusion.fuse(a, b, w, 10).orderBy("rank").collect()
    assert [r.identity for r in got] == ["y", "x", "z"] and got[0].score == pytest.approx(1 / 62 + 1 / 61) and got[2].lexical_rank is None
    swapped = fusion.fuse(b, a, w, 10).orderBy("identity").collect()
    assert [r.score for r in swapped] == [r.score for r in sorted(got, key=lambda r: r.identity)]


def test_knn_keeps_the_best_of_an_object(spark):
    points = spark.createDataFrame([("a", "p1", [1.0, 0.0]), ("a", "p2", [0.9, 0.1]), ("b", "p3", [0.0, 1.0]), ("", "p4", [1.0, 0.0]), ("c", "p5", None)], "identity string, point_id string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    got = semantic.cosine_top(q, points, 5, ["identity", "point_id"], "identity").orderBy("rank").collect()
    assert [(r.identity, r.point_id) for r in got] == [("a", "p1"), ("b", "p3")]


def test_embedding_retries_row_by_row(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t))] * (1 if t != "wide" else 2) for t in texts]

    rows = spark.createDataFrame([("1", "a"), ("2", "bad"), ("3", "wide"), ("4", None)], "identity string, text string").coalesce(1)
    got = {r.identity: (r.vector, r.error is None) for r in semantic.embed_rows(rows, embed, 1).collect()}
    assert got == {"1": ([1.0], True), "2": (None, False), "3": (None, False), "4": ([0.0], True)}


@pytest.mark.parametrize("stale, allowed", [(5, True), (6, False)])
def test_prune_guard_is_strict(spark, stale, allowed):
    points = spark.createDataFrame([(str(i), f"s:d:{i}") for i in range(10)], "point_id string, identity string")
    wanted = spark.createDataFrame([("s", f"s:d:{i}") for i in range(stale, 10)], "source string, identity string")
    got = sync.prune_plan(points, wanted).collect()
    assert len(got) == stale and {r.allowed for r in got} == {allowed}
    none = sync.prune_plan(points, wanted.limit(0))
    assert none.count() == 0


def test_links_and_catalog(spark):
    rows = [("s", "d/a.md", "d", "s:d:a", None, "note", ["b", "s:d:b", "zz"], "first", False), ("s", "d/b.md", "d", "s:d:b", "frozen", "note", ["zz"], "second", False), ("s", "d/INDEX.md", "d", "s:d:INDEX", None, "index", [], "top", True)]
    n = spark.createDataFrame(rows, "source string, path string, domain string, identity string, status string, kind string, links array<string>, description string, is_domain_index boolean")
    assert [r.message for r in checks.broken_links(n).collect()] == ["link target does not resolve: s:d:zz"]
    c = checks.catalog(n)
    assert c.first()["catalog"] == f"{checks.START}\n### d\n- [s:d:a](d/a.md) — first\n- [s:d:b](d/b.md) — second\n{checks.END}"
    index = spark.createDataFrame([("s", "INDEX.md", f"é{checks.START}\n")], "source string, path string, content string")
    assert [r.message for r in checks.catalog_findings(index, c).collect()] == ["human index markers are missing"]


def test_references_are_rewritten_once(spark):
    n = spark.createDataFrame([("s", "p", ["a", "c"], "[[a]] [[a#x|y]] [[ab]] [[b]] a")], "source string, path string, links array<string>, content string")
    moves = spark.createDataFrame([("a", "b"), ("b", "q$1")], "old_slug string, new_slug string")
    r = checks.rewrite_references(n, moves).first()
    assert r.new_content == "[[b]] [[b#x|y]] [[ab]] [[q$1]] a" and r.new_links == ["b", "c"] and r.n_replaced == 4


def test_captures_number_collisions(spark):
    box = spark.sql("SELECT 's' AS source, timestamp'2024-01-02 03:04:05' AS ts, title, 'b' AS body, ' ' AS origin FROM VALUES ('A  b'), ('A b'), (' ') AS t(title)")
    got = sorted((r.path or "", r.problem or "") for r in lifecycle.plan_captures(box).collect())
    assert got == [("", "capture title cannot be empty"), ("000-raw/2024/01/02/030405-A-b-02.md", ""), ("000-raw/2024/01/02/030405-A-b.md", "")]


def test_captures_of_one_title_have_distinct_paths(spark):
    box = spark.createDataFrame([("s", "A", str(i)) for i in range(130)] + [("s", "A-12", "x"), ("s", "A-105", "x"), ("s", "B-2024", "x")], "source string, title string, body string").selectExpr("*", "timestamp'2024-01-02 03:04:05' as ts", "'' as origin")
    base = "000-raw/2024/01/02/030405-"
    taken = spark.createDataFrame([("s", f"{base}{t}.md") for t in ("A", "A-03", "A-100", "B-2024")], "source string, path string")
    free = [n for n in range(2, 200) if n not in (3, 12, 100, 105)][:129]
    first = {f"{base}A-12.md", f"{base}A-105.md", f"{base}A.md", f"{base}B-2024.md"}
    got = [r.path for r in lifecycle.plan_captures(box).collect()]
    assert len(got) == len(set(got)) == 133 and first <= set(got) and f"{base}A-100.md" in got and f"{base}A-132.md" in got
    got = [r.path for r in lifecycle.plan_captures(box, taken).collect()]
    free = free + [next(n for n in range(free[-1] + 1, 300))]
    assert sorted(got) == sorted([f"{base}A-{n:02d}.md" for n in free] + [f"{base}A-12.md", f"{base}A-105.md", f"{base}B-2024-02.md"])


def test_metrics(spark):
    ranks = spark.createDataFrame([(r, q) for r, q in ((1, "x"), (10, "x"), (0, "y"), (4, None))], "rank int, qtype string")
    got = {r.slice: r for r in evaluate.slices(ranks, ["qtype"]).collect()}
    assert got["overall"].n == 4 and got["overall"].no_hit == 1 and got["overall"].gold_at_10 == 0.75 and got["overall"].mrr == round((1 + 0.1 + 0.25) / 4, 4)
    assert got["qtype:y"].gold_at_1 == 0 and set(got) == {"overall", "qtype:x", "qtype:y", "qtype:null"}


def test_moves_abort_as_a_batch(spark):
    n = spark.createDataFrame([("s", "d/a.md", "s:d:a", "a", False, "x"), ("s", "d/b.md", "s:d:b", "b", False, "---\nkind: decision\n---\n")], "source string, path string, identity string, slug string, is_domain_index boolean, content string")
    domains = spark.createDataFrame([("s", "d", "d"), ("s", "e", "e")], "source string, dir string, domain string")
    head = n.select("source", "path", "content")
    good = spark.createDataFrame([("s", "d/a.md", "s:e"), ("s", "d/b.md", "s:e:c")], "source string, path string, target string")
    assert [(r.new_path, r.problems, r.ok) for r in audit.plan_moves(good, n, domains, head).orderBy("path").collect()] == [("e/a.md", [], True), ("e/c.md", [], True)]
    clash = spark.createDataFrame([("s", "d/a.md", "s:e:same"), ("s", "d/b.md", "s:e:SAME")], "source string, path string, target string")
    assert {r.ok for r in audit.plan_moves(clash, n, domains, head).collect()} == {False}


def test_snapshots_switch_only_when_valid(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    a = spark.createDataFrame([("x", 1), ("y", 2)], "identity string, v int")
    first = snapshots.build(a, root)
    assert first == snapshots.build(a.orderBy(F.desc("identity")), root)
    snapshots.publish(spark, root, first)
    second = snapshots.build(a.withColumn("v", F.lit(3)), root)
    assert first != second and snapshots.current(spark, root).agg(F.sum("v")).first()[0] == 3
    a.limit(1).write.mode("overwrite").parquet(f"{root}/generations/{second}/rows")
    with pytest.raises(ValueError):
        snapshots.publish(spark, root, second)
    assert snapshots.current(spark, root).agg(F.sum("v")).first()[0] == 3


def test_note_scan(spark, tmp_path):
    for p in ("a/x.md", "a/.hidden/y.md", "node_modules/z.md", "a/b c+d.md", "a/w.txt"):
        at = tmp_path / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(p)
    got = {(r.path, r.content) for r in notes.scan_notes(spark, {"s": str(tmp_path)}).collect()}
    assert got == {("a/x.md", "a/x.md"), ("a/b c+d.md", "a/b c+d.md")}


def test_bad_lines_are_reported(spark):
    lines = spark.createDataFrame([("f", 1, "not json"), ("f", 2, '{"schema":"x"}')], "file string, line int, value string")
    got = {(r.line, r.code) for r in ndjson.validate_lines(lines).collect()}
    assert {(1, "NOT-JSON"), (2, "FIELDS"), (2, "SCHEMA")} <= got


def test_legacy_documents(spark):
    row = spark.createDataFrame([("s", "a/b.md", "text", None)], "source string, path string, content string, body string").withColumn("fields", F.lit(None).cast("map<string,struct<type:string,scalar:string,items:array<string>>>"))
    doc = compile_.compile_legacy(corpus.legacy_notes(row)).first()
    assert doc.identity == "s:legacy:a/b" and doc.keywords == ["legacy", "raw", "unverified"] and doc.body_text.endswith("text")


def test_headers_are_rewritten_without_their_bodies(spark):
    """Python gets the headers alone: no plan step hands over whole notes."""
    value = "map<string,struct<scalar:string,items:array<string>>>"
    notes = spark.createDataFrame([(i, f"---\nstatus: raw\n---\nbody {i}", None if i % 2 else {"status": ("derived", None)}) for i in range(5)], f"id int, content string, updates {value}")
    out = conform.rewrite_fields(notes)
    assert {r.id: r.new_content for r in out.collect()} == {i: f"---\nstatus: {'raw' if i % 2 else 'derived'}\n---\nbody {i}" for i in range(5)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan


def test_lengths_and_facts_need_no_postings_and_no_second_hashing(spark):
    """Field statistics shuffle no terms; what gates compare is hashed once and read from a table."""
    from corpusmill.operators import lexical
    from corpusmill.plans import retrieval

    where = "/root/testdata/sf0.001"
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    stats = retrieval.field_stats(spark, where)
    assert "tf" in plan(stats) and "explode" not in plan(stats)
    fields = retrieval._fields(spark, where)
    both = [{(r.corpus, r.field): (r.n_docs, round(r.avgdl, 9)) for r in lexical.field_stats(fields, rows, p).collect()} for p in ("v1", "v2") for rows in (lexical.field_lengths(fields, p), lexical.postings(fields, p))]
    assert both[0] == both[1] and both[2] == both[3] and both[0]
    facts = retrieval.lanes(spark, where)[0]
    assert "sha2" not in plan(facts) and facts.count() > 0
