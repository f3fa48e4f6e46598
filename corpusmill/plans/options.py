"""Queries on what retrieval, synchronisation, audit and intake do on request: lanes, narrowing, depth, guards, legacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import point_id
from ..operators import audit, bounded, checks, compile as compile_, conform, corpus, evaluate, fusion, lexical, semantic, sync, telemetry
from ..schemas import GOLD
from ..sources import isolated, ndjson, paged, pointer
from ..sources import notes as note_trees
from ..sources.export import export_hits, write_hits
from ..sources.keyed import KeyedTable
from ..sources.storage import materialise, new_path
from . import retrieval as r
from . import structure as st
from . import upkeep as up
from .standins import DOCS_SQL, NOTES_SQL, PATHS_SQL, docs, notes, paths, table

K = r.K


def _n():
    return F.col("doc_id")


# retrieval


def _asking(spark, sf_dir):
    """Benchmark texts, every third for one source, every third with a blank."""
    i = F.col("query_id")
    return r.asked(spark, sf_dir).withColumn("source", F.when(i % 3 == 0, F.concat(F.lit("src"), i % 25)).when(i % 3 == 1, F.lit("  ")))


def narrowed_search(spark, sf_dir):
    needs = _asking(spark, sf_dir).withColumn("needs", bounded.facet_needs("source"))
    return bounded.best(r.matched(spark, sf_dir, needs), K, digits=6)


def unknown_sources(spark, sf_dir):
    return lexical.unknown_sources(_asking(spark, sf_dir), docs(spark, sf_dir)).select("query_id", "source")


def _marked_points(spark, sf_dir):
    """Points with the payload that a search insists on, by their number."""
    v = F.col("vec_id")
    pick = lambda m, other, usual: F.when(v % m == 0, other).otherwise(usual)
    return r.points(spark, sf_dir).withColumns({"point_kind": pick(5, "chunk", "note"), "index_profile": pick(7, "old", "default"), "embedding_profile": pick(11, "old", "default"), "identity": F.concat(F.lit("s"), "label", F.lit(":"), "vec_id")})


def knn_managed(spark, sf_dir):
    points = semantic.managed_points(_marked_points(spark, sf_dir), "default", "default")
    return semantic.cosine_top(r.vectors(spark, sf_dir), points, K, ["vec_id"]).select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


def knn_depth(spark, sf_dir):
    """The best point of each label among the 50 nearest, as a bounded search finds them."""
    return semantic.cosine_top_within(r.vectors(spark, sf_dir), r.points(spark, sf_dir), K, ["label", "vec_id"], "label").select("query_id", "label", "vec_id", "rank", F.round("score", 5).alias("score"))


def knn_narrowed(spark, sf_dir):
    """Half the queries ask for one source, after the cut by depth."""
    i = F.col("query_id")
    hits = semantic.cosine_top_within(r.vectors(spark, sf_dir), _marked_points(spark, sf_dir), semantic.search_depth(K), ["identity"])
    queries = r.vectors(spark, sf_dir).select("query_id", F.when(i % 100 == 0, F.concat(F.lit("s"), (i / 50).cast("long") % 10)).alias("source"))
    return semantic.narrowed_hits(hits, queries, K).select("query_id", "identity", "rank", F.round("score", 5).alias("score"))


def old_collections(spark, sf_dir):
    """One collection per label class, searched one by one and merged."""
    points = _marked_points(spark, sf_dir)
    hits = [semantic.cosine_top(r.vectors(spark, sf_dir), points.filter(F.col("label") % 3 == i), K, ["identity"]) for i in range(3)]
    return semantic.merge_collections(hits, K).select("query_id", "identity", "rank", F.round("score", 5).alias("score"))


def _recall(spark, sf_dir, lane):
    d, a, b = r.lanes(spark, sf_dir, lane != "lexical")
    hits, health = fusion.recall(r.asked(spark, sf_dir), a, b, r.published(d), K, lane)
    return hits.withColumn("score", F.round("score", 9)), health


def recall_lexical(spark, sf_dir):
    return _recall(spark, sf_dir, "lexical")[0]


def recall_semantic(spark, sf_dir):
    return _recall(spark, sf_dir, "semantic")[0]


def lane_health(spark, sf_dir):
    """Lexical lane asked for: vectors are off, and that is no degradation."""
    return _recall(spark, sf_dir, "lexical")[1].select("query_id", "status", "semantic_on", "freshness", "n_hits")


def recall_enriched(spark, sf_dir):
    """Fused hits with what a reader of them sees; every third document has a point."""
    d, (hits, _) = docs(spark, sf_dir), _recall(spark, sf_dir, "hybrid")
    d = d.withColumn("keywords", F.when(_n() % 4 == 0, F.array(F.lit("raw"))).otherwise(F.col("keywords")))
    sources = d.select("source", F.concat(F.lit("/data/"), "source").alias("root"), (F.length("source") > 4).alias("legacy")).distinct()
    known = d.filter("doc_id % 3 = 0").select(point_id(F.col("identity")).alias("point_id"))
    rows = fusion.semantic_indexed(fusion.enrich(hits, d, sources), known)
    return rows.select("query_id", "identity", "rank", "score", "title", "abs_path", "status", "kind", "legacy", "is_raw", "is_unverified", "preview", "semantic_indexed")


def written_hits(spark, sf_dir):
    """Exported hits, written as JSON lines and read back."""
    path = new_path(spark, "hits")
    write_hits(export_hits(r.bm25_topk(spark, sf_dir), docs(spark, sf_dir)), path)
    return spark.read.schema("query_id long, rank int, identity string, n_chars int, truncated boolean").json(path)


# evaluation


def gold_violations(spark, sf_dir):
    """Gold lines of benchmark items, broken in a way by their number."""
    i = F.col("item_id")
    row = F.struct(
        F.when(i % 9 == 1, "zz").otherwise("fx").alias("fixture_id"), F.when(i % 9 == 2, " ").otherwise(F.col("text")).alias("query"),
        F.when(i % 9 == 3, F.lit("src0:en")).when(i % 9 == 4, F.lit("nowhere:en:1")).otherwise(F.lit("src0:en:1")).alias("gold_key"), F.when(i % 9 != 5, "t").alias("qtype"), F.lit("s").alias("_slice"),
    )
    lines = table(spark, sf_dir, "benchmark").select(i.alias("line"), F.to_json(row).alias("value"))
    return evaluate.gold_violations(evaluate.read_gold(lines), docs(spark, sf_dir)).select("line", "code")


def gold_drift(spark, sf_dir):
    """Keys of the documents' successors that the corpus doesn't hold."""
    gold = docs(spark, sf_dir).select(F.concat_ws(":", "source", "domain", _n() + 1).alias("gold_key"))
    return evaluate.drift(gold, docs(spark, sf_dir))


def gold_fixture(spark, sf_dir):
    """Rows of a gold set and the length of its hash."""
    gold = table(spark, sf_dir, "benchmark").select(F.lit("fx").alias("fixture_id"), F.col("text").alias("query"), F.concat(F.lit("s:d:"), "item_id").alias("gold_key"), F.lit("t").alias("qtype"), F.lit("s").alias("_slice"))
    assert [p.split()[0] for p in GOLD.split(", ")] == gold.columns
    return evaluate.fixture_hash(gold).select("n", F.length("fixture_hash").alias("hash_chars"))


def _gold_rows(spark, sf_dir, fixture="fx"):
    return table(spark, sf_dir, "benchmark").select(F.lit(fixture).alias("fixture_id"), F.coalesce("text", F.lit("")).alias("query"), F.concat(F.lit("s:d:"), "item_id").alias("gold_key"), F.lit("t").alias("qtype"), F.lit("s").alias("_slice"))


def fixture_digest(spark, sf_dir):
    """The hash of a gold set."""
    return evaluate.fixture_hash(_gold_rows(spark, sf_dir))


def baseline_binding(spark, sf_dir):
    """What keeps three baselines from judging a gold set: one of its own rows, one of rows without the first item, one of
    another fixture without a hybrid lane."""
    gold = _gold_rows(spark, sf_dir)
    found = table(spark, sf_dir, "benchmark").select(F.lit("overall").alias("slice"), F.lit(0.5).alias("gold_at_10")).limit(1)
    both = {"lexical": found, "hybrid": found}
    cases = {"own": (gold, both), "other rows": (gold.filter("gold_key <> 's:d:0'"), both), "other fixture": (_gold_rows(spark, sf_dir, "fy"), {"lexical": found})}
    out = None
    for name, (rows, lanes) in cases.items():
        bad = evaluate.baseline_violations(evaluate.make_baseline(rows, lanes), gold).agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes")).select(F.lit(name).alias("baseline"), "codes")
        out = bad if out is None else out.unionByName(bad)
    return out


def _gates(spark, sf_dir):
    s1, s2 = (evaluate.slices(ranks, r.BY) for ranks in r.both_ranks(spark, sf_dir))
    return evaluate.hybrid_gate(s2, s1, s2, s1)


def hybrid_gates(spark, sf_dir):
    """The global profile as the hybrid lane, against both profiles and the per-source one as floor."""
    return _gates(spark, sf_dir)


def gates_pass(spark, sf_dir):
    return evaluate.gates_pass(_gates(spark, sf_dir))


# synchronisation


class _PageFiles:
    """A paging service over one file a page; every third page fails when it is first asked for."""

    def __init__(self, folder: str, pages: list[int], columns: list[str]):
        self.folder, self.pages, self.columns, self.asked = folder, pages, columns, set()

    def following(self, offset: str | None) -> str | None:
        at = 0 if offset is None else self.pages.index(int(offset)) + 1
        return str(self.pages[at]) if at < len(self.pages) else None

    def fetch(self, offset: str) -> list[tuple]:
        from pyarrow import dataset, fs

        if int(offset) % 3 == 0 and offset not in self.asked:
            self.asked.add(offset)
            raise TimeoutError(f"page {offset} took too long")
        system, folder = fs.FileSystem.from_uri(self.folder)
        page = dataset.dataset(f"{folder}/page={offset}", filesystem=system, format="parquet").to_table(self.columns)
        return list(zip(*page.to_pydict().values()))


def paged_points(spark, sf_dir):
    """The index read page by page from a service that fails now and then: the notes that it holds."""
    folder, columns = new_path(spark, "pages"), ["point_id", "identity", "source_path"]
    up.points(spark, sf_dir).select(*columns, F.pmod(F.xxhash64("point_id"), F.lit(20)).alias("page")).repartition("page").write.partitionBy("page").parquet(folder)
    pages = [r.page for r in spark.read.parquet(folder).select("page").distinct().orderBy("page").collect()]
    points = paged.read_pages(spark, _PageFiles(folder, pages, columns), "point_id string, identity string, source_path string", attempts=2, wait_seconds=0)
    return sync.note_index(points)


#: Sources whose files the stand-in fleet breaks.
_BROKEN = ("src3", "src7")


def _broken_fleet(spark, sf_dir):
    """Each source's compiled documents as files of its own, those of two sources cut short; read source by source. Every
    task writes files of the sources it meets: texts are not shuffled, and no task holds a whole source."""
    folder, d = new_path(spark, "fleet"), docs(spark, sf_dir).filter("doc_id % 11 <> 0").drop("doc_id")
    d.withColumn("of", F.col("source")).write.option("compression", "zstd").partitionBy("of").parquet(folder)
    names = sorted(r.of for r in spark.read.parquet(folder).select("of").distinct().collect())
    for name in set(_BROKEN) & set(names):
        for file in pointer.names(spark, f"{folder}/of={name}"):
            at, fs = pointer.located(spark, f"{folder}/of={name}/{file}")
            out = fs.create(at, True)
            out.write(bytearray(b"PAR1 cut short"))
            out.close()
    steps = {name: (lambda name=name: spark.read.schema(d.schema).parquet(f"{folder}/of={name}")) for name in names}
    return isolated.run_isolated(spark, "read", steps, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields))


def isolated_rows(spark, sf_dir):
    """What is read of each source, and which sources failed."""
    rows, failures = _broken_fleet(spark, sf_dir)
    return rows.groupBy("source").agg(F.count("*").alias("n")).join(failures, "source", "full").select("source", F.coalesce("n", F.lit(0)).alias("n"), F.col("error").isNotNull().alias("failed"))


def isolated_fleet(spark, sf_dir):
    """A run over all sources of which two can't be read: its report, beside the points that each source has then."""
    rows, failures = _broken_fleet(spark, sf_dir)
    held = KeyedTable.create(up.points(spark, sf_dir).select("point_id", "vector", *sync.PAYLOAD), new_path(spark, "point-table"), "point_id", 16)
    report = sync.sync_fleet(held, rows, failures, lambda missing: semantic.embed_rows(missing, up._embed, 2))
    report = materialise(report, "fleet-report")
    left = held.read().groupBy(sync.source_of(F.col("identity")).alias("source")).agg(F.count("*").alias("n_points"))
    return report.join(left, "source", "full").select("source", "embed", "rekey", "prunable", "blocked", F.col("error").isNotNull().alias("failed"), "exit_class", "n_points")


def foreign_units(spark, sf_dir):
    d = docs(spark, sf_dir)
    mode = F.when(_n() % 9 == 0, "chunk").when(_n() % 9 != 1, "whole")
    return sync.foreign_units(sync.desired_points(d, others=["doc_id"]).withColumn("unit_mode", mode)).select("identity", "unit_mode")


def _fleet(spark, sf_dir):
    """A run over all sources: one fails as a whole, some embeddings fail, some sources have integrity findings."""
    all_, points = up.planned(spark, sf_dir)
    broken = all_.filter("source = 'src3'").select("source", F.lit("unreadable").alias("error")).distinct()
    wanted = all_.join(broken, "source", "left_anti")
    plan = materialise(sync.plan_actions(wanted, points), "plan")
    number = F.split_part("identity", F.lit(":"), F.lit(3)).cast("long")
    done = plan.filter("action = 'embed'").select("identity", F.when(F.col("source").isin("src1", "src2") & (number % 2 == 0), "refused").alias("error"))
    odd = all_.filter(F.length("source") == 5).select("source", F.lit("DOMAIN_SKIP").alias("code")).distinct()
    return sync.sync_report(plan, done, sync.prune_plan(points, wanted, failed=broken), odd, broken)


def fleet_report(spark, sf_dir):
    return _fleet(spark, sf_dir).select("source", "embed", "failed", "prunable", "blocked", "n_integrity", "error", "exit_class")


def fleet_exit(spark, sf_dir):
    return sync.fleet_exit(_fleet(spark, sf_dir))


def retired_by_sources(spark, sf_dir):
    rows = up.points(spark, sf_dir).select(sync.source_of(F.col("identity")).alias("source"))
    return sync.retired_sources(rows, table(spark, sf_dir, "documents").select("source"), by="sources")


# audit, references


def amend_plan(spark, sf_dir):
    """Replacements of every third order: some equal to the commit, without a reason, without approval or not valid."""
    head, k = up.orders(spark, sf_dir), F.col("o_orderkey")
    new = head.filter("o_orderkey % 3 = 0").select("source", "path", F.when(k % 4 == 0, F.col("content")).otherwise(F.concat("content", F.lit("!"))).alias("content"), F.when(k % 5 == 0, " ").otherwise("fix").alias("reason"))
    approvals = head.filter("o_orderkey % 2 = 0").select("source", "path", F.lit("ok").alias("reason"))
    found = audit.plan_amends(new, head, approvals, head.filter("o_orderkey % 7 = 0").select("source", "path"))
    return found.select("path", F.array_join("problems", "; ").alias("problems"), F.col("canonical_git_blob_sha256").alias("blob_sha256"))


def ledger_pairing_checked(spark, sf_dir):
    """Target records against the target's commit and staged files; a seventh of them name another commit."""
    _, staged, _, ledger = up.history(spark, sf_dir)
    moved = ledger.filter("operation = 'relocate'")
    k = F.regexp_extract("old_path", r"(\d+)", 1).cast("long")
    target = moved.withColumn("head_oid", F.when(k % 7 == 0, "1" * 40).otherwise(F.col("head_oid")))
    oid = spark.createDataFrame([("s", up.OID)], "source string, oid string")
    return audit.unpaired_records(ledger, target, oid, staged).select("old_path", "side")


def ledger_v1(spark, sf_dir):
    """First records of old ledgers of six tab-separated fields; a line in eleven is too short."""
    k = F.col("o_orderkey")
    value = F.concat_ws("\t", F.lit("2024"), F.concat(F.lit("d/"), k % 97), F.lit("n"), F.concat(F.lit("b"), k % 3), F.lit("move"), F.when(k % 11 != 0, F.concat(F.lit("r"), k)))
    lines = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), k % 5).alias("source"), k.alias("line"), value.alias("value"))
    ledger = audit.read_ledger_v1(lines)
    return audit.find_records_v1(ledger, ledger.filter("line % 2 = 0").select("source", "old_path", "blob")).select("source", "line", "old_path", "blob", "reason")


def code_pointers_v1(spark, sf_dir):
    """Pointers with anchors, ellipses and words without a slash."""
    d = docs(spark, sf_dir)
    pointer = F.when(_n() % 4 == 0, F.concat(F.lit("./en/"), _n() + 1, F.lit(".md#x"))).when(_n() % 4 == 1, F.lit("a/.../b")).when(_n() % 4 == 2, F.lit("word")).otherwise(F.concat("domain", F.lit("/"), "doc_id", F.lit(".md")))
    rows = d.select("source", F.col("source_path").alias("path"), "status", F.array(pointer).alias("code"))
    return checks.code_pointers(rows, d.select("source", F.col("source_path").alias("path")), "v1").select("source", "path", "code")


def duplicate_domains_v1(spark, sf_dir):
    """Domains that several directories give: those of the trees, and the same below another root."""
    found = st.domains(spark, sf_dir)[1]
    more = found.unionByName(found.filter(F.length("dir") % 2 == 0).withColumn("dir", F.concat(F.lit("z/"), "dir")))
    return corpus.duplicate_domains_v1(more).select("source", "domain", F.array_join("dirs", ",").alias("dirs"))


# intake


def name_violations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    source = F.when(_n() % 4 == 0, F.upper("source")).otherwise(F.col("source"))
    domain = F.when(_n() % 6 == 0, "a//b").when(_n() % 6 == 1, "a/..").when(_n() % 6 == 2, " x").otherwise(F.col("lang"))
    slug = F.when(_n() % 5 == 0, "a:b").when(_n() % 5 == 1, "").when(_n() % 5 == 2, "x ").otherwise(_n().cast("string"))
    return corpus.name_violations(d.select(source.alias("source"), domain.alias("domain"), slug.alias("slug"), _n().cast("string").alias("path"))).select("path", "code", "field")


def index_kinds(spark, sf_dir):
    rows = docs(spark, sf_dir).select("source", F.col("source_path").alias("path"), "kind", (_n() % 4 == 0).alias("is_domain_index"))
    return corpus.index_kind_violations(rows).select("source", "path", "code")


def legacy_docs(spark, sf_dir):
    parsed = conform.parse_headers(conform.with_envelope(notes(spark, sf_dir)), "v1")
    out = compile_.compile_legacy(corpus.legacy_notes(parsed))
    return out.select("identity", "title", "description", F.array_join("keywords", ",").alias("keywords"), F.sha2("body_text", 256).alias("body_sha256"))


def keyword_folds(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("keywords", F.when(_n() % 5 != 0, F.array(F.upper("domain"), F.concat(F.lit("KEY"), _n() % 3))))
    return compile_.fold_keywords(d).select("identity", F.array_join("tags", ",").alias("tags"))


def commit_times(spark, sf_dir):
    """The last commit of each note; every seventh was never committed."""
    good = st.compiled_rows(spark, sf_dir).filter("bad is null")
    log = good.filter("doc_id % 7 <> 0").select("source", "path", F.explode(F.array(F.concat(F.lit("2024-01-0"), _n() % 9 + 1), F.lit("2023-12-31"))).alias("commit_time"))
    return compile_.compile_notes(good, log).select("identity", "commit_time")


def scanned_paths(spark, sf_dir):
    """Files that a scan takes: exact ``.md`` outside hidden and built directories."""
    p = paths(spark, sf_dir)
    n = F.length("path")
    odd = F.when(n % 5 == 0, F.concat(F.lit("node_modules/"), "path")).when(n % 5 == 1, F.concat(F.lit(".git/x/"), "path")).when(n % 5 == 2, F.regexp_replace("path", r"md\z", "MD")).otherwise(F.col("path"))
    return note_trees.prune(p.select("source", odd.alias("path")))


def old_artifacts(spark, sf_dir):
    """Documents as old artifact rows of two profiles, written and read for one of them."""
    d, path = docs(spark, sf_dir), new_path(spark, "artifacts")
    rows = d.select(
        F.col("identity").alias("object_key"), F.col("source").alias("repo"), F.when(_n() % 2 == 0, "main").otherwise("other").alias("index_profile"), F.lit("a1").alias("artifact_schema"),
        F.struct(F.when(_n() % 3 != 0, F.concat(F.lit("t"), "doc_id")).otherwise("").alias("title"), F.col("body_text").alias("body")).alias("lexical_projection"),
        F.struct(F.concat(F.lit("m"), "doc_id").alias("title"), F.col("source_path").alias("path")).alias("metadata_projection"),
    )
    rows.write.json(path)
    return ndjson.read_artifacts(spark, path, "main", "a1").select("repo", "object_key", "title", F.sha2("body", 256).alias("body_sha256"), "path")


def persisted_sources(spark, sf_dir):
    """Documents by source, then a second write of some sources only: the others stay."""
    d, path = docs(spark, sf_dir), new_path(spark, "by-source")
    ndjson.write_by_source(d, path)
    ndjson.write_by_source(d.filter("length(source) = 4 and doc_id % 2 = 0"), path)
    return spark.read.schema(d.schema).parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def recent_faults(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("event_type").alias("verb"), F.when(F.col("value") > 100, 1).otherwise(0).alias("exit_code"), "ts", F.col("event_id").cast("string").alias("message"))
    return telemetry.recent_faults(calls).select("verb", F.col("message").alias("event_id"), "n")


QUERIES = {f.__name__: f for f in (narrowed_search, unknown_sources, knn_managed, knn_depth, knn_narrowed, old_collections, recall_lexical, recall_semantic, lane_health, recall_enriched, written_hits, gold_violations, gold_drift, gold_fixture, fixture_digest, baseline_binding, hybrid_gates, gates_pass, foreign_units, paged_points, isolated_rows, isolated_fleet, fleet_report, fleet_exit, retired_by_sources, amend_plan, ledger_pairing_checked, ledger_v1, code_pointers_v1, duplicate_domains_v1, name_violations, index_kinds, legacy_docs, keyword_folds, commit_times, scanned_paths, old_artifacts, persisted_sources, recent_faults)}

_ASKED = "asking AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'src' || (item_id % 25) END AS asked FROM benchmark)"
_MARKED = "marked AS (SELECT vec_id, label, 's' || label || ':' || vec_id AS identity, embedding FROM embeddings)"
_PAIRS = f"WITH {_MARKED}, s AS (SELECT q.vec_id AS query_id, p.*, list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS score FROM embeddings q, marked p WHERE q.vec_id % 50 = 0)"


def _within(ties: str) -> str:
    """SQL of the 50 nearest points of each query."""
    return f"{_PAIRS}, near AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {ties}) <= 50)"


_HYBRID = f"""SELECT * FROM (SELECT query_id, source, identity, lexical_rank, semantic_rank, coalesce(wl::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0){r.TIER_SQL} AS raw
  FROM ra FULL JOIN rb USING (query_id, source, identity) JOIN w USING (query_id) JOIN (SELECT source, identity, CASE WHEN doc_id % 13 <> 0 THEN kind END AS kind FROM docs) USING (source, identity)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, source, identity) <= {K}"""
_BODY6 = """CASE doc_id % 6 WHEN 0 THEN content WHEN 1 THEN content ELSE body END"""
_FLEET = f"""{up.SYNC_SQL}, fp AS (SELECT * FROM plan WHERE source <> 'src3'), fprune AS (SELECT source, identity FROM own WHERE source IN (SELECT source FROM wanted WHERE source <> 'src3') AND identity NOT IN (SELECT identity FROM wanted)),
  fsum AS (SELECT source, count(*) AS n_stale FROM fprune GROUP BY 1), fall AS (SELECT source, count(*) AS n_points FROM own GROUP BY 1),
  fcut AS (SELECT source, CASE WHEN n_stale > 0.5 * n_points THEN 0 ELSE n_stale END AS prunable, CASE WHEN n_stale > 0.5 * n_points THEN n_stale ELSE 0 END AS blocked FROM fsum JOIN fall USING (source)),
  fact AS (SELECT source, count(*) FILTER (action = 'embed') AS embed, count(*) FILTER (action = 'embed' AND source IN ('src1', 'src2') AND split_part(identity, ':', 3)::BIGINT % 2 = 0) AS failed FROM fp GROUP BY 1),
  fleet AS (SELECT source, coalesce(embed, 0)::BIGINT AS embed, coalesce(failed, 0)::BIGINT AS failed, coalesce(prunable, 0)::BIGINT AS prunable, coalesce(blocked, 0)::BIGINT AS blocked, CASE WHEN length(source) = 5 AND source IN (SELECT source FROM wanted) THEN 1 ELSE 0 END::BIGINT AS n_integrity, CASE WHEN source = 'src3' THEN 'unreadable' END AS error
    FROM (SELECT DISTINCT source FROM wanted) FULL JOIN fact USING (source) FULL JOIN fcut USING (source)),
  classed AS (SELECT *, CASE WHEN failed > 0 OR error IS NOT NULL THEN 1 WHEN blocked > 0 THEN 2 WHEN n_integrity > 0 THEN 3 ELSE 0 END AS exit_class FROM fleet)"""
_AMEND = """concat_ws('; ', CASE WHEN NOT frozen THEN 'note is not frozen in HEAD' END, CASE WHEN k % 7 = 0 THEN 'replacement is not a valid note' END, CASE WHEN k % 4 = 0 THEN 'replacement equals the commit' END,
  CASE WHEN k % 5 = 0 THEN 'reason must be one non-empty line' END, CASE WHEN k % 2 <> 0 THEN 'file has no approval' END)"""
ORACLE_SQL = {
    "narrowed_search": f"{r.V1_SQL}, {_ASKED}, kept AS (SELECT v1.* FROM v1 JOIN asking USING (query_id) WHERE asked IS NULL OR asked = source) {r.search_sql('kept', K)}",
    "unknown_sources": f"WITH {_ASKED} SELECT query_id, asked AS source FROM asking WHERE asked IS NOT NULL AND asked NOT IN (SELECT source FROM documents)",
    "knn_managed": f"{_PAIRS} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, round(score, 5) AS score FROM s WHERE vec_id % 5 <> 0 AND vec_id % 7 <> 0 AND vec_id % 11 <> 0 QUALIFY rank <= {K}",
    "knn_depth": f"{_within('label, vec_id')} SELECT query_id, label, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, label, vec_id) AS rank, round(s2, 5) AS score FROM (SELECT *, score AS s2 FROM near QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) = 1) QUALIFY rank <= {K}",
    "knn_narrowed": f"{_within('identity')} SELECT query_id, identity, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identity) AS rank, round(score, 5) AS score FROM near WHERE query_id % 100 <> 0 OR label = query_id // 50 % 10 QUALIFY rank <= {K}",
    "old_collections": f"{_PAIRS} SELECT query_id, identity, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identity) AS rank, round(score, 5) AS score FROM s QUALIFY rank <= {K}",
    "recall_lexical": f"{r.LANES_SQL} SELECT query_id, source, identity, round(wl::DOUBLE / (60 + lexical_rank), 9) AS score, lexical_rank, NULL::INT AS semantic_rank, lexical_rank AS rank FROM ra JOIN w USING (query_id) WHERE lexical_rank <= {K}",
    "recall_semantic": f"{r.LANES_SQL} SELECT query_id, source, identity, round(1.0::DOUBLE / (60 + semantic_rank), 9) AS score, NULL::INT AS lexical_rank, semantic_rank, semantic_rank AS rank FROM rb WHERE semantic_rank <= {K}",
    "lane_health": f"{r.LANES_SQL}, n AS (SELECT query_id, least(count(*), {K}) AS n FROM ra GROUP BY 1) SELECT item_id AS query_id, CASE WHEN n IS NULL THEN 'empty' ELSE 'ok' END AS status, false AS semantic_on, 'fresh' AS freshness, coalesce(n, 0)::BIGINT AS n_hits FROM benchmark LEFT JOIN n ON item_id = query_id",
    "recall_enriched": rf"{r.LANES_SQL}, h AS ({_HYBRID}) SELECT query_id, identity, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, h.source, identity) AS rank, round(round(raw, 9), 6) AS score, title, '/data/' || d.source || '/' || source_path AS abs_path, status, kind, length(d.source) > 4 AS legacy, doc_id % 4 = 0 AS is_raw, false AS is_unverified, left(trim(regexp_replace(body_text, '\s+', ' ', 'g')), 160) AS preview, semantic_rank IS NOT NULL OR doc_id % 3 = 0 AS semantic_indexed FROM h JOIN docs d USING (identity)",
    "written_hits": f"{r.V1_SQL}, h AS ({r.search_sql('v1', K)}) SELECT query_id, rank, identity, length(concat_ws(chr(10) || chr(10), nullif(trim(title), ''), trim(description), nullif(trim(body_text), '')))::INT AS n_chars, false AS truncated FROM h JOIN docs USING (source, identity)",
    "gold_violations": "SELECT item_id AS line, unnest(CASE item_id % 9 WHEN 1 THEN ['GOLD-FIXTURE'] WHEN 2 THEN ['GOLD-EMPTY'] WHEN 3 THEN ['GOLD-KEY'] WHEN 4 THEN ['GOLD-SOURCE'] WHEN 5 THEN ['GOLD-FIELDS', 'GOLD-EMPTY'] ELSE [] END) AS code FROM benchmark",
    "gold_drift": "SELECT DISTINCT source || ':' || lang || ':' || (doc_id + 1) AS gold_key FROM documents WHERE source || ':' || lang || ':' || (doc_id + 1) NOT IN (SELECT source || ':' || lang || ':' || doc_id FROM documents)",
    "gold_fixture": "SELECT count(*) AS n, 64 AS hash_chars FROM benchmark",
    "hybrid_gates": f"{r.EVAL_SQL} SELECT s2.slice, s2.gold_at_10 AS value, greatest(s1.gold_at_10, s2.gold_at_10) AS best, s1.gold_at_10 AS floor, s2.gold_at_10 >= greatest(s1.gold_at_10, s2.gold_at_10) - 0.01 AND s2.gold_at_10 >= s1.gold_at_10 - 0.01 AS ok FROM s2 JOIN s1 USING (slice)",
    "gates_pass": f"{r.EVAL_SQL} SELECT coalesce(bool_and(s2.gold_at_10 >= greatest(s1.gold_at_10, s2.gold_at_10) - 0.01), true) AS ok FROM s2 JOIN s1 USING (slice)",
    "fixture_digest": """SELECT sha256(string_agg(h, '' ORDER BY h)) AS fixture_hash, count(*) AS n FROM (SELECT sha256(to_json({'_slice': 's', 'fixture_id': 'fx', 'gold_key': 's:d:' || item_id, 'qtype': 't', 'query': coalesce(text, '')})) AS h FROM benchmark)""",
    "baseline_binding": "SELECT * FROM (VALUES ('own', ''), ('other rows', CASE WHEN (SELECT count(*) FROM benchmark WHERE item_id = 0) > 0 THEN 'BASELINE-HASH' ELSE '' END), ('other fixture', 'BASELINE-FIXTURE,BASELINE-HASH,BASELINE-LANE')) t(baseline, codes)",
    "paged_points": f"{up.SYNC_SQL} SELECT split_part(p.identity, ':', 1) AS source, p.identity, lang || '/' || doc_id || '.md' AS source_path FROM points p JOIN th USING (doc_id)",
    "isolated_rows": f"SELECT source, CASE WHEN source IN {_BROKEN} THEN 0 ELSE count(*) END AS n, source IN {_BROKEN} AS failed FROM documents WHERE doc_id % 11 <> 0 GROUP BY source",
    "isolated_fleet": f"""{up.SYNC_SQL}, seen AS (SELECT * FROM plan WHERE source NOT IN {_BROKEN}),
        gone AS (SELECT * FROM prune WHERE source NOT IN {_BROKEN}),
        per AS (SELECT source, count(*) FILTER (action = 'embed') AS embed, count(*) FILTER (action = 'rekey') AS rekey FROM seen GROUP BY 1),
        pr AS (SELECT source, count(*) FILTER (allowed) AS prunable, count(*) FILTER (NOT allowed) AS blocked FROM gone GROUP BY 1),
        bad AS (SELECT DISTINCT source FROM wanted WHERE source IN {_BROKEN}),
        rep AS (SELECT source, coalesce(embed, 0) AS embed, coalesce(rekey, 0) AS rekey, coalesce(prunable, 0) AS prunable, coalesce(blocked, 0) AS blocked, bad.source IS NOT NULL AS failed,
                CASE WHEN bad.source IS NOT NULL THEN 1 WHEN blocked > 0 THEN 2 ELSE 0 END AS exit_class FROM per FULL JOIN pr USING (source) FULL JOIN bad USING (source)),
        now AS (SELECT source, count(*) AS n_points FROM (SELECT split_part(identity, ':', 1) AS source, identity FROM points WHERE identity NOT IN (SELECT identity FROM gone WHERE allowed) UNION SELECT source, identity FROM seen) GROUP BY 1)
        SELECT source, embed, rekey, prunable, blocked, coalesce(failed, false) AS failed, exit_class, n_points FROM rep FULL JOIN now USING (source)""",
    "foreign_units": f"WITH {DOCS_SQL} SELECT identity, CASE WHEN doc_id % 9 = 0 THEN 'chunk' END AS unit_mode FROM docs WHERE doc_id % 9 < 2",
    "fleet_report": f"{_FLEET} SELECT source, embed, failed, prunable, blocked, n_integrity, error, exit_class FROM classed",
    "fleet_exit": f"{_FLEET} SELECT coalesce(CASE WHEN bool_or(exit_class = 1) THEN 1 WHEN bool_or(exit_class = 2) THEN 2 WHEN bool_or(exit_class = 3) THEN 3 END, 0) AS exit_class FROM classed",
    "retired_by_sources": f"{up.SYNC_SQL}, n AS (SELECT source, count(*) AS n_rows FROM own GROUP BY 1), g AS (SELECT * FROM n WHERE source NOT IN (SELECT source FROM documents)) SELECT source, n_rows, NOT (SELECT count(*) FROM g) > 0.5 * (SELECT count(*) FROM n) AS allowed FROM g",
    "amend_plan": f"WITH {up.HEAD_SQL}, x AS (SELECT *, CASE WHEN k % 4 = 0 THEN content ELSE content || '!' END AS new FROM head WHERE k % 3 = 0) SELECT path, {_AMEND} AS problems, sha256(encode('blob ' || octet_length(encode(new))) || '\\x00'::BLOB || encode(new)) AS blob_sha256 FROM x",
    "ledger_pairing_checked": f"WITH {up.HEAD_SQL}, rec AS (SELECT * FROM c WHERE recorded) SELECT path AS old_path, 'source' AS side FROM rec WHERE status = 'M' UNION ALL SELECT path, 'target head' FROM rec WHERE status <> 'M' AND k % 7 = 0 UNION ALL SELECT path, 'target blob' FROM rec WHERE status <> 'M' AND NOT right_blob",
    "ledger_v1": "WITH l AS (SELECT 's' || (o_orderkey % 5) AS source, o_orderkey AS line, 'd/' || (o_orderkey % 97) AS old_path, 'b' || (o_orderkey % 3) AS blob, 'r' || o_orderkey AS reason FROM orders WHERE o_orderkey % 11 <> 0) SELECT * FROM l WHERE (source, old_path, blob) IN (SELECT (source, old_path, blob) FROM l WHERE line % 2 = 0) QUALIFY row_number() OVER (PARTITION BY source, old_path, blob ORDER BY line) = 1",
    "code_pointers_v1": f"WITH {DOCS_SQL} SELECT source, source_path AS path, CASE WHEN doc_id % 4 = 1 THEN 'V1-CODE-ELLIPSIS' ELSE 'KBV2-CODE-BROKEN' END AS code FROM docs WHERE coalesce(status, '') <> 'frozen' AND (doc_id % 4 = 1 OR (doc_id % 4 = 0 AND (source, 'en/' || (doc_id + 1) || '.md') NOT IN (SELECT (source, source_path) FROM docs)))",
    "duplicate_domains_v1": f"WITH {PATHS_SQL}, m AS (SELECT source, dir, domain FROM dom UNION ALL SELECT source, 'z/' || dir, domain FROM dom WHERE length(dir) % 2 = 0) SELECT source, domain, string_agg(dir, ',' ORDER BY dir) AS dirs FROM m GROUP BY 1, 2 HAVING count(*) >= 2",
    "name_violations": "SELECT doc_id::VARCHAR AS path, 'INVALID-SOURCE' AS code, 'source' AS field FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id::VARCHAR, 'INVALID-DOMAIN', 'domain' FROM documents WHERE doc_id % 6 < 3 UNION ALL SELECT doc_id::VARCHAR, 'INVALID-SLUG', 'slug' FROM documents WHERE doc_id % 5 < 3",
    "index_kinds": f"WITH {DOCS_SQL} SELECT source, source_path AS path, 'KBV2-INDEX-KIND' AS code FROM docs WHERE doc_id % 4 = 0 AND kind <> 'index'",
    "legacy_docs": rf"WITH {NOTES_SQL}, b AS (SELECT *, trim(regexp_replace({_BODY6}, '\r\n?', chr(10), 'g'), chr(10)) AS t FROM notes) SELECT source || ':legacy:' || lang || '/' || doc_id AS identity, CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <> 1 THEN 'Title ' || doc_id ELSE doc_id::VARCHAR END AS title, 'Legacy source, not verified.' || CASE doc_id % 6 WHEN 2 THEN ' first' WHEN 3 THEN ' ' WHEN 5 THEN ' it''''s ok' ELSE '' END AS description, CASE doc_id % 6 WHEN 2 THEN 'a,b,' WHEN 4 THEN 'x,' WHEN 5 THEN 'a,' ELSE '' END || 'legacy,raw,unverified' AS keywords, sha256('> Legacy source, not verified.' || CASE WHEN t <> '' THEN chr(10) || chr(10) || t ELSE '' END) AS body_sha256 FROM b",
    "keyword_folds": f"WITH {DOCS_SQL} SELECT identity, CASE WHEN doc_id % 5 <> 0 THEN domain || ',key' || (doc_id % 3) ELSE '' END AS tags FROM docs",
    "commit_times": "SELECT source || ':' || lang || ':' || doc_id AS identity, CASE WHEN doc_id % 7 <> 0 THEN '2024-01-0' || (doc_id % 9 + 1) END AS commit_time FROM documents WHERE doc_id % 6 = 2",
    "scanned_paths": f"WITH {PATHS_SQL} SELECT source, path FROM files WHERE length(path) % 5 > 2",
    "old_artifacts": f"WITH {DOCS_SQL} SELECT source AS repo, identity AS object_key, CASE WHEN doc_id % 3 <> 0 THEN 't' ELSE 'm' END || doc_id AS title, sha256(body_text) AS body_sha256, source_path AS path FROM docs WHERE doc_id % 2 = 0",
    "persisted_sources": "SELECT source, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE length(source) <> 4 OR doc_id % 2 = 0 OR source NOT IN (SELECT source FROM documents WHERE doc_id % 2 = 0) GROUP BY 1",
    "recent_faults": "SELECT event_type AS verb, event_id::VARCHAR AS event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id::VARCHAR) AS n FROM events WHERE coalesce(event_type, '') <> '' AND value > 100 QUALIFY n <= 5",
}
