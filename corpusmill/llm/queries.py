"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, decontaminate, exact_dedup, merkle, near_dedup, passage_dedup, quality, suffix_dedup, token_counts, token_files, warc
from .store import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), out, tokenizer("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, out)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats_and_count_passages(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.conversation_digests(chat.written(chat.format_conversations(rows)))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(merkle.build(table(spark, sf_dir, "documents"), {"text": merkle.tampered_text()}))


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.remove_passages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality": op2_quality,
    "op3_token_files": op3_token_files,
    "op4_token_counts": op4_token_counts,
    "op5_warc": op5_warc,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_bpe": op8_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_chat": op10_chat,
    "op11_centroids": op11_centroids,
    "op12_merkle": op12_merkle,
    "op13_passages": op13_passages,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _centroid_round(i: int) -> str:
    """Common table expressions of one round: a assigns vectors to the centroids c, m sums them, and the next c follows."""
    return f"""
        a{i} AS MATERIALIZED (SELECT r, any_value(q) AS q, arg_min(cluster, d * 1000 + cluster) AS cluster
            FROM (SELECT r, q, cluster, list_sum(list_transform(range(1, 65), lambda j: (q[j] - c[j]) * (q[j] - c[j]))) AS d FROM v, c{i}) GROUP BY r),
        m{i} AS (SELECT cluster, j, sum(q[j]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS j) GROUP BY cluster, j),
        c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(any_value(moved), any_value(c)) AS c FROM c{i}
            LEFT JOIN (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS moved FROM m{i} GROUP BY cluster) USING (cluster) GROUP BY cluster)"""


def _leaf(text: str) -> str:
    framed = (f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(framed)})"


_LOWER_OR_NULL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The checksum bit by bit, as DuckDB has no function for it.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""

ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS owner FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND owner <> page_id THEN owner END AS refers_to
        FROM q""",
    "op10_chat": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        t AS (SELECT *, 9 + length(role) + length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
                     + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS chars FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op9_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op7_decontaminate": rf"""
        WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        bw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bwin AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
                 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM bwin),
        dwin AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
                 FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, i, n, item_id FROM dwin JOIN bwin USING (n, g)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_centroids": f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND coalesce(isfinite(x), false)))),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS cluster, q AS c FROM v QUALIFY cluster < 16),
        {','.join(_centroid_round(i) for i in range(3))},
        a AS (SELECT r, arg_min(cluster, d * 1000 + cluster) AS cluster, min(d) AS d
            FROM (SELECT r, cluster, list_sum(list_transform(range(1, 65), lambda j: (q[j] - c[j]) * (q[j] - c[j]))) AS d FROM v, c3) GROUP BY r)
        SELECT vec_id, cluster::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
               sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a JOIN v USING (r) JOIN c3 USING (cluster)""",
    "op12_merkle": f"""
        WITH RECURSIVE l AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS k, {_leaf('text')} AS leaf,
            CASE WHEN {_CRC32} % 5 = 0 THEN {_leaf(_LOWER_OR_NULL)} ELSE {_leaf('text')} END AS altered FROM documents),
        p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
        t AS (SELECT k, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY k) AS n FROM p
              UNION ALL
              SELECT k, lvl + 1, run, h, count(*) OVER (PARTITION BY k) FROM (SELECT k, lvl, pos // 16 AS run, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM t WHERE n > 1 GROUP BY k, lvl, pos // 16)),
        sub AS MATERIALIZED (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos FROM t WHERE n = 1),
        u AS (SELECT 100 AS lvl, pos, subroot AS h, count(*) OVER () AS n FROM sub
              UNION ALL
              SELECT lvl + 1, run, h, count(*) OVER () FROM (SELECT lvl, pos // 16 AS run, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM u WHERE n > 1 GROUP BY lvl, pos // 16)),
        root AS (SELECT h AS root FROM u WHERE n = 1),
        runs AS MATERIALIZED (SELECT k, lvl, pos // 16 AS run, string_agg(h, '' ORDER BY pos) AS hs FROM t WHERE n > 1 GROUP BY ALL
              UNION ALL SELECT NULL, lvl, pos // 16, string_agg(h, '' ORDER BY pos) FROM u WHERE n > 1 GROUP BY ALL),
        seg AS (SELECT r, lvl, left(hs, 64 * (node % 16)) AS b, substr(hs, 64 * (node % 16) + 65) AS a
              FROM (SELECT r, lvl, hs, pos // (16 ** lvl)::BIGINT AS node FROM p JOIN runs ON p.k = runs.k AND runs.run = pos // (16 ** (lvl + 1))::BIGINT
                    UNION ALL SELECT r, lvl, hs, sub.pos // (16 ** (lvl - 100))::BIGINT FROM p JOIN sub ON p.k = sub.k JOIN runs ON runs.k IS NULL AND runs.run = sub.pos // (16 ** (lvl - 99))::BIGINT)),
        proofs AS (SELECT r, string_agg(b || a, '' ORDER BY lvl) AS proof, list(b || '.' || a ORDER BY lvl) AS segs FROM seg GROUP BY r)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256,
               list_reduce(list_concat([altered], coalesce(segs, [])), lambda h, s: sha256(replace(s, '.', h))) AS folded_root,
               list_reduce(list_concat([altered], coalesce(segs, [])), lambda h, s: sha256(replace(s, '.', h))) = root AS verified
        FROM p JOIN sub USING (k) LEFT JOIN proofs USING (r), root""",
    "op13_passages": r"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT r, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
        later AS (SELECT r, i FROM g QUALIFY row_number() OVER (PARTITION BY h ORDER BY r, i) > 1),
        edges AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM later),
        gone AS (SELECT DISTINCT r, unnest(range(greatest(i, coalesce(p + 20, 0)), i + 20)) AS j FROM edges),
        lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
        runs AS (SELECT r, count(*) FILTER (p IS NULL OR i > p + 20) AS n FROM edges GROUP BY r),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS t FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN gone USING (r, j) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(runs.n, 0)::BIGINT AS n_passages
        FROM d LEFT JOIN lost USING (r) LEFT JOIN runs USING (r) LEFT JOIN kept USING (r)""",
}
