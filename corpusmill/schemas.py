"""Schemas of the tables that the operators exchange."""

DOCS = (
    "schema string, identity string, source string, domain string, domain_prefixes array<string>, title string, description string, "
    "keywords array<string>, kind string, kind_explicit boolean, status string, body_text string, source_path string, "
    "source_hash string, compiled_hash string, commit_time string"
)
DOC_COLUMNS = [part.split()[0] for part in DOCS.split(", ")]
DOC_SCHEMA = "knowledge-doc-v2"
DIAGNOSTICS = "source string, code string, severity string, path string, field string, message string"
LEDGER = (
    "schema string, operation string, logical_source string, old_identity string, new_identity string, old_path string, "
    "new_path string, head_oid string, canonical_git_blob_sha256 string, reason string"
)
LEDGER_COLUMNS = [part.split()[0] for part in LEDGER.split(", ")]
GOLD = "fixture_id string, query string, gold_key string, qtype string, _slice string"
FIELD_VALUES = "map<string,struct<type:string,scalar:string,items:array<string>>>"
