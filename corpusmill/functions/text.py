"""Column functions on text: line ends, hashes, identifiers, prefixes, Unicode folding."""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ASCII = r"^[\x00-\x7F]*$"
#: Default name space of point ids; a data set that already has ids passes its own.
POINT_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "corpusmill:point-id:v1")


def normalize_lf(text: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def body_text(text: Column) -> Column:
    """Line ends normalised, LF trimmed at both ends and nothing else."""
    return F.regexp_replace(normalize_lf(text), r"\A\n+|\n+\z", "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def source_hash(original: Column) -> Column:
    return sha256_hex(normalize_lf(original))


def blob_sha256(content: Column) -> Column:
    """SHA-256 of ``blob <length>\\0`` and the bytes."""
    raw = content.cast("binary")
    return F.sha2(F.concat(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")).cast("binary"), F.unhex(F.lit("00")), raw), 256)


def title_of(body: Column, stem: Column) -> Column:
    """Text of the first line that is ``#``, space or tab, and some text; else the file stem."""
    found = F.regexp_extract(body, r"(?m)^#[ \t]+[ \t]*([^ \t\n][^\n]*)$", 1)
    return F.coalesce(F.nullif(F.regexp_replace(found, r"[ \t]+\z", ""), F.lit("")), stem)


def embedding_text(description: Column, keywords: Column, body: Column) -> Column:
    """Non-empty ones of description, keywords and body, trimmed, joined by a blank line; never the title."""
    trimmed = [F.regexp_replace(F.coalesce(c, F.lit("")), r"\A\s+|\s+\z", "") for c in (description, F.array_join(keywords, " "), body)]
    return F.array_join(F.filter(F.array(*trimmed), lambda x: x != ""), "\n\n")


def prefixes(path: Column, separator: str = "/") -> Column:
    """``a/b`` -> [``a``, ``a/b``]; an empty path has none."""
    parts = F.split(path, F.lit(f"\\Q{separator}\\E"))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator)))


def ancestors(directory: Column) -> Column:
    """The directory and all above it, the root ``''`` first."""
    return F.concat(F.array(F.lit("")), prefixes(directory))


def point_id(identity: Column, unit_mode: str = "whole", namespace: uuid.UUID = POINT_NAMESPACE) -> Column:
    """UUID version 5 of ``identity:unit_mode``."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.concat(identity, F.lit(f":{unit_mode}")).cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 8))
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).casefold()))


def _beyond_ascii(text: Column, plain: Column, udf) -> Column:
    """Python sees only what isn't ASCII."""
    ascii_ = text.rlike(ASCII)
    return F.when(ascii_, plain).otherwise(udf(F.when(~ascii_, text)))


def nfc(text: Column) -> Column:
    return _beyond_ascii(text, text, _nfc)


def fold(text: Column) -> Column:
    """NFC and full case folding; the built-in collations don't equate all that it does."""
    return _beyond_ascii(text, F.lower(text), _fold)


def stem(path: Column) -> Column:
    """File name without ``.md``."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.md\z", "")


def directory(path: Column) -> Column:
    """Path without its last segment; ``''`` at the root."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def collapse(text: Column) -> Column:
    """White space trimmed, and each run of it one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug_tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


#: The ranges of CJK ideographs that the planner counts.
CJK_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2F800, 0x2FA1F))
CJK = "[" + "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in CJK_RANGES) + "]"
MAX_TOKEN = 40


def natural_tokens(text: Column, lexicon: frozenset[str] | None = None, longest: int = 3) -> Column:
    """Words in lower case, at most 40 characters each; runs of CJK ideographs as overlapping n-grams.

    Without a lexicon every 2- to ``longest``-gram of a run is a token (a run of one stands alone). With one (a small
    set of terms), the grams in it are kept, of any length up to ``longest``, and ideographs no kept gram covers stand
    alone."""
    word = F.regexp_extract_all(F.lower(text), F.lit(rf"({CJK}+|[\p{{L}}\p{{N}}&&[^{CJK[1:-1]}]]+)"), 1)
    grams = lambda run: F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(longest), F.length(run)))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - n + 1)), lambda i: run.substr(i, n))))
    if lexicon is None:
        cut = lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(grams(run))
    else:
        known = F.array(*map(F.lit, sorted(lexicon))) if lexicon else F.array().cast("array<string>")
        hits = lambda run: F.filter(grams(run), lambda g: F.array_contains(known, g))
        single = lambda run, kept: F.filter(F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: run.substr(i, F.lit(1))), lambda c: ~F.exists(kept, lambda g: F.contains(g, c)))
        cut = lambda run: F.concat(hits(run), single(run, hits(run)))
    tokens = F.flatten(F.transform(word, lambda w: F.when(w.rlike(rf"^{CJK}"), cut(w)).otherwise(F.array(w))))
    tokens = F.when(text.rlike(CJK), tokens).otherwise(slug_tokens(text))  # most texts have no run to cut
    return F.filter(tokens, lambda t: F.length(t) <= MAX_TOKEN)
