"""Rules as columns: each gives a diagnostic or null; rows without any disappear."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "struct<code:string,severity:string,field:string,message:string>"


def diagnostic(code: str, field: str | Column | None, message: str | Column, when: Column, severity: str = "error") -> Column:
    """The diagnostic where ``when`` holds; a struct with a null code elsewhere."""
    field = F.lit(field) if field is None or isinstance(field, str) else field
    message = F.lit(message) if isinstance(message, str) else message
    hit = F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), field.cast("string").alias("field"), message.alias("message"))
    return F.when(F.coalesce(when, F.lit(False)), hit).otherwise(F.from_json(F.lit("{}"), TYPE))


def only_hits(rules: Column) -> Column:
    return F.filter(rules, lambda d: d["code"].isNotNull())
