"""Tokens and snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9]+"
SNIPPET = 500


def tokenize(text: Column | str) -> Column:
    """Runs of ASCII letters and digits, lower-cased after they are found, so that no other character turns into one of them. Null: no tokens."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda x: F.lower(x))


def tokens_of(query: str) -> list[str]:
    """The same tokens on the driver, for a query string."""
    return [t.lower() for t in re.findall(TOKEN, query)]


def snippet(text: Column, width: int = SNIPPET) -> Column:
    """The first ``width`` characters; a longer text is marked."""
    return F.when(F.char_length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit("... [truncated]"))).otherwise(text)


def register(spark: SparkSession) -> None:
    """Make ``tokenize(text)`` a function of SQL that Catalyst can see into."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tokenize(t STRING) RETURNS ARRAY<STRING> RETURN transform(regexp_extract_all(coalesce(t, ''), '{TOKEN}', 0), x -> lower(x))")
