"""BM25 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
DIGITS = 6  #: scores are rounded to these before they are ranked
EXACT = 17  #: significant digits of a text that reads back as the same number


def idf(n_docs: Column, df: Column) -> Column:
    """``ln((N - n + 0.5) / (n + 0.5) + 1)``, above 0 for every n."""
    return F.log((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def bm25(n_docs: Column, df: Column, tf: Column, length: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """The score of one query token for one document; 0 for a term frequency of 0."""
    norm = tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / avgdl)
    return F.when(tf == 0, F.lit(0.0)).otherwise(idf(n_docs, df) * tf * F.lit(k1 + 1) / norm)


def as_text(score: Column, digits: int = 6) -> Column:
    """Six significant digits, or as many as ``digits``, without trailing zeros."""
    shown = F.regexp_replace(F.format_string(f"%.{digits}g", score), r"([.][0-9]*?)0+(e|$)", "$1$2")
    return F.regexp_replace(shown, r"[.](e|$)", "$1")
