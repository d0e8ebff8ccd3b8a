"""Helpers that the corpus operators share: word rules, Arrow batches, copies of rows and, from the library, staged tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Scratch, shared_dir, staged

__all__ = ["WORD", "Scratch", "ascii_lower", "bounded_batches", "copied", "documents", "shared_dir", "slices", "staged", "word_count"]

#: A word of the corpus contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
PIECE = 8192  #: copies of a row that one task row expands to


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let the session hand texts to Python in batches of ``most`` bytes or so, unless it is set to fewer: the default of 64 MB is held several times over."""
    if int(spark.conf.get(BATCH_BYTES).rstrip("b")) > most:
        spark.conf.set(BATCH_BYTES, str(most))


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` whose ``column`` (text or binary) holds about ``most`` bytes; a longer value stands alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for k, n in enumerate(size.tolist()):
        if k > at and held + n > most:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if at < len(size):
        yield batch.slice(at)


def copied(rows: DataFrame, n: str, nth: str) -> DataFrame:
    """Each row ``n`` times, numbered ``nth`` from 0. A row of many copies is cut into pieces that are dealt out first."""
    piece = F.explode(F.expr(f"sequence(0L, ({n} - 1) div {PIECE})"))
    few = rows.filter(F.col(n) <= PIECE).withColumn(nth, F.explode(F.expr(f"sequence(0L, {n} - 1)")))
    many = rows.filter(F.col(n) > PIECE).withColumn("__piece", piece).repartition("__piece")
    many = many.withColumn(nth, F.explode(F.expr(f"sequence(__piece * {PIECE}, least({n}, (__piece + 1) * {PIECE}) - 1)"))).drop("__piece")
    return few.unionByName(many)
