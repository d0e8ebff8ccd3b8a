"""Places of rows among those of the same key.

Buckets of the order are counted, and what is found within a bucket is shifted by the count of those before it, so that a frequent key is
not sorted or collected in one task. Keys and buckets must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SEGMENT = 1 << 20  #: rows of a segment, about


def shifted(rows: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """``rows`` with ``__o``: how many rows of the same ``keys`` smaller buckets hold."""
    counts = rows.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    return rows.join(counts.select(*keys, bucket, F.coalesce(before, F.lit(0)).alias("__o")), [*keys, bucket])


def placed(rows: DataFrame, keys: list[str], bucket: Column, *order: str) -> DataFrame:
    """``rows`` with ``place``, from 0, among those of the same ``keys`` by ``order``, along which ``bucket`` never falls."""
    rows = rows.withColumn("__b", bucket).withColumn("__n", F.row_number().over(W.partitionBy(*keys, "__b").orderBy(*order)) - 1)
    return shifted(rows, keys, "__b").withColumn("place", F.col("__o") + F.col("__n")).drop("__b", "__n", "__o")


def segmented(rows: DataFrame, keys: list[str], bucket: Column, size: int = SEGMENT) -> DataFrame:
    """``rows`` with ``segment``, from 0: whole buckets one after the other, ``size`` rows of a key and one bucket more at most."""
    rows = shifted(rows.withColumn("__b", bucket), keys, "__b")
    return rows.withColumn("segment", F.floor(F.col("__o") / size).cast("long")).drop("__b", "__o")
