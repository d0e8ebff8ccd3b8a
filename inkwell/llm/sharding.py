"""Sharding by fixed virtual slots with a versioned slot-to-shard map.

Records are hashed into a fixed number of slots. Bytes are summed by slot, before the shuffle, and the map from slots to shards is edited:
slots move from the heaviest shard to the lightest as long as that brings the two closer. Records never hash anew; a new version of the
map moves whole slots, and it starts from the version before it where there is one, with more shards or fewer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import copied, staged

MAP = "version int, virtual_slot int, shard int, bytes long, first_place long"


@dataclass
class Sharding:
    """``rows``: the records with ``slot`` (place in the shard) and ``shard``. ``versions``: the map's versions. ``moved_bytes``: what the last edit moves."""

    rows: DataFrame
    versions: DataFrame
    moved_bytes: int


def rebalance(owner: np.ndarray, weight: np.ndarray, shards: int) -> np.ndarray:
    """A copy of ``owner`` (shard by slot) in which slots moved from the heaviest to the lightest shard until no move lowers the gap between them.

    Ties go to the lower number. Slots that don't move keep their shard, so an edit costs as little traffic as the balance allows. Slots of
    shards that are no more go to the lightest ones first. Every move lowers the sum of squares of the loads, so it ends.
    """
    owner = owner.copy()
    gone = np.flatnonzero(owner >= shards)
    stays = owner < shards
    load = np.bincount(owner[stays], weights=weight[stays], minlength=shards).astype(np.int64)
    for k in gone[np.argsort(-weight[gone], kind="stable")]:
        owner[k] = load.argmin()
        load[owner[k]] += weight[k]
    while True:
        a, b = int(load.argmax()), int(load.argmin())
        own = np.flatnonzero((owner == a) & (weight > 0) & (weight < load[a] - load[b]))
        if not len(own):
            return owner
        k = own[np.abs(2 * weight[own] - (load[a] - load[b])).argmin()]
        owner[k] = b
        load[a] -= weight[k]
        load[b] += weight[k]


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """All versions that ``save_map`` has written to a folder."""
    return spark.read.schema(MAP).parquet(path)


def save_map(found: Sharding, path: str) -> None:
    """Add the newest version to the map in a folder; earlier ones stay."""
    newest = found.versions.agg(F.max("version")).first()[0]
    found.versions.filter(F.col("version") == newest).coalesce(1).write.mode("append").parquet(path)


def shard_records(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, slots: int = 4096, seed: int = 29, previous: DataFrame | None = None
) -> Sharding:
    """Give each record of ``docs`` a shard so that the shards' bytes are near equal (law ``bytes``).

    A record's size is the UTF-8 length of its text plus 8; a null text has no bytes. ``rows`` has ``doc_id``, ``size``, ``text_crc32``,
    ``virtual_slot``, ``shard`` and ``slot``, the record's place in its shard, gapless from 0: places are counted in each virtual slot
    and shifted by the slots of the shard before it, so no task sorts a whole shard. Equal rows are records of their own; they are
    counted before the shuffle and laid one after the other. ``previous`` is an earlier map (``read_map``): its newest version, which must
    have as many slots, is edited, and the result is the next one; without it slots are dealt in turn and edited. The driver holds a
    number for each virtual slot and never more. Rows without id are records too. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("virtual_slot", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_crc32"), F.lit(slots)).cast("int"))
    rows = staged(rows.groupBy("virtual_slot", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n")), "shard-sizes")
    weight, count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("n")).collect():  # a row for each slot at most
        weight[r.virtual_slot], count[r.virtual_slot] = r.b, r.n
    first, version = np.arange(slots) % shards, 1
    if previous is not None:
        version = previous.agg(F.max("version")).first()[0]
        for r in previous.filter(F.col("version") == version).select("virtual_slot", "shard").collect():  # a row for each slot
            first[r.virtual_slot] = r.shard
    edited = rebalance(first, weight, shards)
    at = np.zeros(slots, np.int64)
    for s in range(shards):
        own = np.flatnonzero(edited == s)
        at[own] = np.cumsum(count[own]) - count[own]
    versions = [(v, k, int(m[k]), int(weight[k]), int(at[k])) for v, m in ((version, first), (version + 1, edited)) for k in range(slots)]
    versions = staged(spark.createDataFrame(versions, MAP), "shard-map", light=True)
    current = versions.filter(F.col("version") == version + 1).select("virtual_slot", "shard", "first_place")
    within = F.sum("n").over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    placed = copied(rows.withColumn("within", within), "n", "nth").join(F.broadcast(current), "virtual_slot")  # as many rows as slots, a parameter
    placed = placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first_place") + F.col("within") + F.col("nth")).cast("long").alias("slot"), "virtual_slot")
    return Sharding(placed, versions, int(weight[edited != first].sum()))
