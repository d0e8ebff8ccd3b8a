"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source is a stream of its documents in hash order, cut into blocks of ``B`` words. A schedule of ``2**m`` slots is laid out by the
van der Corput sequence: point ``k / 2**m`` of the unit interval is visited at time ``bitreverse(k)``, and the cumulative target weights
cut the interval into one range of points for each source. A source's slots are ranked by time, and the slot of rank ``r`` takes block
``r mod blocks`` in epoch ``r div blocks``. So any stretch of the schedule holds the sources close to their weights. A source has the
slots that its target needs, rounded up, and its last slot takes only the words that the target has left.

Everything is DataFrame work. Ranks and running sums go by hash bucket (or time chunk) first and by an offset for each bucket after that,
so a source with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import staged, word_count

BUCKETS = 4096  #: hash buckets of a source's stream
PIECE = 8192  #: slots that one task row expands to
CHUNK_BITS = 10  #: time chunks of the schedule, as a power of two


@dataclass
class Mix:
    """``documents``: a row for each input row with its place in its source's stream and its source's target. ``mix``: the rows of the mix."""

    documents: DataFrame
    targets: DataFrame
    mix: DataFrame


def target_words(sizes: DataFrame, weights: tuple[float, ...], budget: float, epochs: int) -> DataFrame:
    """``sizes(source, source_size)`` with ``srank``, ``weight`` and ``target``.

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``budget`` times all words. No target passes
    ``epochs`` times its source's size; what is cut off is shared again by weight. That is water-filling: with sources in order of
    cap over weight, those before the first that the common level leaves below its cap get their caps, the others level times weight.
    The windows have no partition, over a row for each source.
    """
    by_name, everything = W.orderBy(F.col("source").isNull(), "source"), W.partitionBy()
    by_ratio = W.orderBy("ratio", "srank").rowsBetween(W.unboundedPreceding, -1)
    s = sizes.withColumn("srank", F.row_number().over(by_name).cast("long") - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("srank") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("all_words", F.sum("source_size").over(everything) * F.lit(float(budget)))
    left = F.col("all_words") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    s = s.withColumn("level", left / weight_left)
    level = F.min_by(F.when(F.col("ratio") > F.col("level"), F.col("level")), F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "srank"))).over(everything)
    s = s.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))))
    return s.select("source", "srank", "source_size", "weight", "target")


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    budget: float = 1.5,
    epochs: int = 2,
    block_words: int = 1024,
    min_slots: int = 1 << 16,
    seed: int = 17,
) -> Mix:
    """Mix ``docs``; see the module for the method.

    ``mix`` has ``slot`` (time), ``source``, ``srank``, ``epoch``, ``block``, ``doc_id``, ``place`` (words before the document in its
    source's stream, with ``srank`` a row's key), ``start`` and ``words`` (the words of the document that the slot takes).

    Blocks hold ``block_words`` words or fewer, so that there are ``min_slots`` slots where the words allow it; each source's words
    are its target, rounded to whole words and at least one, however small it is against a block. Null texts and texts without words have size 0 and are never taken; null sources are a
    source of their own; equal rows are laid one after the other and each counts; an empty table gives empty results. Columns other
    than the three named ones are not read. The same rows give the same mix.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size"))
    rows = staged(rows.withColumn("bucket", F.pmod("h", F.lit(BUCKETS))), "mix-sizes")

    per = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    per = staged(per, "mix-buckets", light=True)
    targets = target_words(per.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, epochs)
    total = F.sum("target").over(W.partitionBy())
    bits = F.greatest(F.least(F.lit(min_slots.bit_length() - 1), F.ceil(F.log2(total + 1))), F.ceil(F.log2(total / block_words)), F.lit(1)).cast("int")
    plan = targets.withColumn("bits", bits)
    plan = plan.withColumn("block_words", F.greatest(F.lit(1), F.ceil(total / F.pow(F.lit(2.0), "bits"))).cast("long"))
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    # whole epochs, and the words that the target has left for the one after them
    plan = plan.withColumn("goal", F.when(F.col("target") > 0, F.greatest(F.round("target").cast("long"), F.lit(1))).otherwise(F.lit(0)))
    plan = plan.withColumn("whole", F.expr("if(source_size > 0, goal div source_size, 0L)")).withColumn("rest", F.expr("goal - whole * source_size"))
    plan = plan.withColumn("n_slots", F.expr("whole * blocks + (rest + block_words - 1) div block_words"))
    plan = plan.withColumn("hi", F.sum("n_slots").over(W.orderBy("srank").rowsBetween(W.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("n_slots"))
    plan = plan.withColumn("bits", F.greatest("bits", F.length(F.bin(F.max("hi").over(W.partitionBy()) - 1))))
    plan = staged(plan, "mix-plan", light=True)

    # the schedule: points of a source's range, by time
    slots = plan.filter("hi > lo").select("srank", "bits", "lo", "hi", "blocks", "source_size", "whole", "rest", F.explode(F.expr(f"sequence(0L, (hi - lo - 1) div {PIECE})")).alias("piece"))
    slots = slots.repartition("srank", "piece").withColumn("k", F.explode(F.expr(f"sequence(lo + piece * {PIECE}, least(hi, lo + (piece + 1) * {PIECE}) - 1)")))
    slots = slots.withColumn("slot", F.expr("conv(reverse(lpad(bin(k), bits, '0')), 2, 10)").cast("long"))
    slots = slots.withColumn("chunk", F.expr(f"shiftright(slot, greatest(bits - {CHUNK_BITS}, 0))"))
    before = slots.groupBy("srank", "chunk").count()
    before = before.select("srank", "chunk", F.coalesce(F.sum("count").over(W.partitionBy("srank").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    slots = slots.withColumn("within", F.row_number().over(W.partitionBy("srank", "chunk").orderBy("slot")) - 1).join(before.hint("merge"), ["srank", "chunk"])
    slots = slots.withColumn("rank", F.col("earlier") + F.col("within"))
    slots = slots.select("srank", "slot", F.expr("rank div blocks").alias("epoch"), F.expr("rank % blocks").alias("block"), F.expr("if(rank div blocks < whole, source_size, rest)").alias("until"))

    # the streams: a document's place is its bucket's place plus the words before it in its bucket
    places = per.withColumn("bucket_at", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    places = places.join(plan.select(F.col("source").alias("s2"), "srank", "source_size", "target", "block_words"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2", "words")
    places = places.withColumnRenamed("source", "s2").withColumnRenamed("bucket", "b2")
    laid = rows.join(places.hint("merge"), (F.col("bucket") == F.col("b2")) & F.col("source").eqNullSafe(F.col("s2"))).drop("s2", "b2")
    w = W.partitionBy("srank", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    laid = laid.withColumn("place", F.col("bucket_at") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    laid = staged(laid.select("doc_id", "source", "srank", "size", "source_size", "target", "place", "block_words"), "mix-places")

    pieces = laid.filter("size > 0").withColumn("block", F.explode(F.expr("sequence(place div block_words, (place + size - 1) div block_words)")))
    first, last = F.greatest("place", F.expr("block * block_words")), F.least(F.expr("place + size"), F.expr("(block + 1) * block_words"))
    pieces = pieces.select("source", "srank", "block", "doc_id", "place", (first - F.col("place")).alias("start"), (last - first).alias("words"))
    mix = slots.join(pieces.hint("merge"), ["srank", "block"]).withColumn("words", F.least("words", F.expr("until - place - start"))).filter("words > 0")
    mix = mix.select("slot", "source", "srank", "epoch", "block", "doc_id", "place", "start", "words")
    return Mix(laid, targets, mix)


def taken(found: Mix) -> DataFrame:
    """A row for each input row: ``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken``, the words that the mix takes of it."""
    took = found.mix.groupBy("srank", "place").agg(F.sum("words").alias("taken"))
    rows = found.documents
    some = rows.filter("size > 0").join(took.hint("merge"), ["srank", "place"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return some.unionByName(rows.filter("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
