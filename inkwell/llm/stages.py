"""Stages of the corpus pipeline, each over all that the stage before it kept.

Every stage but the last returns the columns of ``documents``: ``doc_id``, ``text``, ``lang``, ``source``, ``n_chars``; others are left out.
An empty table gives no rows in any stage.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import mixing, neardup, packing, pii, toxicity
from .common import WORD, documents, staged, word_count
from .queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled documents of ``sf_dir``, does not reject (score below 0.5).

    Null and empty texts have the score of no features and stay unless most labelled documents are toxic. Equal texts share their fate,
    repeated rows each for itself; other columns may be null.
    """
    model = toxicity.fit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model, keep=True).filter("toxicity_score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles and a similarity of 0.8: that of the smallest id.

    Documents without words or id stay. Rows of one id are kept or go together, as their id decides: repeated rows stay beside one another.
    """
    kept = neardup.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(kept, F.col("doc_id") == F.col("gone"), "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind in brackets; ``n_chars`` follows the text where it changes. Null and empty texts stay as they are."""
    clean = pii.redact(pii.find_personal_data(docs))
    return clean.withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """``rows(id, source, size, ...)`` with ``nth``, which tells rows of the same three apart."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("id", "source", "size").orderBy(by)))


def words_between(text: str, first: str, taken: str) -> Column:
    """``taken`` words of column ``text`` from word ``first`` on, with the white space between them."""
    gap = r"[\x20\x09-\x0D]"
    pattern = F.format_string(rf"^{gap}*+(?:{WORD}+{gap}++){{%d}}+({WORD}+(?:{gap}++{WORD}+){{%d}}+)", first, F.col(taken) - 1)
    return F.call_function("regexp_extract", F.col(text), pattern, F.lit(1))


def mix_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and epoch that the schedule takes: the whole text, or the words taken where a block's edge cuts it.

    A document's blocks of one epoch are neighbours, so its taken words are one range. Documents without words aren't taken.
    """
    found = mixing.mix_sources(docs)
    places = numbered(found.documents.filter("size > 0").select(F.col("doc_id").alias("id"), "source", "size", "srank", "place"), "place")
    parts = found.mix.groupBy("srank", "place", "epoch").agg(F.min("start").alias("first"), F.sum("words").alias("taken"))
    parts = parts.join(places.hint("merge"), ["srank", "place"]).select(*(F.col(c).alias(f"p_{c}") for c in ("id", "source", "size", "nth", "first", "taken")))
    rows = docs.select("text", "lang", "n_chars", F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size")).filter("size > 0")
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in ("id", "source", "size", "nth")]
    both = numbered(rows, "text").join(parts.hint("merge"), reduce(and_, same))
    whole = F.col("p_taken") >= F.col("size")
    both = both.withColumn("out", F.when(whole, F.col("text")).otherwise(words_between("text", "p_first", "p_taken")))
    return both.select(F.col("id").alias("doc_id"), F.col("out").alias("text"), "lang", "source", F.when(whole, F.col("n_chars")).otherwise(F.length("out").cast("long")).alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids and their places in sequences of 2048. A null or empty text is one piece with the end id alone; repeated rows are packed each for itself."""
    return packing.pack_documents(docs, vocabulary=vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("source mix", mix_by_source),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
