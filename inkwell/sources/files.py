"""Readers and writers of the text and binary file formats. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import codec
from ..functions.places import segmented
from ..functions.scoring import as_text

PIECE = 1024  #: pairs of a line that are split at once


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no`` (from 1, over the files in order of their parts) and ``value``.

    Places within a partition come from the scan and are shifted by a count for each partition, so no task sees all lines.
    """
    lines = spark.read.text(path).withColumn("__m", F.monotonically_increasing_id())
    lines = lines.withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND((1 << 33) - 1))
    counts = lines.groupBy("__p").agg(F.count("*").alias("__c"))
    offsets = counts.select("__p", F.coalesce(F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    return lines.join(offsets, "__p").select((F.col("__o") + F.col("__i") + 1).cast("long").alias("line_no"), "value")


def leading_number(text):
    """The number that a text begins with; null if there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("long")


def split_line(lines: DataFrame) -> DataFrame:
    """``line_no``, ``doc_id``, ``text`` of lines with a tab, split at the first; ids by ``leading_number``, null if malformed."""
    tab = F.instr("value", "\t")
    rows = lines.filter(tab > 0)
    return rows.select("line_no", leading_number(F.substring_index("value", "\t", 1)).alias("doc_id"), F.expr("substring(value, instr(value, '\t') + 1)").alias("text"))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a tab-separated collection. Lines without a tab or without an id are left out (``rejected`` gives them)."""
    return split_line(numbered_lines(spark, path)).filter("doc_id is not null")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered_lines(spark, path)
    head = leading_number(F.substring_index("value", "\t", 1))
    return lines.filter((F.instr("value", "\t") == 0) | head.isNull())


def write_collection(docs: DataFrame, path: str) -> None:
    """One line for each document; tabs and line ends within a text become spaces."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\r\n]", " ")
    docs.select(F.concat_ws("\t", F.col("doc_id").cast("string"), text).alias("value")).write.text(path)


def read_word_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, word_id long").csv(path, sep=" ", quote="")


def write_word_ids(words: DataFrame, path: str) -> None:
    words.repartitionByRange("term").sortWithinPartitions("term").select(F.concat_ws(" ", "term", F.col("word_id").cast("string")).alias("value")).write.text(path)


def write_runs(runs: DataFrame, path: str) -> None:
    """Lines ``word: doc tf doc tf ...`` of ``runs(word_id, doc_id, tf[, chunk_id])``, a folder for each chunk if there are chunks.

    A word of more postings than ``SEGMENT`` goes on in further lines, which ``parse_runs`` reads alike.
    """
    keys = ["chunk_id", "word_id"] if "chunk_id" in runs.columns else ["word_id"]
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))), lambda x: F.concat_ws(" ", x["doc_id"].cast("string"), x["tf"].cast("string")))
    runs, parts = segmented(runs, keys, F.floor(F.col("doc_id") / 65536)), [*keys, "segment"]
    lines = runs.groupBy(*parts).agg(F.array_join(pairs, " ").alias("pairs")).repartitionByRange(*parts).sortWithinPartitions(*parts)
    lines = lines.select(*keys[:-1], F.concat(F.col("word_id").cast("string"), F.lit(": "), F.col("pairs")).alias("value"))
    writer = lines.write.partitionBy("chunk_id") if len(keys) == 2 else lines.write
    writer.text(path)


def parse_runs(lines: DataFrame) -> DataFrame:
    """``word_id``, ``doc_id``, ``tf`` of lines in ``value``; what isn't such a line is left out.

    The pairs repeat possessively: other repeated groups take a stack frame for each pair, and the line of a frequent word has too many.
    A line is cut into pieces of ``PIECE`` pairs before these are split, so that no task holds all numbers of a line as strings.
    """
    rows = lines.filter(F.col("value").rlike(r"^\d+:(?:\s+\d+\s+\d+)++\s*$"))
    pieces = F.regexp_extract_all(F.substring_index("value", ":", -1), F.lit(rf"(?:\d+\s+\d+\s*){{1,{PIECE}}}+"), F.lit(0))
    rows = rows.select(F.substring_index("value", ":", 1).cast("long").alias("word_id"), F.explode(pieces).alias("piece"))
    each = F.expr("transform(sequence(0, size(cells) div 2 - 1), i -> struct(cast(cells[2 * i] as long) as doc_id, cast(cells[2 * i + 1] as long) as tf))")
    return rows.withColumn("cells", F.split("piece", r"\s+")).select("word_id", F.inline(each))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs below a folder; order doesn't matter."""
    return parse_runs(spark.read.option("recursiveFileLookup", "true").text(path))


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    cells = [F.col(c).cast("string") for c in ("word_id", "metadata_start", "metadata_end", "df")]
    lexicon.repartitionByRange("word_id").sortWithinPartitions("word_id").select(F.concat_ws(" ", *cells).alias("value")).write.text(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word_id long, metadata_start long, metadata_end long, df long").csv(path, sep=" ")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``query_id``, ``query``; a later line of an id replaces an earlier one; lines without tab or number are left out."""
    rows = split_line(numbered_lines(spark, path)).filter("doc_id is not null")
    return rows.groupBy(F.col("doc_id").cast("int").alias("query_id")).agg(F.max_by("text", "line_no").alias("query"))


def read_evaluated(spark: SparkSession, path: str) -> DataFrame:
    """Distinct numbers that lines begin with, before the first tab."""
    return spark.read.text(path).select(leading_number(F.substring_index("value", "\t", 1)).cast("int").alias("query_id")).filter("query_id is not null").distinct()


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")


def write_seeds(urls: DataFrame, path: str) -> None:
    urls.orderBy("url").select(F.col("url").alias("value")).write.text(path)


def write_results(results: DataFrame, path: str) -> None:
    """Run file: query, document, score by tabs."""
    cells = [F.col("query_id").cast("string"), F.col("doc_id").cast("string"), as_text(F.col("score"))]
    results.orderBy("query_id", "rank").select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").text(path)


def encode_page_table(pages: DataFrame, convention: str = "continue") -> DataFrame:
    """``data``: the four numbers (document, start, length, words) of each row as variable bytes."""
    cells = F.array(*(F.col(c).cast("long") for c in ("doc_id", "text_start", "end_diff", "num_words")))
    return pages.select("doc_id", codec.varbyte_encode(cells, convention).alias("data"))


def write_page_table(pages: DataFrame, path: str, convention: str = "continue") -> None:
    """The page table as a table of bytes in order of documents; ``read_stored_page_table`` reads it. One file of bytes is their concatenation."""
    encode_page_table(pages, convention).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(path)


def read_stored_page_table(spark: SparkSession, path: str, convention: str = "continue") -> DataFrame:
    return decode_page_table(spark.read.schema("doc_id long, data binary").parquet(path), convention)


def decode_page_table(rows: DataFrame, convention: str = "continue") -> DataFrame:
    """Page-table rows of ``data`` columns that hold whole tuples, one or many."""
    numbers = codec.varbyte_decode(F.col("data"), convention)
    four = F.expr("transform(sequence(0, size(n) div 4 - 1), i -> struct(n[4 * i] as doc_id, n[4 * i + 1] as text_start, n[4 * i + 2] as end_diff, n[4 * i + 3] as num_words))")
    return rows.select(numbers.alias("n")).filter("size(n) >= 4").select(F.inline(four))


def read_page_table(spark: SparkSession, path: str, convention: str = "continue") -> DataFrame:
    return decode_page_table(spark.read.format("binaryFile").load(path).select(F.col("content").alias("data")), convention)
