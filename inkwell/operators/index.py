"""Index tables: page table, postings, dictionary, statistics, blocks and lexicon.

Postings stay flat rows keyed by term; word ids are a view for those who want the file formats. Global ranks and running sums go by
range of terms first and an offset for each range after that, so no window sorts the whole vocabulary in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.codec import varbyte_decode, varbyte_encode, varbyte_length, varbyte_sums
from ..functions.places import SEGMENT, placed, segmented
from ..functions.text import tokenize
from ..sources.shared import staged

BLOCK = 128  #: postings of a block
IDS = 65_536  #: document ids of a range that postings are counted by


@dataclass
class Index:
    """``weighed`` are the postings with their documents' lengths, so that a search reads its terms' rows and no page table."""

    page_table: DataFrame
    weighed: DataFrame
    lexicon: DataFrame
    n_docs: int
    avgdl: float
    total_words: int
    max_doc_id: int | None

    @property
    def postings(self) -> DataFrame:
        return self.weighed.select("term", "doc_id", "tf")


def tokenized(docs: DataFrame) -> DataFrame:
    """``doc_id`` and its ``tokens``; rows without id are left out."""
    return docs.filter("doc_id is not null").select("doc_id", tokenize("text").alias("tokens"))


def page_table(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``num_words`` (tokens, repeats counted)."""
    return tokenized(docs).select("doc_id", F.size("tokens").cast("long").alias("num_words"))


def corpus_stats(pages: DataFrame) -> DataFrame:
    """One row: ``n_docs``, ``avgdl``, ``max_doc_id``, ``total_words``."""
    return pages.agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.avg("num_words"), F.lit(0.0)).alias("avgdl"),
        F.max("doc_id").alias("max_doc_id"),
        F.coalesce(F.sum("num_words"), F.lit(0)).cast("long").alias("total_words"),
    )


def postings(docs: DataFrame) -> DataFrame:
    """``term``, ``doc_id``, ``tf``."""
    terms = tokenized(docs).select("doc_id", F.explode("tokens").alias("term"))
    return terms.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def weighed_postings(tokens: DataFrame) -> DataFrame:
    """``term``, ``doc_id``, ``tf`` and the document's ``num_words``, of ``tokens(doc_id, tokens)``."""
    terms = tokens.select("doc_id", F.size("tokens").cast("long").alias("num_words"), F.explode("tokens").alias("term"))
    return terms.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.max("num_words").alias("num_words"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def running(rows: DataFrame, amount: Column, order: str = "term") -> DataFrame:
    """``rows`` (a row for each term) with ``before``, the sum of ``amount`` over smaller terms.

    Ranges of terms, which Spark cuts by a sample so that they are alike in size, are summed each for itself and shifted by the sum of
    the ranges before.
    """
    rows = staged(rows.withColumn("__a", amount.cast("long")).repartitionByRange(order).withColumn("__p", F.spark_partition_id()), "running")
    ranges = rows.groupBy("__p").agg(F.sum("__a").alias("__s"))  # a row for each partition
    offsets = ranges.select("__p", F.coalesce(F.sum("__s").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    within = F.coalesce(F.sum("__a").over(W.partitionBy("__p").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__w", within).join(offsets, "__p").withColumn("before", (F.col("__o") + F.col("__w")).cast("long")).drop("__p", "__a", "__o", "__w")


def word_ids(terms: DataFrame) -> DataFrame:
    """``term`` and ``word_id``: dense ids from 0 in byte order, for distinct terms."""
    return running(terms.select("term"), F.lit(1)).select("term", F.col("before").alias("word_id"))


def chunk_postings(docs: DataFrame, lines: int) -> DataFrame:
    """Postings by chunk of ``lines`` documents in order of ``line_no`` (from 1): the sorted runs of a build."""
    if lines < 1:
        raise ValueError(f"{lines} lines a chunk")
    terms = docs.filter("doc_id is not null").select("doc_id", F.floor((F.col("line_no") - 1) / lines).cast("long").alias("chunk_id"), F.explode(tokenize("text")).alias("term"))
    return terms.groupBy("chunk_id", "term", "doc_id").agg(F.count("*").alias("tf"))


def merge_chunks(runs: DataFrame) -> DataFrame:
    """One posting for each term and document of all runs, whatever their order."""
    return runs.groupBy("term", "doc_id").agg(F.sum("tf").cast("long").alias("tf"))


def by_word(posted: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``term``, ``segment`` (from 0) and its ``postings`` in order of documents: a row holds about ``segment`` postings, however frequent its term is."""
    rows = segmented(posted, ["term"], F.floor(F.col("doc_id") / IDS), segment)
    return rows.groupBy("term", "segment").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))


def gaps(posted: DataFrame, block: int = BLOCK) -> DataFrame:
    """Postings with their ``block``, ``pos`` in it (from 0) and ``gap``: a block's first id as it is, then differences.

    A term's documents are numbered by range of ids first, so a frequent term is not sorted in one task.
    """
    rows = placed(posted, ["term"], F.floor(F.col("doc_id") / IDS), "doc_id")
    rows = rows.withColumn("block", F.floor(F.col("place") / block).cast("long")).withColumn("pos", (F.col("place") % block).cast("long"))
    last = F.lag("doc_id").over(W.partitionBy("term", "block").orderBy("doc_id"))
    return rows.withColumn("gap", F.col("doc_id") - F.coalesce(last, F.lit(0))).drop("place")


def decode_gaps(encoded: DataFrame) -> DataFrame:
    """``term``, ``block``, ``pos`` and the ``doc_id`` that the gaps add up to."""
    total = F.sum("gap").over(W.partitionBy("term", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return encoded.select("term", "block", "pos", total.cast("long").alias("doc_id"))


def posting_blocks(encoded: DataFrame) -> DataFrame:
    """A row for each block: last document, postings, and bytes of gaps and frequencies."""
    return encoded.groupBy("term", "block").agg(
        F.max("doc_id").alias("last_doc_id"),
        F.count("*").alias("n"),
        F.sum(varbyte_length(F.col("gap"))).cast("long").alias("doc_bytes"),
        F.sum(varbyte_length(F.col("tf"))).cast("long").alias("freq_bytes"),
    )


def lexicon_offsets(blocks: DataFrame) -> DataFrame:
    """``term``, ``word_id``, ``metadata_start``, ``metadata_end``, ``df`` of the encoded file: each word's block data follow its block metadata."""
    meta = varbyte_length(F.col("last_doc_id")) + varbyte_length(F.col("doc_bytes")) + varbyte_length(F.col("freq_bytes"))
    words = blocks.groupBy("term").agg(F.sum(meta).alias("meta"), F.sum(F.col("doc_bytes") + F.col("freq_bytes")).alias("data"), F.sum("n").cast("long").alias("df"))
    placed = running(words, F.col("meta") + F.col("data")).withColumnRenamed("before", "metadata_start")
    return placed.join(word_ids(words), "term").select("term", "word_id", "metadata_start", (F.col("metadata_start") + F.col("meta")).cast("long").alias("metadata_end"), "df")


def next_geq(posted: DataFrame, probes: DataFrame) -> DataFrame:
    """For each of ``probes(term, target)`` the first document of the term at or after the target; null if there is none."""
    wanted = probes.select(F.col("term").alias("t"), "target").distinct()
    hits = posted.join(wanted, (F.col("term") == F.col("t")) & (F.col("doc_id") >= F.col("target"))).groupBy("t", "target").agg(F.min("doc_id").alias("doc_id"))
    return wanted.join(hits, ["t", "target"], "left").select(F.col("t").alias("term"), "target", "doc_id")


BLOCKS = "term string, block long, last_doc_id long, n long, doc_bytes long, freq_bytes long, docs binary, freqs binary"


def encode_blocks(posted: DataFrame, block: int = BLOCK, convention: str = "continue") -> DataFrame:
    """The encoded index: ``BLOCKS``, a row for each block with its metadata and the bytes of its gaps and frequencies.

    A row holds ``block`` postings at most, however frequent its term is.
    """
    rows = gaps(posted, block).groupBy("term", "block").agg(F.max("doc_id").alias("last_doc_id"), F.sort_array(F.collect_list(F.struct("pos", "gap", "tf"))).alias("p"))
    rows = rows.select("term", "block", "last_doc_id", F.size("p").cast("long").alias("n"), *(varbyte_encode(F.col(f"p.{c}"), convention).alias(name) for c, name in (("gap", "docs"), ("tf", "freqs"))))
    return rows.select("term", "block", "last_doc_id", "n", F.octet_length("docs").cast("long").alias("doc_bytes"), F.octet_length("freqs").cast("long").alias("freq_bytes"), "docs", "freqs")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Parquet in order of terms and blocks, so that a term's blocks are read alone and metadata without data."""
    blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def decode_blocks(blocks: DataFrame, convention: str = "continue") -> DataFrame:
    """``term``, ``doc_id`` and ``tf`` of all postings of encoded blocks."""
    both = F.arrays_zip(varbyte_sums(F.col("docs"), convention).alias("doc_id"), varbyte_decode(F.col("freqs"), convention).alias("tf"))
    return blocks.select("term", F.inline(both))


def next_geq_of_blocks(blocks: DataFrame, probes: DataFrame, convention: str = "continue") -> DataFrame:
    """``next_geq`` over encoded blocks: metadata find the first block that reaches the target, and only that one is decoded."""
    wanted = probes.select(F.col("term").alias("t"), "target").distinct()
    reach = blocks.select("term", "block", "last_doc_id").join(wanted, (F.col("term") == F.col("t")) & (F.col("last_doc_id") >= F.col("target")))
    at = reach.groupBy("t", "target").agg(F.min("block").alias("b"))
    data = blocks.select("term", "block", "docs")
    found = at.join(data, (F.col("t") == F.col("term")) & (F.col("b") == F.col("block"))).withColumn("ids", varbyte_sums(F.col("docs"), convention))
    found = found.select("t", "target", F.expr("array_min(filter(ids, x -> x >= target))").alias("doc_id"))
    return wanted.join(found, ["t", "target"], "left").select(F.col("t").alias("term"), "target", "doc_id")


def byte_extents(lines: DataFrame) -> DataFrame:
    """``doc_id``, ``text_start``, ``end_diff`` in the tab-separated file of ``lines(line_no, doc_id, text)``: 64-bit places, without the line's end."""
    size = F.octet_length(F.concat_ws("\t", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))).cast("long") + 1
    lines = lines.withColumn("__size", size).withColumn("__g", F.floor((F.col("line_no") - 1) / 65536))
    groups = lines.groupBy("__g").agg(F.sum("__size").alias("__s"))
    groups = groups.select("__g", F.coalesce(F.sum("__s").over(W.orderBy("__g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    within = F.coalesce(F.sum("__size").over(W.partitionBy("__g").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("__at", within).join(groups, "__g").withColumn("__at", F.col("__o") + F.col("__at"))
    lead = F.octet_length(F.col("doc_id").cast("string")).cast("long") + 1
    return placed.select("doc_id", (F.col("__at") + lead).cast("long").alias("text_start"), (F.col("__size") - lead - 1).cast("long").alias("end_diff"))


def build_index(docs: DataFrame, *, check_ids: bool = True) -> Index:
    """Tokenise once and write page table, postings (by term and document) and lexicon to the shared folder.

    Raises ValueError if an id occurs twice.
    """
    tokens = staged(tokenized(docs), "tokens")
    pages = staged(tokens.select("doc_id", F.size("tokens").cast("long").alias("num_words")), "page-table")
    if check_ids and (twice := pages.groupBy("doc_id").count().filter("count > 1").limit(1).collect()):
        raise ValueError(f"doc_id {twice[0].doc_id} occurs more than once")
    posted = staged(weighed_postings(tokens).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), "postings")
    lexicon = staged(document_frequency(posted).repartitionByRange("term").sortWithinPartitions("term"), "lexicon")
    s = corpus_stats(pages).first()
    return Index(pages, posted, lexicon, s.n_docs, s.avgdl, s.total_words, s.max_doc_id)
