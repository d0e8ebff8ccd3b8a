"""An extension without a counterpart in the engine's file formats: an index that grows as collection files arrive.

Each micro-batch adds page-table rows and postings; a batch that is run again replaces its own folder, so a restart loses and repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import index
from ..operators.search import Engine
from ..sources.files import split_line
from ..sources.shared import staged

LINES = "value string"


def index_stream(spark: SparkSession, source: str, target: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Index the tab-separated files that arrive in ``source`` into Parquet tables below ``target``.

    Lines without a tab or an id are left out. Ids must be new; ``load`` checks that.
    """
    lines = spark.readStream.schema(LINES).text(source).withColumn("line_no", F.lit(0).cast("long"))
    docs = split_line(lines).filter("doc_id is not null").select("doc_id", "text")

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/documents/batch={number}")
        own = spark.read.parquet(f"{target}/documents/batch={number}")
        index.page_table(own).write.mode("overwrite").parquet(f"{target}/page_table/batch={number}")
        index.weighed_postings(index.tokenized(own)).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{target}/postings/batch={number}")
        posted = spark.read.parquet(f"{target}/postings/batch={number}")
        index.document_frequency(posted).write.mode("overwrite").parquet(f"{target}/lexicon/batch={number}")

    stream = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def load(spark: SparkSession, target: str) -> Engine:
    """An engine over all batches so far; document frequencies are those of the batches, added up. Raises ValueError if an id occurs twice."""
    pages = spark.read.parquet(f"{target}/page_table").select("doc_id", "num_words")
    if twice := pages.groupBy("doc_id").count().filter("count > 1").limit(1).collect():
        raise ValueError(f"doc_id {twice[0].doc_id} occurs more than once")
    posted = spark.read.parquet(f"{target}/postings").select("term", "doc_id", "tf", "num_words")
    lexicon = spark.read.parquet(f"{target}/lexicon").groupBy("term").agg(F.sum("df").alias("df"))
    s = index.corpus_stats(pages).first()
    found = index.Index(pages, posted, staged(lexicon, "lexicon"), s.n_docs, s.avgdl, s.total_words, s.max_doc_id)
    return Engine(found, spark.read.parquet(f"{target}/documents").select("doc_id", "text"))
