"""Bag-of-words search with BM25: conjunctive (``c``) and disjunctive (``d``), one query or a set of queries in one job."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scoring import DIGITS, K1, B, as_text, bm25
from ..functions.text import snippet, tokenize, tokens_of
from ..sources.shared import staged
from .index import Index, build_index

MODES = ("c", "d")
RESULT = "rank long, doc_id long, score double"


def by_score(score: Column | str = "score") -> list[Column]:
    return [F.desc(score), F.asc("doc_id")]


class Engine:
    """Search over an index. ``documents`` gives texts for snippets."""

    def __init__(self, index: Index, documents: DataFrame | None = None, *, k1: float = K1, b: float = B):
        self.index, self.documents, self.k1, self.b = index, documents, k1, b
        self.spark: SparkSession = index.postings.sparkSession

    @classmethod
    def over(cls, documents: DataFrame, **options) -> Engine:
        return cls(build_index(documents), documents, **options)

    def lexicon_of(self, terms: list[str]) -> dict[str, int]:
        """Document frequencies of the terms that the index has."""
        wanted = sorted(set(terms))
        return {r.term: r.df for r in self.index.lexicon.filter(F.col("term").isin(wanted)).collect()} if wanted else {}

    def missing(self, query: str) -> list[str]:
        """Distinct tokens of the query that no document has."""
        known = self.lexicon_of(tokens_of(query))
        return sorted({t for t in tokens_of(query) if t not in known})

    def score(self, tf: Column, df: Column, length: Column) -> Column:
        return bm25(F.lit(float(self.index.n_docs)), df, tf, length, F.lit(float(self.index.avgdl)), self.k1, self.b)

    def search(self, query: str, mode: str = "d", k: int = 10) -> DataFrame:
        """``rank``, ``doc_id``, ``score``: the best ``k`` by rounded score, then id.

        A token that occurs twice in the query counts twice. Conjunctive queries need every distinct token and give nothing if one is
        missing from the index; disjunctive ones ignore missing tokens. No tokens: no rows. The terms are literals of the scan's filter.
        """
        if mode not in MODES:
            raise ValueError(f"mode {mode!r} is none of {MODES}")
        wanted = Counter(tokens_of(query))
        known = self.lexicon_of([*wanted])
        if not known or (mode == "c" and len(known) < len(wanted)):
            return self.spark.createDataFrame([], RESULT)
        hits = self.index.weighed.filter(F.col("term").isin(sorted(known)))
        weight, df = F.lit(None), F.lit(None)
        for t in known:
            weight, df = F.when(F.col("term") == t, float(wanted[t])).otherwise(weight), F.when(F.col("term") == t, float(known[t])).otherwise(df)
        scored = hits.withColumn("part", weight * self.score(F.col("tf"), df, F.col("num_words")))
        found = scored.groupBy("doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score"), F.count("*").alias("n_terms"))
        if mode == "c":
            found = found.filter(F.col("n_terms") == len(wanted))
        best = found.orderBy(*by_score()).limit(k)
        return best.select(F.row_number().over(W.orderBy(*by_score())).cast("long").alias("rank"), "doc_id", "score")

    def search_batch(self, queries: DataFrame, mode: str = "d", k: int = 10, evaluated: DataFrame | None = None) -> DataFrame:
        """``query_id``, ``rank``, ``doc_id``, ``score`` for all of ``queries(query_id, query)``, or those of ``evaluated(query_id)``, in one job."""
        if mode not in MODES:
            raise ValueError(f"mode {mode!r} is none of {MODES}")
        if evaluated is not None:
            queries = queries.join(evaluated.select("query_id").distinct(), "query_id", "left_semi")
        wanted = queries.select("query_id", F.explode(tokenize("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        wanted = wanted.withColumn("n_terms", F.count("*").over(W.partitionBy("query_id")))
        known = wanted.join(self.index.lexicon, "term")
        hits = known.join(self.index.weighed, "term")
        part = F.col("qtf") * self.score(F.col("tf"), F.col("df"), F.col("num_words"))
        found = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), DIGITS).alias("score"), F.count("*").alias("n"), F.first("n_terms").alias("n_terms"))
        if mode == "c":
            found = found.filter("n = n_terms")
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*by_score())).cast("long"))
        return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    def with_snippets(self, results: DataFrame) -> DataFrame:
        """Results with the documents' first 500 characters. Results are written first, so Spark knows their size and sends them to the texts only while they are small."""
        snippets = self.documents.select("doc_id", snippet(F.col("text")).alias("snippet"))
        return staged(results, "results", light=True).join(snippets, "doc_id").select(*results.columns, "snippet")


def run_lines(results: DataFrame, digits: int = 6) -> DataFrame:
    """``line``: query, document and score with six significant digits, by tabs. Who reads scores back to work with them takes ``scoring.EXACT`` digits: to round six anew rounds twice."""
    return results.select(F.concat_ws("\t", F.col("query_id").cast("string"), F.col("doc_id").cast("string"), as_text(F.col("score"), digits)).alias("line"))


def missing_ids(queries: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Evaluated ids that have no query."""
    return evaluated.select("query_id").distinct().join(queries, "query_id", "left_anti")
