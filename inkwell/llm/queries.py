"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, mixing, neardup, packing, pii, sharding, telephony, tokencount, topk, toxicity
from .common import documents, staged


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), words=2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix_sources(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(documents(spark, sf_dir), vocabulary=vocabulary("word_bpe_49k.json"))
    digests = staged(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pack-pieces")
    return packing.pack(digests).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    found = found.withColumn("base", F.expr("filter(licenses, x -> x.base)"))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    at = F.transform("base", lambda x: x["at"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.col("licenses")).alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_records(documents(spark, sf_dir)).rows
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), vocabulary=vocabulary("piece_bpe_32k.model"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    asked = docs.filter(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return topk.search(docs, asked, k=10)


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = staged(telephony.encode_documents(documents(spark, sf_dir)), "media", compression="zstd")
    media = media.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    return telephony.decode_media(media, keep_pcm=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) as long) as n_{k}") for k in pii.BASE]
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])))
    base = F.filter("pii", lambda x: x["k"] < len(pii.BASE))
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_toxicity, op3_source_mix, op4_pack_sequences, op5_licenses, op6_shards, op7_token_counts, op8_topk_search, op9_telephony, op10_personal_data)}


WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
  sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS s FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT x, y FROM p JOIN n i ON x = i.doc_id JOIN n j ON y = j.doc_id WHERE 100 * c >= 80 * (i.n + j.n - c)),
  e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
  r AS (SELECT x AS id, y AS other FROM e UNION SELECT r.id, e.y FROM r JOIN e ON r.other = e.x),
  m AS (SELECT id, min(other) AS low FROM r GROUP BY id)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
  FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON id = doc_id"""

OP8_SQL = f"""WITH t AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents), post AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM post GROUP BY term), dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY doc_id),
  st AS (SELECT count(*) AS n, (SELECT count(*) FROM t) / count(*) AS average FROM documents),
  s AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * d.tf * 2.5::DOUBLE / (d.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / average))), 6) AS score
    FROM post q JOIN post d USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = d.doc_id, st WHERE q.doc_id % 20 = 0 GROUP BY ALL)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s QUALIFY rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """SQL of the exact operators that it can express; trained scores, tokenizers, 64-bit hashes and digests have no counterpart there."""
    return {"op1_minhash_dedup": OP1_SQL, "op8_topk_search": OP8_SQL}
