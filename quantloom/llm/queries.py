"""Registered queries of the corpus operators: the operators over whole tables, with production parameters."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hilbert, html_extract, langid, maxscore, mixing, packing, pii, sharding, simhash, url_filter

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public vocabulary file; QUANTLOOM_TOKENIZERS names another folder."""
    folder = os.environ.get("QUANTLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers
    except ImportError:
        sys.path.append("/opt/tokenizers")
        import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, last_id=0)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, width=4)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op3_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), k=20, scale=64.0, every=20)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op4_centroid_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out("doc_id"))
    model = langid.fit(docs.where("NOT held_out"))
    found = langid.identify(docs.drop("lang"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op5_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


def op6_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.words("text"), keep=["doc_id"])


def op7_min_cut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def url_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``: blocks that are lifted, allowed paths, and two parent domains."""
    hosts = pages.select(url_filter.host(F.col("url")).alias("h")).where("h <> ''").distinct()
    day = "date_add(DATE'2024-01-01', {})"
    rows = [
        hosts.select(F.col("h").alias("pattern"), F.lit("domain").alias("kind"), F.lit("block").alias("action"), F.expr(day.format("CAST(length(h) * 7 % 200 AS INT)")).alias("since")),
        hosts.select("h", F.lit("domain"), F.lit("lift"), F.expr(day.format("CAST(length(h) * 7 % 200 + 60 AS INT)"))),
        hosts.where("length(h) % 3 = 0").select(F.concat("h", F.lit("/en")), F.lit("prefix"), F.lit("allow"), F.expr(day.format("CAST(length(h) * 5 % 250 AS INT)"))),
        hosts.where("length(h) % 2 = 0").select(F.concat("h", F.lit("/fr")), F.lit("prefix"), F.lit("block"), F.expr(day.format("CAST(length(h) * 3 % 300 AS INT)"))),
        hosts.sparkSession.sql("SELECT 'example.net', 'domain', 'block', DATE'2024-06-01' UNION ALL SELECT 'example.com', 'domain', 'allow', DATE'2024-09-01'"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def op8_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no fetch times; a page's number gives its day in 2024."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.withColumn("fetched", F.expr("date_add(DATE'2024-01-01', CAST(page_id % 365 AS INT))"))
    found = url_filter.evaluate(captures, url_list(pages))
    return found.withColumnRenamed("id", "page_id").withColumn("fetched", F.col("fetched").cast("string"))


def op9_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.neighbours(table(spark, sf_dir, "embeddings"), k=20, every=20)


OP8_SQL = r"""
WITH c AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched,
    lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*?)\.*(?::[0-9]*)?(?:[/?#]|$)', 1)) AS host,
    rtrim(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/') AS path
  FROM pages),
h AS (SELECT DISTINCT host AS h, CAST(length(host) AS INTEGER) AS n FROM c WHERE host <> ''),
e AS (
  SELECT h AS pattern, 'domain' AS kind, 'block' AS action, DATE '2024-01-01' + n * 7 % 200 AS since FROM h
  UNION ALL SELECT h, 'domain', 'lift', DATE '2024-01-01' + (n * 7 % 200 + 60) FROM h
  UNION ALL SELECT h || '/en', 'prefix', 'allow', DATE '2024-01-01' + n * 5 % 250 FROM h WHERE n % 3 = 0
  UNION ALL SELECT h || '/fr', 'prefix', 'block', DATE '2024-01-01' + n * 3 % 300 FROM h WHERE n % 2 = 0
  UNION ALL SELECT 'example.net', 'domain', 'block', DATE '2024-06-01'
  UNION ALL SELECT 'example.com', 'domain', 'allow', DATE '2024-09-01'),
s AS (SELECT pattern, kind, since, arg_max(action, CASE action WHEN 'lift' THEN 0 WHEN 'block' THEN 1 ELSE 2 END) AS action FROM e GROUP BY ALL),
v AS (SELECT *, lead(since) OVER (PARTITION BY pattern, kind ORDER BY since) AS until FROM s),
m AS (
  SELECT c.page_id, v.pattern, v.kind, v.action,
    row_number() OVER (PARTITION BY c.page_id ORDER BY v.kind DESC, length(v.pattern) DESC) AS nth
  FROM c JOIN v ON v.action <> 'lift' AND v.since <= c.fetched AND (v.until IS NULL OR c.fetched < v.until) AND (
    (v.kind = 'domain' AND (c.host = v.pattern OR ends_with(c.host, '.' || v.pattern)))
    OR (v.kind = 'prefix' AND (c.host || c.path = v.pattern OR starts_with(c.host || c.path, v.pattern || '/')))))
SELECT c.page_id, c.url, c.host, CAST(c.fetched AS VARCHAR) AS fetched, m.pattern, m.kind, coalesce(m.action, 'none') AS action
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.nth = 1
"""


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_maxscore_top_k": op3_maxscore_top_k,
    "op4_centroid_language_id": op4_centroid_language_id,
    "op5_minimax_sharding": op5_minimax_sharding,
    "op6_systematic_mixing": op6_systematic_mixing,
    "op7_min_cut_extraction": op7_min_cut_extraction,
    "op8_temporal_url_filter": op8_temporal_url_filter,
    "op9_boosted_pii": op9_boosted_pii,
    "op10_hilbert_neighbours": op10_hilbert_neighbours,
}
ORACLES = {"op3_maxscore_top_k": OP3_SQL, "op8_temporal_url_filter": OP8_SQL}
