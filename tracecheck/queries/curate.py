"""Training rows over documents and labels: a document is an attempt's text, with made-up scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracecheck.operators import curate


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars")
    q = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    j = d.join(q, "doc_id", "left")
    return j.select(
        "doc_id",
        "source",
        F.when(F.col("n_chars") % 29 == 0, F.lit("  ")).otherwise(F.col("text")).alias("sva"),
        F.when(F.col("n_chars") % 13 == 0, 1).otherwise(0).alias("skipped"),
        (F.col("quality") == 1).alias("cover_ok"),
        F.when(F.col("n_chars") % 5 == 0, None).otherwise(F.col("n_chars") % 6).alias("asserts"),
        F.when(F.col("lang") == "en", (F.col("n_chars") % 11) / 10.0).alias("kill_rate"),
        F.col("n_chars").alias("seq"),
    )


def _reason():
    return curate.drop_reason(*[F.col(c) for c in ("sva", "skipped", "cover_ok", "asserts", "kill_rate")])


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).where(_reason().isNull()).withColumn("weight", curate.weight(F.col("kill_rate")))


def keep_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("doc_id", _reason().alias("reason"))


def drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_ladder(spark, sf_dir).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def weight_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.repeat(kept(spark, sf_dir), F.col("weight"), 4).select("doc_id", F.round("weight", 4).alias("weight"), "copy")


def dedupe_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = curate.dedupe_best(kept(spark, sf_dir).withColumn("o", F.struct("seq", "doc_id")), ["source"], F.col("weight"), "o")
    return best.select("source", "doc_id", "weight")


def output_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = kept(spark, sf_dir).withColumn("copies", curate.copies(F.col("weight"), 4))
    return k.agg(F.count("*").alias("kept"), F.sum("copies").alias("examples"), F.round(F.sum(F.col("weight") * F.col("copies")) / F.sum("copies"), 6).alias("mean_weight"))


def training_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = kept(spark, sf_dir)
    m = curate.messages(F.when(F.col("doc_id") % 2 == 0, F.lit("Be brief.")), F.col("source"), F.col("sva"))
    flat = F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return k.select("doc_id", F.size(m).alias("n"), F.md5(flat).alias("digest"))


def weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws as there are kept rows are made for a training epoch; by the row before each draw on a line of weights."""
    k = kept(spark, sf_dir).select("doc_id", "source", "weight")
    return curate.weighted_draw(k, "doc_id", F.col("weight"), None, seed=3).select("draw", "doc_id", "source")


def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept rows with their seeded place; a sort by it shuffles them."""
    return kept(spark, sf_dir).select("doc_id", curate.shuffle_key(0, "doc_id").alias("place"))


QUERIES = {f.__name__: f for f in (keep_ladder, drop_counts, weight_repeat, dedupe_best, output_stats, training_messages, weighted_draw, shuffled_order)}

_K = """WITH j AS (SELECT d.doc_id, source, CASE WHEN n_chars % 29 = 0 THEN '  ' ELSE text END AS sva, n_chars % 13 = 0 AS skipped, quality = 1 AS cover_ok,
  CASE WHEN n_chars % 5 = 0 THEN NULL ELSE n_chars % 6 END AS asserts, CASE WHEN lang = 'en' THEN (n_chars % 11) / 10.0 END::DOUBLE AS kill_rate, n_chars AS seq
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT *, CASE WHEN trim(coalesce(sva, '')) = '' THEN 'empty' WHEN skipped THEN 'skipped-statements' WHEN cover_ok = false THEN 'cover-fail' WHEN asserts = 0 THEN 'no-asserts'
  WHEN kill_rate + 1e-12 < 0.25 THEN 'below-min-kill' END AS reason FROM j),
k AS (SELECT *, CASE WHEN kill_rate IS NULL THEN 0.5 ELSE greatest(0.25, kill_rate) END::DOUBLE AS weight FROM r WHERE reason IS NULL),
c AS (SELECT *, greatest(1, round_even(weight * 4, 0)::INT) AS copies FROM k)"""

ORACLES = {
    "keep_ladder": f"{_K} SELECT doc_id, reason FROM r",
    "drop_counts": f"{_K} SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason",
    "weight_repeat": f"{_K} SELECT doc_id, round(weight, 4) AS weight, unnest(range(1, copies + 1)) AS copy FROM c",
    "dedupe_best": f"{_K} SELECT source, doc_id, weight FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY weight DESC, seq, doc_id) = 1",
    "output_stats": f"{_K} SELECT count(*) AS kept, sum(copies)::BIGINT AS examples, round(sum(weight * copies) / sum(copies), 6) AS mean_weight FROM c",
    "training_messages": f"""{_K} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END AS n,
      md5(CASE WHEN doc_id % 2 = 0 THEN 'system:Be brief.|' ELSE '' END || 'user:' || source || '|assistant:' || trim(sva) || chr(10)) AS digest FROM k""",
}
