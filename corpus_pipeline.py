"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, tokens.

Each stage gets the documents that its predecessor kept and gives documents again (the last one: their tokens).
Columns that a table has besides doc_id and text pass through.

Defined results: null texts count as empty, and are rejected by the quality rules. A document without an id can't
stand for its group, nor be told from others: it stays. Rows of one id are one document: the near-duplicate stage keeps
or drops them together, and of rows with equal id and text it keeps one (that of the smallest hash over all columns).
An empty table gives empty tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracecheck.llm import bpe, decontam, pii, quality, simhash
from tracecheck.llm.kit import free_name, shared_base, table
from tracecheck.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the current policy rejects."""
    mark = free_name(docs, "_rule_")
    led = quality.apply_policy(quality.ledger(docs, prefix=mark), failed=f"{mark}failed", to=f"{mark}kept")
    return led.where(F.col(f"{mark}kept")).select(*_own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id.

    Groups are linked fingerprints, and texts with four fifths of their shingles of five words in common.
    """
    classes = simhash.near_duplicates(docs, similar=simhash.Similar())
    per_id = classes.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n"))
    per_id = table(per_id.where("n > 1 or c <> doc_id"))
    gone = free_name(docs, "_gone")
    goes = per_id.where("c <> doc_id").select(F.col("doc_id").alias(gone))
    kept = docs.join(goes, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    again = per_id.where("n > 1 and c = doc_id").select(F.col("doc_id").alias(gone))
    if again.isEmpty():
        return kept
    same = F.col("doc_id").cast("long") == F.col(gone)
    rows = kept.join(again, same, "left_semi").select(F.struct(*_own(docs)).alias("row"))
    once = rows.groupBy("row.doc_id", "row.text").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return kept.join(again, same, "left_anti").unionAll(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item."""
    found = decontam.flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), to=(mark := free_name(docs, "_contaminated")))
    return found.where(~F.col(mark)).select(*_own(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in their texts; n_chars, where there is one, follows."""
    name = free_name(docs, "_masked")
    masked = pii.redact(docs, to=name)
    new = {"text": F.col(name), "n_chars": F.length(name).cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return masked.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, their number, and digests of the ids and of the text decoded from them. Other columns than the
    id end here."""
    return bpe.encode_and_check(docs, vocabulary("byte_bpe_50k.tiktoken"), keep=["doc_id"])


def _own(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Fingerprints, the semi-Markov field and byte-pair merges have no SQL form; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet under spark.checkpoint.dir and read again by the next."""
    place = f"{shared_base(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs
