"""The training-corpus pipeline: language, near-duplicates, leaks, secrets, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monedero.llm import decontaminate, langid, mixing, neardup, secret_scan
from monedero.llm.common import Scratch, fold, read

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; fitted on the labelled fold."""
    model = langid.fit(docs.where(~fold("doc_id", 4, 2)))
    return langid.predict(docs, model, columns=docs.columns).where(langid.accepted()).select(*docs.columns)


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """`docs` written once with `_row`, a key of every row: doc_id may repeat or be null."""
    return scratch.stage(docs.withColumn("_row", F.monotonically_increasing_id()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five-word shingles, similarity 0.8.

    Texts alone decide what is a near copy, so rows of one doc_id with unlike texts and rows
    without doc_id stay. The row with the smallest doc_id stays, null last.
    """
    scratch = Scratch(spark)
    rows = _keyed(docs, scratch)
    groups = neardup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), Scratch(spark), width=5, percent=80)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(*docs.columns), F.col("_row")).alias("order")
    first = (
        rows.select("_row", order)
        .join(groups.select(F.col("doc_id").alias("_row"), "component_id"), "_row")
        .groupBy("component_id")
        .agg(F.min("order").alias("order"))
        .select("order._row")
    )
    # Few or very many rows go; only their keys are looked up.
    gone = scratch.stage(rows.select("_row").join(first, "_row", "left_anti"))
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands, replaced words tolerated."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets replaced by a mark."""
    return secret_scan.redact(docs, secret_scan.train(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows the mix takes, with the number of copies of each."""
    scratch = Scratch(spark)
    # Equal rows are drawn alike, whatever their keys; empty ones, which are never taken, are spread.
    empty = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.col("_row"))
    rows = _keyed(docs, scratch)
    mixed = mixing.mix(rows.withColumn("_draw", F.xxhash64(*docs.columns, empty)), scratch, key="_row", draw="_draw")
    taken = mixed.where("copies > 0").select(F.col("doc_id").alias("_row"), "copies", "taken")
    return rows.join(taken, "_row").select(*docs.columns, "copies", "taken")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("source_mixing", source_mixing),
]

#: Fitted models and hashed sketches decide the rows, so no SQL states them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for no, (_, stage) in enumerate(STAGES):
        done = scratch.stage(stage(spark, docs, sf_dir))
        if no:
            scratch.drop(docs)
        docs = done
    return docs
