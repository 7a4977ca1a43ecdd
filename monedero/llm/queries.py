"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monedero.llm import (
    decontaminate,
    fim,
    langid,
    licenses,
    mixing,
    mtree,
    neardup,
    quality,
    secret_scan,
    surrogates,
    toxicity,
    vector_codes,
    warc,
)
from monedero.llm.common import Scratch, fold, read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~fold("doc_id", 4, 2)))
    rows = docs.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "text")
    return langid.predict(rows, model, columns=("doc_id", "held_out"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), Scratch(spark))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(read(spark, sf_dir, "documents"), b"registered-query", Scratch(spark))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(docs))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(~fold("doc_id", 3, 1))
    weights = quality.fit(docs, labels)
    rows = docs.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "text")
    return quality.predict(rows, weights, columns=("doc_id", "held_out")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), Scratch(spark), width=4)


def op9_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", mtree.quantised("embedding").alias("vector"))
    return mtree.search(rows, rows.where(F.col("vec_id") % 50 == 0))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    folder = scratch.folder()
    warc.write(read(spark, sf_dir, "pages"), folder)
    found = warc.pages(spark, folder, scratch)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    books = vector_codes.fit(vectors)
    coded = vector_codes.encode(vectors, books, columns=("vec_id", "label"))
    rows = vector_codes.with_group_errors(coded, "label", "label_error", Scratch(spark))
    return rows.select("vec_id", "code", "error", "label_error").withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.transform(read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(~fold("doc_id", 5, 0))
    model = toxicity.fit(docs, labels)
    rows = docs.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "text")
    return toxicity.predict(rows, model, columns=("doc_id", "held_out")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


_WARC_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_language_id, op2_source_mixing, op3_pii_surrogates, op4_secret_scan, op5_decontamination, op6_license_scan,
        op7_quality, op8_near_duplicates, op9_top_k_search, op10_warc,
        op11_vector_codes, op12_fill_in_middle, op13_toxicity,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_license_scan": licenses.oracle_sql(),
        "op8_near_duplicates": neardup.oracle_sql(),
        "op9_top_k_search": mtree.oracle_sql(),
        "op10_warc": _WARC_SQL,
        "op11_vector_codes": vector_codes.oracle_sql(),
        "op12_fill_in_middle": fim.oracle_sql(),
    }
