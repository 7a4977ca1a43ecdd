"""CSV exports, rule files and the quick look at a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monedero.schema import MatchConfig


def standardized_sorted(std: DataFrame) -> DataFrame:
    """Standardised rows, newest first."""
    return std.orderBy(F.desc_nulls_last("fecha"), F.asc("id"))


def backup_rows(ledger: DataFrame) -> DataFrame:
    """The full ledger, oldest first."""
    return ledger.orderBy(F.asc_nulls_last("fecha"), F.asc("unique_key"))


def export_csv(df: DataFrame, path: str) -> None:
    """Write the rows as CSV with a header; the files together keep the order of `df`."""
    df.write.option("header", True).option("escape", '"').csv(path)


def ledger_profile(ledger: DataFrame, ignored: DataFrame, n: int = 5) -> DataFrame:
    """The newest rows, each with the row count, ignored count and column list of the ledger."""
    rows = ledger.select(F.count(F.lit(1))).scalar()
    skipped = ignored.select(F.count(F.lit(1))).scalar()
    newest = ledger.orderBy(F.desc_nulls_last("fecha"), F.asc("unique_key")).limit(n)
    return newest.select(
        rows.alias("n_movimientos"),
        skipped.alias("n_ignorados"),
        F.lit(",".join(ledger.columns)).alias("columnas"),
        "unique_key",
        "fecha",
        "detalle",
        "monto",
    )


def read_merchant_rules(spark: SparkSession, path: str) -> DataFrame:
    """Hand-written rules from a JSON object file; the order of its keys is the rule order."""
    text = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "map<string,string>").alias("m")
    )
    return text.select(F.posexplode("m").alias("ord", "key", "categoria")).select(
        F.col("ord").cast("bigint").alias("ord"),
        F.lit(None).cast("date").alias("since"),
        F.lit(None).cast("string").alias("since_id"),
        "key",
        "categoria",
    )


def read_match_config(spark: SparkSession, path: str) -> MatchConfig:
    """Matching parameters from a small JSON file; absent ones take their defaults."""
    schema = (
        "account_aliases array<string>, reimbursement_window_days int, "
        "reimbursement_amount_tolerance double"
    )
    row = spark.read.schema(schema).json(path, multiLine=True).first()
    given = {k: v for k, v in row.asDict().items() if v is not None} if row else {}
    if "account_aliases" in given:
        given["account_aliases"] = tuple(given["account_aliases"])
    return MatchConfig(**given)
