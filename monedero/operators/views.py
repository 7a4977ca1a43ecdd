"""Filters, the three working scopes, and the row-level views of the ledger."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monedero.functions import month_of
from monedero.schema import FLAG_COLUMNS, UNCATEGORISED


class Scopes(NamedTuple):
    view: DataFrame
    analysis: DataFrame
    compare: DataFrame


def filter_text(df: DataFrame, q: str | None) -> DataFrame:
    """Rows whose `detalle_norm` matches the pattern, whatever the case."""
    if not q:
        return df
    return df.filter(F.col("detalle_norm").rlike("(?i)" + q))


def filter_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows dated from `start` to `end`, both included.

    Without bounds the range is that of the data, so only undated rows go;
    with `start` alone it is that single day.
    """
    fecha = F.col("fecha")
    if start is None and end is None:
        return df.filter(fecha.isNotNull())
    if end is None:
        return df.filter(fecha == F.lit(start).cast("date"))
    if start is None:
        return df.filter(fecha <= F.lit(end).cast("date"))
    return df.filter(fecha.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def _first_of(month: str) -> Column:
    return F.lit(f"{month}-01").cast("date")


def filter_month(df: DataFrame, month: str | None) -> DataFrame:
    """Rows of one calendar month, given as 'yyyy-MM'."""
    if not month:
        return df
    first = _first_of(month)
    return df.filter(F.col("fecha").between(first, F.last_day(first)))


def filter_category(df: DataFrame, cats: Iterable[str] | None) -> DataFrame:
    """Rows in any of the categories; None, or a list holding 'Todas', keeps all."""
    chosen = list(cats or [])
    if not chosen or "Todas" in chosen:
        return df
    return df.filter(F.col("categoria").isin(chosen))


def scopes(
    ledger: DataFrame, q=None, start=None, end=None, month=None, cats=None
) -> Scopes:
    """The three working sets: view = all filters, analysis = no month, compare = text and category only."""
    base = ledger.withColumn("monto", F.coalesce(F.col("monto"), F.lit(0.0)))
    compare = filter_category(filter_text(base, q), cats)
    analysis = filter_range(compare, start, end)
    return Scopes(filter_month(analysis, month), analysis, compare)


def months(df: DataFrame) -> DataFrame:
    """The months present, ascending."""
    return (
        df.filter(F.col("fecha").isNotNull())
        .select(month_of(F.col("fecha")).alias("mes"))
        .distinct()
        .orderBy("mes")
    )


def date_bounds(df: DataFrame) -> DataFrame:
    """First and last date."""
    return df.agg(F.min("fecha").alias("min_fecha"), F.max("fecha").alias("max_fecha"))


def table_summary(df: DataFrame) -> DataFrame:
    """Row count, total and mean absolute amount."""
    amount = F.abs("monto").try_cast("decimal(18,2)")
    total = F.sum(amount).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("transacciones"),
        F.coalesce(total, F.lit(0.0)).alias("total"),
        F.round(total / F.count("monto"), 4).alias("promedio"),
    )


def current_month(df: DataFrame, month: str | None = None) -> DataFrame:
    """Rows of the chosen month, else of the last month present."""
    if month:
        return filter_month(df, month)
    last = df.select(F.trunc(F.max("fecha"), "month").alias("first_day")).scalar()
    return df.filter(F.col("fecha").between(last, F.last_day(last)))


def row_type(df: DataFrame) -> DataFrame:
    """Add `tipo`: given text, else expense flag, else transfer flag, else sign."""
    if "tipo" in df.columns:
        return df.withColumn("tipo", F.col("tipo").cast("string"))
    yes = ["1", "true", "t", "si", "sí", "y"]
    if "es_gasto" in df.columns:
        is_yes = F.coalesce(F.lower(F.col("es_gasto").cast("string")).isin(yes), F.lit(False))
        return df.withColumn("tipo", F.when(is_yes, "Gasto").otherwise("Abono"))
    if "es_transferencia_o_abono" in df.columns:
        is_yes = F.lower(F.col("es_transferencia_o_abono").cast("string")).isin(yes)
        is_yes = F.coalesce(is_yes, F.lit(False))
        return df.withColumn("tipo", F.when(is_yes, "Abono").otherwise("Gasto"))
    # Signs decide, unless nothing is negative: then every row is an expense.
    monto = F.coalesce(F.col("monto"), F.lit(0.0))
    any_negative = df.filter(F.col("monto") < 0).exists()
    by_sign = F.when(monto < 0, "Gasto").when(monto > 0, "Abono").otherwise("Cero")
    return df.withColumn("_neg", any_negative).withColumn(
        "tipo", F.when(F.col("_neg"), by_sign).otherwise("Gasto")
    ).drop("_neg")


def effective_amount(monto_real: Column, monto: Column) -> Column:
    """The user's corrected amount where there is one, else the original, both positive."""
    return F.when(monto_real > 0, F.abs(monto_real)).otherwise(F.abs(monto))


def reset_unknown_category(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Categories no longer in the list become 'Sin categoría'."""
    known = categories.select(F.col("nombre").alias("_known")).distinct()
    return (
        df.join(known, F.col("categoria") == F.col("_known"), "left")
        .withColumn("categoria", F.coalesce(F.col("_known"), F.lit(UNCATEGORISED)))
        .drop("_known")
    )


def editable_view(df: DataFrame, categories: DataFrame) -> DataFrame:
    """The table a user edits: effective amount, known category, note never NULL."""
    return reset_unknown_category(df, categories).select(
        "fecha",
        "detalle",
        effective_amount(F.col("monto_real"), F.col("monto")).alias("monto"),
        "categoria",
        F.coalesce(F.col("nota_usuario"), F.lit("")).alias("nota_usuario"),
        "unique_key",
    )


def table_sort(df: DataFrame, by: str = "fecha", desc: bool = True) -> DataFrame:
    """Order the table by one column, NULLs last, equal rows always in the same order."""
    if by not in ("fecha", "monto", "categoria", "detalle"):
        raise ValueError(f"cannot sort by {by!r}")
    key = F.desc_nulls_last(by) if desc else F.asc_nulls_last(by)
    return df.orderBy(key, F.asc("unique_key"))


def fill_flags(df: DataFrame) -> DataFrame:
    """Missing flags read as false."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(False)) for c in FLAG_COLUMNS if c in df.columns}
    )


