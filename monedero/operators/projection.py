"""Month-end projection from categories with a steady monthly spend.

One pass over the rows gives the category-by-month matrix; everything after it
works on that matrix, whose size is categories times months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monedero.functions import month_of
from monedero.operators.metrics import as_double, total
from monedero.schema import OCCASIONAL_WORDS


def _matrix(compare: DataFrame, amount: str) -> DataFrame:
    return (
        compare.filter(F.col("fecha").isNotNull() & F.col("categoria").isNotNull())
        .groupBy("categoria", month_of(F.col("fecha")).alias("mes"))
        .agg(total(amount).alias("total_mes"))
    )


def month_category(compare: DataFrame, amount: str = "monto") -> DataFrame:
    """Sum per category and month."""
    return _matrix(compare, amount).withColumn("total_mes", as_double(F.col("total_mes")))


def _with_recency(matrix: DataFrame, last_k: int) -> DataFrame:
    # The windows order matrix rows, not ledger rows.
    newest_first = Window.orderBy(F.desc("mes"))
    ranked = matrix.withColumn("rank_mes", F.dense_rank().over(newest_first))
    k = F.least(F.lit(last_k), F.max("rank_mes").over(Window.partitionBy()))
    return ranked.withColumn("k", k).withColumn("reciente", F.col("rank_mes") <= F.col("k"))


def _stats(matrix: DataFrame) -> DataFrame:
    value = F.col("total_mes").cast("double")
    mean = as_double(F.sum("total_mes")) / F.count("total_mes")
    grouped = matrix.groupBy("categoria").agg(
        F.count("total_mes").alias("num_meses"),
        mean.alias("_mean"),
        F.stddev_samp(value).alias("_std"),
        *(
            [(F.count_if("reciente") == F.max("k")).alias("presente_ultimos_k")]
            if "reciente" in matrix.columns
            else []
        ),
    )
    cv = F.when(F.col("_mean") > 0, F.col("_std") / F.col("_mean")).otherwise(
        F.lit(float("inf"))
    )
    return grouped.withColumn("_cv", cv)


def category_stats(compare: DataFrame, amount: str = "monto") -> DataFrame:
    """Months present, mean, sample deviation and variation of the monthly totals."""
    return _stats(_matrix(compare, amount)).select(
        "categoria",
        "num_meses",
        F.round("_mean", 4).alias("prom_mensual"),
        F.round("_std", 4).alias("desv"),
        F.round("_cv", 6).alias("cv"),
    )


def last_k_presence(compare: DataFrame, amount: str = "monto", last_k: int = 3) -> DataFrame:
    """Whether each category is present in all of the last K months."""
    return _stats(_with_recency(_matrix(compare, amount), last_k)).select(
        "categoria", "presente_ultimos_k"
    )


def _stable(compare, last_k, min_mean, max_cv, blacklist, amount) -> DataFrame:
    stats = _stats(_with_recency(_matrix(compare, amount), last_k))
    steady = (F.col("_mean") >= min_mean) & (F.col("_cv") <= max_cv)
    stable = stats.filter(
        (F.col("num_meses") >= 2) & (F.col("presente_ultimos_k") | steady)
    )
    name = F.lower("categoria")
    for word in blacklist:
        stable = stable.filter(~F.contains(name, F.lit(word)))
    return stable


def stable_categories(
    compare: DataFrame,
    last_k: int = 3,
    min_mean: float = 3000.0,
    max_cv: float = 1.0,
    blacklist: tuple[str, ...] = OCCASIONAL_WORDS,
    amount: str = "monto",
) -> DataFrame:
    """Categories worth projecting: two months or more, and recent or steady; no occasional ones."""
    return _stable(compare, last_k, min_mean, max_cv, blacklist, amount).select(
        "categoria",
        "num_meses",
        F.round("_mean", 4).alias("prom_mensual"),
        F.round("_cv", 6).alias("cv"),
        "presente_ultimos_k",
    )


def projection(
    compare: DataFrame,
    view: DataFrame,
    last_k: int = 3,
    min_mean: float = 3000.0,
    max_cv: float = 1.0,
    blacklist: tuple[str, ...] = OCCASIONAL_WORDS,
    amount: str = "monto",
) -> DataFrame:
    """Mean of each stable category against the view's sum, and what is left to spend."""
    stable = _stable(compare, last_k, min_mean, max_cv, blacklist, amount)
    current = (
        view.filter(F.col("categoria").isNotNull())
        .groupBy("categoria")
        .agg(as_double(total(amount)).alias("actual_mes"))
    )
    spent = F.coalesce(F.col("actual_mes"), F.lit(0.0))
    return (
        stable.join(current, "categoria", "left")
        .select(
            "categoria",
            F.round("_mean", 4).alias("prom_mensual"),
            spent.alias("actual_mes"),
            F.round(F.greatest(F.col("_mean") - spent, F.lit(0.0)), 4).alias("restante_estimado"),
        )
        .orderBy(F.desc("prom_mensual"), F.asc("categoria"))
    )


def projection_totals(proj: DataFrame) -> DataFrame:
    """Totals of the projection."""

    def add(column: str, name: str):
        exact = F.sum(F.col(column).cast("decimal(28,4)"))
        return F.coalesce(as_double(exact), F.lit(0.0)).alias(name)

    return proj.agg(
        add("prom_mensual", "total_proyectado"),
        add("actual_mes", "total_actual"),
        add("restante_estimado", "total_restante"),
    )
