"""Key figures, category and merchant aggregates, month comparison and trend.

Each figure is one aggregate over the scope it is given: Spark combines the
exact decimal sums before the shuffle, so a hot month, category or merchant
costs one partial row per task. Rows without a date count in no month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monedero.functions import money, month_of
from monedero.operators.views import current_month
from monedero.schema import WEEKDAY_NAMES


def total(amount: str) -> Column:
    return F.sum(money(F.col(amount)))


def as_double(c: Column) -> Column:
    return c.cast("double")


def total_spend(scope: DataFrame, amount: str = "monto") -> DataFrame:
    """Sum of absolute amounts."""
    return scope.agg(F.coalesce(as_double(total(amount)), F.lit(0.0)).alias("total"))


def daily_mean(scope: DataFrame, amount: str = "monto") -> DataFrame:
    """Total over the days between first and last date, both included."""
    span = F.datediff(F.max("fecha"), F.min("fecha")) + 1
    days = F.greatest(F.lit(1), F.coalesce(span, F.lit(1)))
    spent = F.coalesce(as_double(total(amount)), F.lit(0.0))
    return scope.agg(days.alias("dias"), F.round(spent / days, 4).alias("promedio_diario"))


def monthly_totals(scope: DataFrame, amount: str = "monto") -> DataFrame:
    """(mes, total) with the exact decimal total."""
    return (
        scope.filter(F.col("fecha").isNotNull())
        .groupBy(month_of(F.col("fecha")).alias("mes"))
        .agg(total(amount).alias("total"))
    )


def monthly_mean(scope: DataFrame, amount: str = "monto") -> DataFrame:
    """Mean of the totals of the months present."""
    mean = as_double(F.sum("total")) / F.count("total")
    return monthly_totals(scope, amount).agg(
        F.round(F.coalesce(mean, F.lit(0.0)), 4).alias("promedio_mensual")
    )


def mom_change(scope: DataFrame, amount: str = "monto") -> DataFrame:
    """Last month present against the month present before it."""
    two = monthly_totals(scope, amount).orderBy(F.desc("mes")).limit(2)
    row = two.agg(
        F.max("mes").alias("mes"),
        as_double(F.max_by("total", "mes")).alias("actual"),
        F.when(F.count("mes") == 2, as_double(F.min_by("total", "mes"))).alias("anterior"),
    )
    pct = (F.col("actual") - F.col("anterior")) / F.col("anterior") * 100.0
    pct = F.when(F.col("anterior") > 0, pct)
    text = (
        F.when(F.col("anterior").isNull(), F.lit("n/a"))
        .when(F.col("anterior") <= 0, F.lit("nuevo mes sin base"))
        .otherwise(
            F.concat(
                F.when(F.col("pct") >= 0, F.lit("+")).otherwise(F.lit("")),
                F.replace(F.format_number("pct", 1), F.lit(",")),
                F.lit("% vs mes anterior"),
            )
        )
    )
    return (
        row.withColumn("pct", pct)
        .withColumn("texto", text)
        .withColumn("pct", F.round("pct", 6))
    )


def _largest(scope: DataFrame, by: str, amount: str, k: int | None) -> DataFrame:
    sums = (
        scope.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(as_double(total(amount)).alias("total"))
        .orderBy(F.desc("total"), F.asc(by))
    )
    return sums if k is None else sums.limit(k)


def top_place(scope: DataFrame, amount: str = "monto") -> DataFrame:
    """Merchant with the greatest sum in the last month present."""
    return _largest(current_month(scope), "detalle_norm", amount, 1)


def top_category(scope: DataFrame, amount: str = "monto") -> DataFrame:
    """Category with the greatest sum."""
    return _largest(scope, "categoria", amount, 1)


def spend_by_category(scope: DataFrame, amount: str = "monto") -> DataFrame:
    """Sum per category, the missing category being a group of its own, with its share of all."""
    sums = scope.groupBy("categoria").agg(total(amount).alias("total"))
    everything = as_double(F.sum("total").over(Window.partitionBy()))
    share = F.when(everything > 0, F.round(as_double(F.col("total")) / everything, 8))
    return sums.select(
        "categoria",
        as_double(F.col("total")).alias("total"),
        everything.alias("total_general"),
        share.alias("proporcion"),
    ).orderBy(F.desc("total"), F.asc("categoria"))


def top_places(
    scope: DataFrame, amount: str = "monto", k: int = 5, month: str | None = None
) -> DataFrame:
    """The k merchants with the greatest sums in the chosen, else the last, month."""
    return _largest(current_month(scope, month), "detalle_norm", amount, k)


def freq_by_category(scope: DataFrame, k: int | None = None) -> DataFrame:
    """Rows per category, ascending; with `k` only the k most frequent."""
    freq = (
        scope.filter(F.col("categoria").isNotNull())
        .groupBy("categoria")
        .agg(F.count(F.lit(1)).alias("veces"))
    )
    if k is not None:
        freq = freq.orderBy(F.desc("veces"), F.asc("categoria")).limit(k)
    return freq.orderBy("veces", "categoria")


def spend_by_weekday(scope: DataFrame, amount: str = "monto") -> DataFrame:
    """Sum per weekday, Monday first."""
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    return (
        scope.filter(F.col("fecha").isNotNull())
        .groupBy(F.weekday("fecha").alias("dow_idx"))
        .agg(as_double(total(amount)).alias("total"))
        .select(F.get(names, F.col("dow_idx")).alias("dow"), "dow_idx", "total")
        .orderBy("dow_idx")
    )


def ticket_by_category(
    scope: DataFrame, amount: str = "monto", k: int | None = None
) -> DataFrame:
    """Mean absolute amount per category, ascending; with `k` only the k greatest."""
    mean = as_double(F.sum(F.abs(F.col(amount)).try_cast("decimal(18,2)"))) / F.count(amount)
    tickets = (
        scope.filter(F.col("categoria").isNotNull())
        .groupBy("categoria")
        .agg(F.round(mean, 4).alias("ticket_prom"))
    )
    if k is not None:
        tickets = tickets.orderBy(F.desc_nulls_last("ticket_prom"), F.asc("categoria")).limit(k)
    return tickets.orderBy("ticket_prom", "categoria")


def month_compare(compare: DataFrame, month: str, amount: str = "monto") -> DataFrame:
    """Sum per category of the month ('Actual') and of the calendar month before ('Anterior')."""
    first = F.lit(f"{month}-01").cast("date")
    before = F.add_months(first, -1)
    label = F.when(F.col("fecha") >= first, "Actual").otherwise("Anterior")
    return (
        compare.filter(F.col("fecha").between(before, F.last_day(first)))
        .filter(F.col("categoria").isNotNull())
        .groupBy("categoria", label.alias("mes"))
        .agg(as_double(total(amount)).alias("total"))
        .orderBy("categoria", "mes")
    )


def month_compare_order(compare: DataFrame, month: str, amount: str = "monto") -> DataFrame:
    """Category order of the comparison: by 'Actual', without any 'Actual' by both months.

    The ranking window runs over one row per category.
    """
    by_category = (
        month_compare(compare, month, amount)
        .groupBy("categoria")
        .agg(
            F.max(F.when(F.col("mes") == "Actual", F.col("total"))).alias("actual"),
            F.sum("total").alias("ambos"),
        )
    )
    order = Window.orderBy(F.desc_nulls_last("actual"), F.desc("ambos"), F.asc("categoria"))
    return by_category.select(
        "categoria", "actual", F.row_number().over(order).alias("posicion")
    )


def monthly_trend(scope: DataFrame, amount: str = "monto") -> DataFrame:
    """Sum per month, ascending."""
    return (
        monthly_totals(scope, amount)
        .select("mes", as_double(F.col("total")).alias("monto"))
        .orderBy("mes")
    )
