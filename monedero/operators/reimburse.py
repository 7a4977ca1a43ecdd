"""Match credits to the earlier expenses they pay back.

For each credit the best expense is the one nearest in amount, then the newest,
then the smallest id, among those at most `window_days` older and within the
tolerance. Searching pairs would be quadratic wherever many rows share an amount
band, so the nearest neighbour is found by sorting instead:

1. Rows collapse to distinct (day, amount) cells; copies cost nothing after that.
   Expenses stand in units of one day and in blocks of several days, there with the
   newest day of each amount. A credit asks the blocks that lie inside its window and
   the single days before and after them, far fewer units than the window has days.
2. Inside one (unit, amount band) the expenses are sorted by amount and each knows the
   next one, so one more sort together with the questions gives the nearest expense
   below and above. An expense close to the edge of its band also appears in the next
   band, so a band never needs its neighbours.
3. A question keeps amount gap and age packed in one number, whose minimum per credit
   is the best of its units. Only the best meet the ids of the expenses.

A band holds at most one expense per cent of its width and unit, and one question per
cent and day whose window reaches the unit: windows are bounded whatever the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monedero.functions import money

# Bands this many tolerances wide keep the share of doubled expenses near one half.
_BAND_IN_TOLERANCES = 4
# Days of a block at most: cents and the day in its block are packed as cents * 8 + day.
_LONGEST_BLOCK = 8
_DAY_BITS = 3
# Which neighbour was nearest.
_BOTH, _BELOW, _ABOVE = 0, 1, 2


def cents(c: Column) -> Column:
    return (money(c) * 100).cast("bigint")


def _block_days(window_days: int) -> int:
    """The block length that keeps the units asked per credit few."""
    return min(max(round(math.sqrt(window_days + 1)), 1), _LONGEST_BLOCK)


def _units_of(day: Column, block: int) -> Column:
    """(size, start) of the units a day belongs to: itself and its block."""
    start = (day - F.pmod(day, F.lit(block))).cast("int")
    return F.array_distinct(
        F.array(
            F.struct(F.lit(1).alias("size"), day.alias("start")),
            F.struct(F.lit(block).alias("size"), start.alias("start")),
        )
    )


def units_asked(window_days: int, block: int, phase: int) -> list[tuple[int, int]]:
    """(size, start) of units that hold each day of the window once, as seen from its last day.

    `phase` is that day's place in its block.
    """
    oldest = phase - window_days

    def inside(start: int) -> bool:
        return start >= oldest and start + block - 1 <= phase

    days = [(1, d - phase) for d in range(oldest, phase + 1) if not inside(d - d % block)]
    return days + [(block, s - phase) for s in range(oldest - oldest % block, phase + 1, block) if inside(s)]


def _units_asked(day: Column, window_days: int, block: int) -> Column:
    """The units of `units_asked`, out of a constant table: (size, days from `day` to the start)."""
    table = F.array(
        *[
            F.array(
                *[
                    F.struct(F.lit(size).alias("size"), F.lit(start).alias("offset"))
                    for size, start in units_asked(window_days, block, phase)
                ]
            )
            for phase in range(block)
        ]
    )
    return F.get(table, F.pmod(day, F.lit(block)))


def best_expenses(df: DataFrame, window_days: int = 21, tol: float = 1000.0) -> DataFrame:
    """(fecha, cents, match_id, gap) for each distinct credit date and amount that finds an expense."""
    tol_cents = int(round(tol * 100))
    band = max(_BAND_IN_TOLERANCES * tol_cents, 1)
    block = _block_days(window_days)

    def band_of(c: Column) -> Column:
        return F.floor(c / F.lit(band)).cast("bigint")

    rows = df.filter(F.col("fecha").isNotNull()).select(
        "id", F.unix_date("fecha").alias("day"), "monto", cents(F.col("monto")).alias("c")
    )
    spent, paid = F.col("monto") < 0, F.col("monto") > 0
    rows = rows.filter(F.col("c").isNotNull() & (spent | paid))
    # One pass for the cells of both kinds: bit 0 for expenses, bit 1 for credits.
    cells = rows.groupBy("day", "c").agg(F.bit_or(F.when(spent, 1).otherwise(2)).alias("kinds"))
    nearby = F.array_distinct(
        F.array(
            band_of(F.col("c") - tol_cents), band_of(F.col("c")), band_of(F.col("c") + tol_cents)
        )
    )
    unit = ["size", "start", "band"]
    here = Window.partitionBy(*unit)
    ordered = here.orderBy("c")
    known = (
        cells.filter(F.col("kinds").bitwiseAND(F.lit(1)) != 0)
        .select("day", "c", F.inline(_units_of(F.col("day"), block)))
        .groupBy("size", "start", "c")
        .agg(F.max("day").alias("day"))
        .select("size", "start", F.explode(nearby).alias("band"), "c", "day")
        .withColumn("code", F.col("c") * (1 << _DAY_BITS) + (F.col("day") - F.col("start")))
        .withColumn("next", F.coalesce(F.lead("code").over(ordered), F.lit(-1)))
        .withColumn("first", F.lag("code").over(ordered).isNull())
    )
    # Amounts are never negative: -1 stands before the first expense, and for none.
    entry = F.struct("c", F.col("code").alias("below"), F.col("next").alias("above"))
    before = F.struct(
        F.lit(-1).cast("bigint").alias("c"), F.lit(-1).cast("bigint").alias("below"), F.col("code").alias("above")
    )
    expenses = known.select(
        *unit, F.inline(F.when(F.col("first"), F.array(before, entry)).otherwise(F.array(entry)))
    ).withColumn("asked", F.lit(None).cast("int"))
    credits = (
        cells.filter(F.col("kinds").bitwiseAND(F.lit(2)) != 0)
        .select(F.col("day").alias("asked"), "c", F.inline(_units_asked(F.col("day"), window_days, block)))
        .select("size", (F.col("asked") + F.col("offset")).alias("start"), band_of(F.col("c")).alias("band"), "c", "asked")
    )

    # At equal amounts the expense comes first, so it is always seen.
    so_far = here.orderBy("c", F.asc_nulls_first("asked")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    age_bits = window_days.bit_length()

    def candidate(side: str, gap: Column) -> Column:
        """Gap, then age, in one number with two bits left for the side."""
        day = F.col("start") + F.col(side).bitwiseAND(F.lit((1 << _DAY_BITS) - 1))
        packed = (gap * (1 << age_bits) + (F.col("asked") - day)) * 4
        return F.when((F.col(side) >= 0) & (gap <= tol_cents), packed)

    below = candidate("below", F.col("c") - F.shiftright("below", _DAY_BITS))
    above = candidate("above", F.shiftright("above", _DAY_BITS) - F.col("c"))
    best = (
        expenses.unionByName(credits, allowMissingColumns=True)
        .withColumn("below", F.last("below", ignorenulls=True).over(so_far))
        .withColumn("above", F.last("above", ignorenulls=True).over(so_far))
        .filter(F.col("asked").isNotNull())
        .select("asked", "c", below.alias("lo"), above.alias("hi"))
        .select(
            "asked",
            "c",
            F.when(F.col("lo") == F.col("hi"), F.col("lo") + _BOTH)
            .otherwise(F.least(F.col("lo") + _BELOW, F.col("hi") + _ABOVE))
            .alias("near"),
        )
        .filter(F.col("near").isNotNull())
        .groupBy("asked", "c")
        .agg(F.min("near").alias("near"))
    )
    side, gap = F.col("near").bitwiseAND(F.lit(3)), F.shiftright("near", age_bits + 2)
    age = F.shiftright("near", 2).bitwiseAND(F.lit((1 << age_bits) - 1))
    amounts = (
        F.when(side == _BELOW, F.array(F.col("c") - gap))
        .when(side == _ABOVE, F.array(F.col("c") + gap))
        .otherwise(F.array(F.col("c") - gap, F.col("c") + gap))
    )
    wanted = best.select(
        "asked", F.col("c").alias("cents"), gap.alias("gap"), (F.col("asked") - age).cast("int").alias("day"), F.explode(amounts).alias("c")
    )
    # An expense without an id comes before all others of its day and gap.
    ids = rows.filter(spent).groupBy("day", "c").agg(F.min("id").alias("gid"))
    return (
        wanted.join(ids, ["day", "c"])
        .groupBy("asked", "cents")
        .agg(F.min(F.struct("gid")).alias("best"), F.min("gap").alias("gap"))
        .select(
            F.date_from_unix_date("asked").alias("fecha"),
            "cents",
            F.col("best.gid").alias("match_id"),
            (F.col("gap") / 100.0).alias("gap"),
        )
    )


def match_reimbursements(
    df: DataFrame, window_days: int = 21, tol: float = 1000.0
) -> DataFrame:
    """Add `match_id`: the id of the expense a credit pays back, else NULL.

    One expense may serve several credits.
    """
    best = best_expenses(df, window_days, tol).select("fecha", F.col("cents").alias("_c"), "match_id")
    plain = df.drop("match_id")
    # Only credits meet the answers; all other rows pass by and are not shuffled.
    credit = F.coalesce((F.col("monto") > 0) & F.col("fecha").isNotNull(), F.lit(False))
    credits = plain.filter(credit).withColumn("_c", cents(F.col("monto")))
    answered = credits.join(best, ["fecha", "_c"], "left").select(*plain.columns, "match_id")
    others = plain.filter(~credit).withColumn("match_id", F.lit(None).cast("string"))
    return answered.unionByName(others)


def net_mine(df: DataFrame) -> DataFrame:
    """Recompute `es_gasto` and `monto_mio`; own transfers carry no amount of mine."""

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)

    fraction = F.when(flag("es_compartido_posible"), 0.5).otherwise(1.0)
    if "fraccion_mia" in df.columns:
        fraction = F.coalesce("fraccion_mia", fraction)
    is_expense = F.coalesce(F.col("monto") < 0, F.lit(False)) & ~flag("es_transferencia_o_abono")
    mine = F.when(is_expense & ~flag("es_entre_cuentas"), F.col("monto") * fraction)
    return df.withColumns(
        {
            "fraccion_mia": fraction,
            "es_gasto": is_expense,
            "monto_mio": F.coalesce(mine, F.lit(0.0)),
        }
    )
