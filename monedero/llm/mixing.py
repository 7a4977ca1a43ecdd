"""Mix sources to target token counts by entropy balancing.

Every source gets a target number of tokens. Among all document rates that meet
it, the chosen ones stay closest in relative entropy to one copy each: the rate
of a document is an exponential tilt of its size, `min(cap, exp(lambda * z))`.
One Newton step of the convex dual is one aggregate over (source, size) cells,
guarded by a bracket. Rates are rounded into whole copies by cumulative rounding
over the cells of a source, and copies are dealt to documents by rank, so no step
gathers a source or a cell in one task. Only SQL functions are used; sums are
exact decimals, so reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monedero.llm.common import WORD, Scratch

CAP = 2.0
TOTAL = 1.5
WEIGHTS = (5, 2, 1)
#: Documents of one (source, size) cell that are ranked together, in expectation.
CELL_ROWS = 512
_STEPS = 6
_MAX_STEPS = 120
_TOLERANCE = 1e-4
_REPAIRS = 4


def words(text: str = "text") -> Column:
    """Number of words between ASCII whitespace; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, scratch: Scratch, pattern=WEIGHTS) -> DataFrame:
    """`sources` with a weight that repeats `pattern` along the code-point order, null last.

    Places come from a range sort: a partition's rows are counted in its task, and
    only the counts of partitions are added up.
    """
    placed = scratch.stage(
        sources.withColumn("_null", F.col("source").isNull())
        .repartitionByRange("_null", "source")
        .sortWithinPartitions("_null", "source")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
        .withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1))
    )
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(w), F.lit(0)))
    place = F.col("_in") + F.col("_before")
    weight = reduce(
        lambda rest, i: F.when(place % len(pattern) == i, F.lit(pattern[i])).otherwise(rest),
        range(len(pattern)),
        F.lit(None).cast("int"),
    )
    return placed.join(parts, "_part").withColumn("weight", weight).drop("_null", "_at", "_part", "_in", "_before", "count")


def targets(sources: DataFrame, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """`sources` (source_size, weight) with `target`.

    The sources share `total` times all sizes by weight; a target above `cap` times
    its source stops there and the excess is shared again until none is above.
    """
    limit = F.col("source_size") * F.lit(cap)
    level = 0.0
    while True:
        above = limit <= F.col("weight") * F.lit(level)
        got = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, limit)).alias("stopped"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
        ).first()
        if not got["all"] or not got["weight"]:
            break
        higher = (total * got["all"] - (got["stopped"] or 0.0)) / float(got["weight"])
        if higher <= level:
            break
        level = higher
    if got["all"] and not got["weight"]:
        return sources.withColumn("target", limit)
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def _rate(cap: float) -> Column:
    tilt = F.least(F.lit(cap), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("size") / F.col("scale"))))
    return F.when(F.col("full"), F.lit(cap)).otherwise(tilt)


def solve(cells: DataFrame, sources: DataFrame, scratch: Scratch, cap: float = CAP) -> DataFrame:
    """`sources` (key, source_size, target) with the dual variable `lam` and its `scale`.

    `cells` holds (key, size, n). Newton steps run from 0 inside a bracket that each
    step narrows; a step that leaves it halves it instead.
    """
    moments = cells.groupBy("key").agg(
        (F.sum((F.col("size") * F.col("size") * F.col("n")).cast("decimal(38,0)")).cast("double")).alias("_square")
    )
    scale = F.greatest(F.lit(1.0), F.coalesce(F.try_divide("_square", "source_size"), F.lit(1.0)))
    state = (
        sources.join(moments, "key")
        .withColumn("scale", scale)
        .withColumn("full", F.col("target") >= F.col("source_size") * F.lit(cap))
        .withColumn("lam", F.lit(0.0))
        .withColumn("lo", F.col("scale") * -60.0)
        .withColumn("hi", F.col("scale") + 1.0)
        .withColumn("error", F.lit(float("inf")))
        .drop("_square")
    )
    kept = state.columns
    state = scratch.stage(state)
    for _ in range(0, _MAX_STEPS, _STEPS):
        for _ in range(_STEPS):
            state = _newton(cells, state, kept, cap)
        before, state = state, scratch.stage(state)
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst <= _TOLERANCE:
            break
    return state


def _newton(cells: DataFrame, state: DataFrame, kept: list[str], cap: float) -> DataFrame:
    tokens = F.col("n") * F.col("size") * _rate(cap)
    slope = F.when(_rate(cap) < cap, tokens * F.col("size") / F.col("scale")).otherwise(0.0)
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    summed = cells.join(state, "key").groupBy(*kept).agg(exact(tokens).alias("_g"), exact(slope).alias("_h"))
    off = F.col("_g") - F.col("target")
    step = F.col("lam") - F.try_divide(off, F.col("_h"))
    lo = F.when(off < 0, F.col("lam")).otherwise(F.col("lo"))
    hi = F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
    error = F.when(F.col("full") | (F.col("source_size") == 0), 0.0).otherwise(F.try_divide(F.abs(off), F.col("source_size")))
    return (
        summed.withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .withColumn("error", error)
        .withColumn(
            "lam",
            F.when(F.col("error") <= _TOLERANCE / 1000, F.col("lam"))
            .when((F.col("_h") > 0) & (step > F.col("_lo")) & (step < F.col("_hi")), step)
            .otherwise((F.col("_lo") + F.col("_hi")) / 2),
        )
        .select(*(F.col("_lo").alias("lo") if c == "lo" else F.col("_hi").alias("hi") if c == "hi" else c for c in kept))
    )


def cell_copies(cells: DataFrame, state: DataFrame, cap: float = CAP) -> DataFrame:
    """Whole copies `copies` that each (key, size) cell takes.

    The running sum of expected copies by size is rounded, so a source is off by at
    most about half a large document; then single copies are added or removed where
    that brings the source's tokens nearer to its target.
    """
    source = Window.partitionBy("key")
    by_size = source.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    most = (F.col("n") * cap).cast("long")
    out = (
        cells.join(state, "key")
        .withColumn("_expected", (F.col("n") * _rate(cap)).cast("decimal(28,9)"))
        .withColumn("_cum", F.sum("_expected").over(by_size))
        .withColumn(
            "copies",
            (F.floor(F.col("_cum") + F.expr("0.5BD")) - F.floor(F.col("_cum") - F.col("_expected") + F.expr("0.5BD"))).cast("long"),
        )
        .withColumn("copies", F.least(F.col("copies"), most))
    )
    for _ in range(_REPAIRS):
        rest = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(source)
        can = (F.col("size") > 0) & F.when(F.col("_rest") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        miss = F.abs(F.abs(F.col("_rest")) - F.col("size"))
        better = F.when(can & (miss < F.abs(F.col("_rest"))), F.struct(miss.alias("miss"), F.col("size").alias("size")))
        out = (
            out.withColumn("_rest", rest)
            .withColumn("_best", F.min(better).over(source))
            .withColumn(
                "copies",
                F.col("copies")
                + F.when(F.col("_best.size") == F.col("size"), F.signum("_rest").cast("long")).otherwise(0),
            )
        )
    return out.drop("_expected", "_cum", "_rest", "_best")


def mix(
    docs: DataFrame,
    scratch: Scratch,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    draw: str | None = None,
    weights: DataFrame | None = None,
    pattern: tuple[int, ...] = WEIGHTS,
    total: float = TOTAL,
    cap: float = CAP,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    `draw` names the column whose hash deals the copies, else the key does.
    `weights` (source, weight) overrides the repeating `pattern`; a source without a
    weight gets none of the mix. Null is a source of its own. Documents without
    words take no copies. Repeated documents are mixed one by one; an empty table
    gives no rows. Other columns of `docs` play no part.
    """
    rows = scratch.stage(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col(source).alias("source"),
            words(text).alias("size"),
            *([F.col(draw).alias("draw")] if draw else []),
        ).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    )
    cells = scratch.stage(rows.groupBy("key", "size").agg(F.count("*").alias("n")))
    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = cyclic_weights(sources, scratch, pattern)
    else:
        own = weights.select(
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("key"), "weight"
        )
        sources = sources.join(own, "key", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    sources = scratch.stage(sources)
    state = solve(cells, targets(sources, total, cap), scratch, cap)
    plan = scratch.stage(
        cell_copies(cells, state, cap)
        .select("key", "size", "n", "copies", "source_size", "target")
        .withColumn("parts", F.ceil(F.col("n") / CELL_ROWS))
    )
    # A document's rank in its cell: its rank in a part of the cell after the parts before.
    hashed = F.xxhash64(F.lit(3), F.col("draw" if draw else "doc_id"))
    dealt = rows.join(plan, ["key", "size"]).withColumn("part", F.pmod(hashed, F.col("parts")))
    in_cell = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.where("parts > 1")
        .groupBy("key", "size", "part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(in_cell), F.lit(0)))
        .drop("_n")
    )
    in_part = Window.partitionBy("key", "size", "part").orderBy(hashed, "doc_id")
    rank = F.row_number().over(in_part) + F.coalesce(F.col("_before"), F.lit(0))
    return (
        dealt.join(before, ["key", "size", "part"], "left")
        .withColumn("_rank", rank)
        .withColumn("copies", F.expr("((_rank * copies) div n) - (((_rank - 1) * copies) div n)"))
        .withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0)).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
