"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monedero.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int | None = None) -> DataFrame:
    """(id, root): every vertex of `edges` (a, b) with the smallest id of its component.

    With `rounds`, the search ends after so many: vertices with one root are then surely
    of one component, others may be too.

    Every round points each vertex at the one that comes first, in an order drawn
    anew, among its neighbours and theirs, and contracts the graph: a star goes in
    one round, and of chains a constant share of the vertices in expectation. Sums
    are taken per vertex before the shuffle; no vertex's edges are gathered.
    """
    live = scratch.stage(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    names, round_ = None, 0
    while (rounds is None or round_ < rounds) and not live.isEmpty():
        round_ += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(round_), c).alias("h"), c.alias("id"))  # noqa: B023, E731
        ends = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = scratch.stage(ends.groupBy("a").agg(F.min(F.least(order(F.col("a")), order(F.col("b")))).alias("m")))
        # What comes first for a vertex itself also stands before its neighbours.
        seen = ends.select(F.col("b").alias("_b"), "a").join(first.withColumnRenamed("a", "_b"), "_b")
        point = scratch.stage(seen.groupBy("a").agg(F.min("m").alias("m")).select("a", F.col("m.id").alias("p")))
        left = point.withColumnRenamed("p", "pa")
        right = point.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        shrunk = scratch.stage(
            live.join(left, "a").join(right, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        if names is None:
            new = point.select(F.col("a").alias("id"), F.col("p").alias("root"))
        else:
            step = point.select(F.col("a").alias("root"), "p")
            new = names.join(step, "root", "left").select("id", F.coalesce("p", "root").alias("root"))
        old, names = names, scratch.stage(new)
        scratch.drop(live, first, *([old] if old is not None else []))
        if old is not None:
            scratch.drop(point)
        live = shrunk
    if names is None:
        return live.select(F.col("a").alias("id"), F.col("b").alias("root"))
    least = names.groupBy("root").agg(F.min(F.least("id", "root")).alias("least"))
    out = scratch.stage(names.join(least, "root").select("id", F.col("least").alias("root")))
    scratch.drop(names, live)
    return out
