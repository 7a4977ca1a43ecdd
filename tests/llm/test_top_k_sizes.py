"""Top-k search over components of any size, repeated ids and clashing columns."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from monedero.llm import mtree


def brute(rows, k=5):
    """Scores of whole vectors in Python integers; the smallest vector of a repeated query id is asked."""
    usable = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if i is not None and v]
    asked = {}
    for i, v in usable:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, own in asked.items():
        scores = [(-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in usable if i != q and len(v) == len(own)]
        for rank, (s, i) in enumerate(sorted(scores)[:k], 1):
            out.append((q, rank, i, -s if -(1 << 63) <= -s < 1 << 63 else None))
    return sorted(out)


def found(spark, rows):
    table = spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string")
    v = table.repartition(4).select("vec_id", mtree.quantised("embedding").alias("vector"))
    out = mtree.search(v, v.where("vec_id % 50 = 0"))
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("page", [2, 64])
def test_components_of_any_size(spark, monkeypatch, page):
    monkeypatch.setattr(mtree, "PAGE", page)
    draw = random.Random(page)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(1, 200)]
    # Just below and above what 64 bits hold, far beyond, and cancelling to small scores.
    rows += [(1000 + i, [draw.choice([-1, 1]) * 4_000_000.0 * draw.random() for _ in range(8)]) for i in range(40)]
    rows += [(2000 + i, [draw.choice([-1, 1]) * 5_000_000.0 * 2**i for _ in range(8)]) for i in range(25)]
    rows += [(3000, [1e30, -1e30, 0.5, 0, 0, 0, 0, 0]), (3001, [1e30, 1e30, 0.25, 0, 0, 0, 0, 0]), (3050, [3e38] * 8), (3051, [-3e38] * 8)]
    rows += [(3100, [1e300, -1e300] * 4), (3101, [1e300, 1e300] * 4)]
    assert found(spark, rows) == brute(rows)


def test_repeated_ids_and_equal_vectors(spark):
    rows = [(i % 60, [float(i % 7), 1.0, -float(i % 3)]) for i in range(240)] + [(None, [1.0, 1.0, 1.0]), (50, None), (100, [])]
    got, want = found(spark, rows), brute(rows)
    assert got == want


def test_a_component_no_double_holds_is_an_error(spark):
    with pytest.raises(Exception, match="largest double"):
        found(spark, [(0, [1e307, 1.0]), (1, [1.0, 1.0])])


def test_whole_numbers_are_floors(spark):
    values = [0.0, -0.0, 0.001, -0.001, 1.5, -1.5, 2.499 / 256, -2.5 / 256, 3.5 / 256, 1e20, -1e20]
    row = spark.createDataFrame([(values,)], "v array<double>").select(mtree.quantised("v").alias("q")).first()
    assert [int(x) for x in row.q] == [math.floor(Fraction(x) * 256) for x in values]
    odd = spark.createDataFrame([([1.0, None],), ([float("nan")],), ([float("inf")],), ([],), (None,)], "v array<double>")
    assert odd.select(mtree.quantised("v").alias("q")).where(F.col("q").isNotNull()).count() == 0
