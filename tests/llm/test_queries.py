"""Registered queries next to their SQL, and the pipeline against its stages' promises."""

import pytest

import corpus_pipeline
from monedero.llm import queries
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert difference(queries.queries()[name](spark, SF), duck(SF), queries.oracle_sql()[name]) == ""


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "copies", "taken"]
    assert 0 < out.count() <= docs.count() and out.where("copies not in (1, 2)").count() == 0
    assert out.where(r"text rlike 'token = .[0-9a-f]{40}'").count() == 0


def test_pipeline_keeps_rows_without_a_key_of_their_own(spark):
    text = lambda i: " ".join(f"w{i}_{j}" for j in range(20))
    rows = [(None, text(i)) for i in range(6)] + [(1, text(10)), (1, text(11)), (1, text(12))]
    rows += [(2, text(11)), (3, text(0)), (4, None), (4, ""), (5, text(20)), (5, text(20))]
    docs = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    left = corpus_pipeline.near_duplicates(spark, docs, SF)
    want = sorted(map(str, [*rows[1:9], *rows[10:14]]))
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == want
    mixed = corpus_pipeline.source_mixing(spark, left, SF).collect()
    # Total 1.5 of 10 texts of 20 words: every text once, half of them twice.
    assert sorted({str((r.doc_id, r.text)) for r in mixed}) == sorted(map(str, [r for r in [*rows[1:9], *rows[10:14]] if r[1]]))
    assert abs(sum(r.taken for r in mixed) - 300) <= 20 and sum(r.doc_id is None for r in mixed) == 5
    once = corpus_pipeline.source_mixing(spark, docs.where("doc_id = 5"), SF).collect()
    assert sum(r.taken for r in once) == 60
