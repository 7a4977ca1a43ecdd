"""Ingest against a row-by-row model, and its invariants."""

import datetime as dt
import random

from pyspark.sql import functions as F

from monedero import adapters
from monedero.operators import ingest as ing
from monedero.operators.mutate import delete_rows, restore_ignored
from monedero.schema import EXACT_RULES, IGNORED, LEDGER, TOMBSTONES

RAW = "source_file string, line_no bigint, fecha date, detalle string, detalle_norm string, monto double"


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def random_batch(seed, n):
    """Rows that clash a lot, many of them with blank text or without a date."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        detalle = r.choice(["***", "---", "café", "Cafe", "uber"])
        given = r.choice(["", "", "cafe", "***", "uber"])
        fecha = r.choice([dt.date(2024, 1, 1), dt.date(2024, 1, 2), None])
        rows.append((r.choice(["a.csv", "b.csv"]), i, fecha, detalle, given, r.choice([5.0, -5.0, 7.25])))
    return rows


def sequential(keyed, ledger):
    """The rows one at a time: a row enters unless its key or its signature is taken."""
    keys = {r.unique_key for r in ledger}
    signatures = {(r.fecha, r.detalle_norm, abs(r.monto)) for r in ledger if r.fecha}
    inserted, ignored = [], {}
    for r in sorted(keyed, key=lambda r: (r.source_file, r.line_no)):
        sig = (r.fecha, r.detalle_norm, abs(r.monto))
        if r.unique_key in keys or (r.fecha and sig in signatures):
            ignored.setdefault(r.unique_key, (r.source_file, r.line_no))
            continue
        keys.add(r.unique_key)
        signatures.add(sig)
        inserted.append((r.source_file, r.line_no))
    return sorted(inserted), ignored


def test_split_equals_sequential_inserts(spark):
    for seed in range(4):
        keyed = ing.compute_keys(ing.force_expense(spark.createDataFrame(random_batch(seed, 40), RAW)))
        stored = ing.compute_keys(
            ing.force_expense(spark.createDataFrame(random_batch(seed + 100, 3), RAW))
        )
        ledger = ing.to_ledger(stored).drop("source_file", "line_no")
        if seed % 2:
            # Corrected amounts: the signature then says something the key does not.
            ledger = ledger.withColumn("monto", F.lit(7.25))
        rows = ing.with_place(ing.to_ledger(keyed))
        inserted, duplicates = ing.split_batch(rows, ing.pick_winners(rows, ledger))
        got = sorted((r.source_file, r.line_no) for r in inserted.collect())
        want, want_ignored = sequential(keyed.collect(), ledger.collect())
        assert got == want, seed
        first = duplicates.groupBy("unique_key").agg(F.min(ing.place()).alias("p")).collect()
        assert {r.unique_key: tuple(r.p) for r in first} == want_ignored, seed


def run(spark, raw, ledger, ignored, tombstones):
    new, skipped, counts = ing.ingest(
        raw, ledger, ignored, tombstones, empty(spark, EXACT_RULES), "2024-01-01"
    )
    return ledger.unionByName(new), ignored.unionByName(skipped), counts.first().asDict()


def test_invariants(spark):
    raw = spark.createDataFrame(
        [
            ("a.csv", 1, dt.date(2024, 1, 1), "Café", "cafe", 12.5),
            ("a.csv", 2, dt.date(2024, 1, 1), "Café", "cafe", -12.50),
            ("a.csv", 3, dt.date(2024, 1, 1), "Uber", "uber", 3.0),
            ("a.csv", 4, None, "Uber", "uber", 3.0),
            ("a.csv", 5, None, "Uber", "uber", 3.0),
        ],
        RAW,
    )
    tables = empty(spark, LEDGER), empty(spark, IGNORED), empty(spark, TOMBSTONES)
    ledger, ignored, counts = run(spark, raw, *tables)
    assert counts == {"insertadas": 3, "duplicadas": 2, "borradas": 0, "ignoradas": 0}
    assert all(r.monto < 0 and r.es_gasto and r.categoria == "Sin categoría" for r in ledger.collect())

    # Ingesting again inserts nothing; what is on the ignored list is not even counted as duplicate.
    _, _, again = run(spark, raw, ledger, ignored, tables[2])
    assert again == {"insertadas": 0, "duplicadas": 1, "borradas": 0, "ignoradas": 4}

    # A deleted row stays out.
    uber = ledger.filter("detalle = 'Uber' and fecha is not null").select("unique_key")
    ledger2, ignored2, tombs = delete_rows(ledger, ignored, tables[2], uber)
    ledger3, _, counts = run(spark, raw, ledger2, ignored2, tombs)
    assert counts["borradas"] == 1 and ledger3.count() == ledger2.count() == 2

    # A restore undoes an ignore; entries without payload stay on the list.
    ledger4, left = restore_ignored(ledger2, ignored2)
    assert ledger4.count() == 2 and left.count() == 1


def test_empty_ledger_honours_only_manual_ignores(spark):
    raw = spark.createDataFrame(
        [("a.csv", 1, dt.date(2024, 1, 1), "x", "x", 1.0)], RAW
    )
    key = ing.compute_keys(raw).first().unique_key
    ignored = spark.createDataFrame([(key, None, None), ("id:7", None, None)], IGNORED)
    none = empty(spark, LEDGER)
    assert ing.drop_ignored(ing.compute_keys(raw), ignored, none).count() == 1
    some = ing.to_ledger(ing.compute_keys(raw)).drop("source_file", "line_no")
    assert ing.drop_ignored(ing.compute_keys(raw), ignored, some).count() == 0


def test_order_of_disjoint_files_does_not_change_the_keys(spark):
    rows = random_batch(3, 30)
    swapped = [("b.csv" if f == "a.csv" else "a.csv", *rest) for f, *rest in rows]
    results = []
    for batch in (rows, swapped):
        ledger, _, _ = run(
            spark, spark.createDataFrame([r for r in batch if r[4]], RAW),
            empty(spark, LEDGER), empty(spark, IGNORED), empty(spark, TOMBSTONES),
        )
        results.append({r.unique_key for r in ledger.collect()})
    assert results[0] == results[1]


def test_one_key_in_a_third_of_the_batch(spark):
    """A hot key gives one row, and no stage collects its copies: only minima are kept."""
    sf = "/root/testdata/sf0.001"
    batch = adapters.upload_batch(spark, sf)
    copies = F.sequence(F.lit(10_000_000).cast("bigint"), F.lit(10_000_999).cast("bigint"))
    hot = batch.limit(1).withColumn("line_no", F.explode(copies))
    rows = ing.with_place(ing.to_ledger(ing.compute_keys(ing.force_expense(batch.unionByName(hot)))))
    winners = ing.pick_winners(rows, empty(spark, LEDGER))
    assert winners.count() == batch.select("fecha", "detalle_norm", F.abs("monto")).distinct().count()
    plan = winners._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Window" not in plan and "SortAggregate" not in plan


def test_files_are_numbered_in_name_order(spark):
    rows = [(f"f{i * 37 % 101}.csv", i % 3) for i in range(303)]
    placed = ing.with_place(spark.createDataFrame(rows, "source_file string, line_no bigint").repartition(7))
    got = [(r.source_file, r.line_no) for r in placed.orderBy("_place").collect()]
    assert got == sorted(rows) and len(set(got)) == placed.select("_place").distinct().count()


def test_upsert_hashes_each_key_once(spark):
    """Both results are read from written rows; the keys are not computed again for every use."""
    rows = [
        ("a.csv", 1, dt.date(2024, 1, 1), "uber", "uber", -5.0),
        ("a.csv", 2, dt.date(2024, 1, 1), "Uber", "uber", 5.0),
        ("b.csv", 1, dt.date(2024, 1, 1), "UBER", "uber", 5.0),
        ("b.csv", 2, None, "---", "", 7.25),
    ]
    batch = ing.force_expense(spark.createDataFrame(rows, RAW))
    results = ing.upsert(batch, empty(spark, LEDGER), empty(spark, IGNORED), "2024-01-01")
    inserted, ignored = results
    assert sorted(r.detalle for r in inserted.collect()) == ["---", "uber"]
    assert [r.payload.count('"detalle":"Uber"') for r in ignored.collect()] == [1]
    for df in results:
        assert "sha2(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_ingest_results_share_written_rows(spark):
    """The deleted and the ignored rows are taken out one time, not for every result."""
    raw = spark.createDataFrame(random_batch(1, 20), RAW)
    ledger, ignored = empty(spark, LEDGER), empty(spark, IGNORED)
    deleted = ing.compute_keys(ing.force_expense(raw)).select(
        "unique_key", F.current_timestamp().alias("deleted_at")
    ).limit(1).localCheckpoint()
    inserted, entries, _ = ing.ingest(raw, ledger, ignored, deleted, empty(spark, EXACT_RULES), "2024-01-01")
    for df in (inserted, entries):
        assert "deleted_at" not in df._jdf.queryExecution().analyzed().toString()
