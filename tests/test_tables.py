"""Month figures, views and table changes on tiny frames."""

import datetime as dt

from pyspark.sql import functions as F

from monedero.operators import metrics, mutate, projection, rules, views
from monedero.schema import IGNORED, LEDGER, TOMBSTONES


def ledger_of(spark, rows, schema):
    base = spark.createDataFrame(rows, schema)
    return base.select(
        *[
            F.col(f.name) if f.name in base.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in LEDGER
        ]
    )


def months_ledger(spark, rows):
    return ledger_of(spark, rows, "fecha date, categoria string, monto double")


def d(month, day=1, year=2024):
    return dt.date(year, month, day)


def test_month_change_cases(spark):
    one = months_ledger(spark, [(d(1), "A", -5.0), (None, "A", -9.0)])
    assert metrics.mom_change(one).first().texto == "n/a"
    zero = months_ledger(spark, [(d(1), "A", 0.0), (d(2), "A", -5.0)])
    assert metrics.mom_change(zero).first().texto == "nuevo mes sin base"
    gap = months_ledger(spark, [(d(1), "A", -100.0), (d(4), "A", -50.0)])
    row = metrics.mom_change(gap).first()
    assert (row.mes, row.pct, row.texto) == ("2024-04", -50.0, "-50.0% vs mes anterior")
    big = months_ledger(spark, [(d(1), "A", -1.0), (d(2), "A", -100.0)])
    assert metrics.mom_change(big).first().texto == "+9900.0% vs mes anterior"


def test_undated_rows_and_null_categories(spark):
    df = months_ledger(spark, [(None, "A", -9.0), (d(1), None, -1.0), (d(1, 31), "B", -2.0)])
    assert [(r.mes, r.monto) for r in metrics.monthly_trend(df).collect()] == [("2024-01", 3.0)]
    assert {r.categoria: r.total for r in metrics.spend_by_category(df).collect()} == {
        "A": 9.0, None: 1.0, "B": 2.0,
    }
    assert {r.categoria for r in metrics.freq_by_category(df).collect()} == {"A", "B"}
    assert metrics.daily_mean(df).first().dias == 31
    s = views.scopes(df)
    assert (s.view.count(), s.analysis.count(), s.compare.count()) == (2, 2, 3)


def test_empty_scope(spark):
    df = months_ledger(spark, [])
    assert metrics.total_spend(df).first().total == 0.0
    assert metrics.monthly_mean(df).first().promedio_mensual == 0.0
    assert metrics.daily_mean(df).first().promedio_diario == 0.0
    assert metrics.top_place(df).collect() == [] and metrics.top_places(df).collect() == []
    assert projection.projection(df, df).collect() == []
    assert projection.projection_totals(projection.projection(df, df)).first().total_proyectado == 0.0


def test_projection_rules(spark):
    rows = []
    for m in (1, 2, 3, 4):
        rows.append((d(m), "Fijo", -4000.0))
        rows.append((d(m), "Viajes", -9000.0))
    rows += [(d(1), "Vieja", -5000.0), (d(2), "Vieja", -5000.0)]
    rows += [(d(1), "Chica", -10.0), (d(2), "Chica", -10.0)]
    rows += [(d(4), "Una", -99999.0)]
    rows += [(d(2), "Ultimos", -1.0), (d(3), "Ultimos", -500.0), (d(4), "Ultimos", -1.0)]
    df = months_ledger(spark, rows)
    got = {r.categoria: r for r in projection.projection(df, views.filter_month(df, "2024-04")).collect()}
    assert set(got) == {"Fijo", "Vieja", "Ultimos"}
    assert (got["Fijo"].actual_mes, got["Fijo"].restante_estimado) == (4000.0, 0.0)
    assert (got["Vieja"].actual_mes, got["Vieja"].restante_estimado) == (0.0, 5000.0)


def test_month_compare_order_without_current_month(spark):
    df = months_ledger(spark, [(d(12, year=2023), "A", -1.0), (d(12, year=2023), "B", -2.0)])
    rows = metrics.month_compare_order(df, "2024-01").collect()
    assert [(r.categoria, r.posicion) for r in sorted(rows, key=lambda r: r.posicion)] == [("B", 1), ("A", 2)]


def test_row_type_by_sign(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,)], "monto double")
    assert {r.monto: r.tipo for r in views.row_type(df).collect()} == {1.0: "Abono", 0.0: "Cero", -1.0: "Gasto"}
    assert {r.tipo for r in views.row_type(df.filter("monto >= 0")).collect()} == {"Gasto"}


def test_sort_puts_nulls_last(spark):
    df = ledger_of(spark, [("a", 1.0), ("b", None), ("c", 2.0)], "unique_key string, monto double")
    assert [r.unique_key for r in views.table_sort(df, "monto", True).collect()] == ["c", "a", "b"]
    assert [r.unique_key for r in views.table_sort(df, "monto", False).collect()] == ["a", "c", "b"]


def keys_ledger(spark):
    return ledger_of(
        spark,
        [("k1", "1", "A", 10.0, None), ("k2", "1", "B", -3.0, 4.0), ("k3", "3", None, None, 5.0)],
        "unique_key string, id string, categoria string, monto double, monto_real double",
    )


def test_edits_by_key_and_id(spark):
    edits = spark.createDataFrame(
        [(1, "k1", "9", "X"), (2, " ", "1", "Y"), (3, "k2", "9", None), (4, None, None, "Z")],
        "seq int, unique_key string, id string, categoria string",
    )
    got = {r.unique_key: r.categoria for r in mutate.apply_edits(keys_ledger(spark), edits).collect()}
    assert got == {"k1": "Y", "k2": None, "k3": None}


def test_edit_values_are_read_like_stored_ones(spark):
    edits = spark.createDataFrame(
        [("k1", "Si", "x", "7"), ("k2", None, "2.5", None)],
        "unique_key string, es_gasto string, monto_real string, nota_usuario string",
    )
    got = {r.unique_key: (r.es_gasto, r.monto_real, r.nota_usuario) for r in mutate.apply_edits(keys_ledger(spark), edits).collect()}
    assert got == {"k1": (True, None, "7"), "k2": (None, 2.5, None), "k3": (None, 5.0, None)}


def test_delete_without_hit_leaves_no_tombstone(spark):
    ignored, tombs = spark.createDataFrame([], IGNORED), spark.createDataFrame([], TOMBSTONES)
    miss = spark.createDataFrame([("zz",), ("  ",)], "unique_key string")
    ledger, ign, tmb = mutate.delete_rows(keys_ledger(spark), ignored, tombs, miss)
    assert (ledger.count(), ign.count(), tmb.count()) == (3, 1, 0)
    ids = spark.createDataFrame([("1",)], "id string")
    ledger, ign, tmb = mutate.delete_rows(keys_ledger(spark), ignored, tombs, ids=ids)
    assert {r.unique_key for r in ledger.collect()} == {"k3"}
    assert {r.unique_key for r in tmb.collect()} == {"k1", "k2"}
    assert mutate.count_deleted(keys_ledger(spark), miss, ids).first().borradas == 2


def test_repair_and_draft(spark):
    fixed, count = mutate.repair_amounts(keys_ledger(spark))
    assert {r.unique_key: r.monto for r in fixed.collect()} == {"k1": 10.0, "k2": 4.0, "k3": 5.0}
    assert count.first().reparados == 2
    draft = spark.createDataFrame([("k1", None, "N")], "unique_key string, categoria string, nota_usuario string")
    over = {r.unique_key: (r.monto, r.categoria, r.nota_usuario) for r in mutate.overlay_draft(keys_ledger(spark), draft).collect()}
    assert over["k1"] == (10.0, None, "N") and over["k2"] == (-3.0, "B", None)
    assert [r.unique_key for r in mutate.restrict_to_draft(keys_ledger(spark), draft).collect()] == ["k1"]


def test_payload_parsing(spark):
    rows = [
        ("a", '{"detalle":"x","monto_real":0.0,"monto":"1,5"}'),
        ("b", '{"detalle":"","detalle_norm":"y","monto_real":2}'),
        ("c", "{broken"),
        ("d", None),
        ("e", '{"monto_real":"","monto":-7}'),
    ]
    ignored = spark.createDataFrame([(k, p, None) for k, p in rows], IGNORED)
    got = {r.unique_key: (r.nombre, r.monto) for r in mutate.parse_payload(ignored).collect()}
    assert got == {"a": ("x", 1.5), "b": ("y", 2.0), "c": ("", None), "d": ("", None), "e": ("", -7.0)}


def test_rename_refusals(spark):
    ledger = keys_ledger(spark)
    cats = spark.createDataFrame([("A",), ("B",)], "nombre string")
    rule_table = spark.createDataFrame([("x", "A")], "detalle_norm string, categoria string")
    for old, new in (("A", ""), ("A", "A"), ("Sin categoría", "Z")):
        assert rules.rename_category(ledger, rule_table, cats, old, new)[0] is ledger
    led, rul, lst = rules.rename_category(ledger, rule_table, cats, "A", "B")
    assert {r.nombre for r in lst.collect()} == {"B"}
    assert rul.first().categoria == "B"
    assert {r.unique_key: r.categoria for r in led.collect()}["k1"] == "B"
