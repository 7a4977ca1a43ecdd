"""The jobs on the stored ledger: what they change, and which files they leave alone."""

import datetime as dt

import pytest

from monedero.operators import ingest as ing
from monedero.plans import changes, jobs
from monedero.plans.jobs import _next_months
from monedero.schema import MASTER, MatchConfig
from monedero.session import stage
from monedero.sources import store

ROWS = [
    ("2024-01-05", "cafe uno", "10"), ("2024-01-09", "pan", "20"), ("2024-02-01", "cine", "30"),
    ("2024-03-03", "bus", "40"), ("sin fecha", "algo", "50"),
]


@pytest.fixture()
def root(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("fecha,detalle,monto\n" + "".join(",".join(r) + "\n" for r in ROWS))
    jobs.run_upload(spark, str(folder), str(tmp_path / "s"))
    return str(tmp_path / "s")


def ledger(spark, root):
    return {r.detalle: r for r in store.load_ledger(spark, root).collect()}


def directories(spark, root, name="ledger"):
    return {p.rsplit("/mes=")[-1]: p for p in store.current(spark, root).tables[name]}


def keys_of(spark, root, *names):
    rows = ledger(spark, root)
    return spark.createDataFrame([(rows[n].unique_key,) for n in names], "unique_key string")


def test_an_edit_rewrites_its_months_only(spark, root):
    before, rows = directories(spark, root), ledger(spark, root)
    edits = spark.createDataFrame(
        [(rows["pan"].unique_key, None, "Comida", 1), (rows["pan"].unique_key, None, "Hogar", 2), ("", rows["algo"].id, "Otros", 3)],
        "unique_key string, id string, categoria string, seq int",
    )
    assert changes.run_edit(spark, root, edits) == {"editadas": 2}
    after = directories(spark, root)
    assert {m for m in before if before[m] != after[m]} == {"2024-01", "__HIVE_DEFAULT_PARTITION__"}
    now = ledger(spark, root)
    assert now["pan"].categoria == "Hogar" and now["algo"].categoria == "Otros" and now["cafe uno"].categoria == "Sin categoría"
    # Nothing found: nothing written.
    n = store.version(spark, root)
    none = spark.createDataFrame([("x", "a")], "unique_key string, categoria string")
    assert changes.run_edit(spark, root, none) == {"editadas": 0} and store.version(spark, root) == n


def test_deleted_rows_stay_out_when_uploaded_again(spark, root, tmp_path):
    assert changes.run_delete(spark, root, keys=keys_of(spark, root, "pan", "cine")) == {"borradas": 2}
    assert directories(spark, root).keys() == {"2024-01", "2024-03", "__HIVE_DEFAULT_PARTITION__"}
    again = jobs.run_upload(spark, str(tmp_path / "in"), root)
    assert again["insertadas"] == 0 and again["borradas"] == 2 and again["duplicadas"] == 3
    assert set(ledger(spark, root)) == {"cafe uno", "bus", "algo"}
    by_id = spark.createDataFrame([(ledger(spark, root)["bus"].id,)], "id string")
    assert changes.run_delete(spark, root, ids=by_id) == {"borradas": 1}
    assert store.load_tables(spark, root, "tombstones")[0].count() == 3


def test_a_key_without_a_row_is_ignored_but_no_tombstone(spark, root):
    keys = spark.createDataFrame([("k:nada",), (" ",), (None,)], "unique_key string")
    assert changes.run_delete(spark, root, keys=keys) == {"borradas": 0}
    ignored, tombs = store.load_tables(spark, root, "ignored", "tombstones")
    assert [r.unique_key for r in ignored.collect()] == ["k:nada"] and tombs.count() == 0


def interrupt(monkeypatch, action):
    """Run another writer just before the next commit."""
    real, done = store.commit, []

    def commit(*args, **kwargs):
        if not done:
            done.append(True)
            action()
        return real(*args, **kwargs)

    monkeypatch.setattr(store, "commit", commit)
    attempts = []
    current = store.current
    monkeypatch.setattr(store, "current", lambda *a: attempts.append(1) or current(*a))
    return attempts


def edit_of(spark, root, name, category):
    key = ledger(spark, root)[name].unique_key
    return spark.createDataFrame([(key, category)], "unique_key string, categoria string")


def test_writers_of_different_months_both_succeed(spark, root, monkeypatch):
    bus, pan = edit_of(spark, root, "bus", "Transporte"), edit_of(spark, root, "pan", "Comida")
    attempts = interrupt(monkeypatch, lambda: changes.run_edit(spark, root, bus))
    changes.run_edit(spark, root, pan)
    assert len(attempts) == 2  # one each: no one had to compute again
    monkeypatch.undo()
    now = ledger(spark, root)
    assert (now["bus"].categoria, now["pan"].categoria) == ("Transporte", "Comida") and len(now) == len(ROWS)


def test_writers_of_one_month_follow_each_other(spark, root, monkeypatch):
    cafe, pan = edit_of(spark, root, "cafe uno", "Café"), edit_of(spark, root, "pan", "Comida")
    attempts = interrupt(monkeypatch, lambda: changes.run_edit(spark, root, cafe))
    changes.run_edit(spark, root, pan)
    assert len(attempts) == 3
    monkeypatch.undo()
    now = ledger(spark, root)
    assert (now["cafe uno"].categoria, now["pan"].categoria) == ("Café", "Comida") and len(now) == len(ROWS)


def test_save_deletes_edits_and_teaches_the_next_upload(spark, root, tmp_path):
    view = store.load_ledger(spark, root).select("unique_key", "detalle", "monto_real", "categoria", "nota_usuario")
    before = view.withColumnRenamed("monto_real", "monto")
    after = before.filter("detalle <> 'cine'").replace({"Sin categoría": "Viajes"}, subset=["categoria"])
    assert changes.run_save(spark, root, before, after) == {"editadas": 4, "borradas": 1}
    assert {r.categoria for r in ledger(spark, root).values()} == {"Viajes"} and "cine" not in ledger(spark, root)
    (tmp_path / "b.csv").write_text("fecha,detalle,monto\n2024-05-01,bus,7\n2024-02-01,cine,30\n")
    assert jobs.run_upload(spark, str(tmp_path / "b.csv"), root)["borradas"] == 1
    new = store.load_ledger(spark, root, "2024-05-01", "2024-05-31").collect()
    assert [(r.detalle, r.categoria) for r in new] == [("bus", "Viajes")]


def test_manual_restore_repair_rename_decide(spark, root, tmp_path):
    entry = [("2024-02-02", "Regalo", 12.0, "Ocio", None), ("2024-02-02", " ", 1.0, None, None)]
    entries = spark.createDataFrame(entry, "fecha string, detalle string, monto double, categoria string, nota string")
    assert changes.run_manual(spark, root, entries) == {"insertadas": 1}
    assert changes.run_manual(spark, root, entries) == {"insertadas": 0}
    jobs.run_upload(spark, str(tmp_path / "in"), root)  # five duplicates, on the ignored list
    changes.run_edit(spark, root, edit_of(spark, root, "cine", "Ocio"))
    assert changes.run_restore(spark, root, keys_of(spark, root, "cine")) == {"restauradas": 1}
    assert ledger(spark, root)["cine"].categoria == "Sin categoría"
    assert store.load_tables(spark, root, "ignored")[0].count() == 4
    key = ledger(spark, root)["bus"].unique_key
    changes.run_edit(spark, root, spark.createDataFrame([(key, 44.0)], "unique_key string, monto_real double"))
    n = changes.run_repair(spark, root)["reparadas"]
    assert n >= 1 and ledger(spark, root)["bus"].monto == 44.0 and changes.run_repair(spark, root) == {"reparadas": 0}
    before = directories(spark, root)
    assert changes.run_rename(spark, root, "Ocio", "Placer") == {"renombradas": 1}
    assert {m for m, p in directories(spark, root).items() if before[m] != p} == {"2024-02"}
    listed = {r.nombre for r in store.load_tables(spark, root, "categories")[0].collect()}
    assert "Placer" in listed and "Ocio" not in listed
    decided = spark.createDataFrame([(key, "Transporte"), ("k:nada", "x"), (key, "Sin categoría")], "unique_key string, categoria string")
    assert changes.run_decisions(spark, root, decided) == {"decididas": 1}
    rules = {r.detalle_norm: r.categoria for r in store.load_tables(spark, root, "rules")[0].collect()}
    assert ledger(spark, root)["bus"].categoria == "Transporte" and rules == {"bus": "Transporte"}
    changes.run_learn(spark, root, spark.createDataFrame([("cine", "Ocio")], "detalle_norm string, categoria string"))
    assert store.load_tables(spark, root, "rules")[0].count() == 2


def test_an_upload_reads_its_own_months(spark, root, tmp_path, monkeypatch):
    seen = []
    table = store.Version.table

    def watched(self, name, months=None, **kw):
        if name == "ledger":
            seen.append(months)
        return table(self, name, months, **kw)

    monkeypatch.setattr(store.Version, "table", watched)
    (tmp_path / "b.csv").write_text("fecha,detalle,monto\n2024-02-01,cine,30\n2024-02-07,cine,31\n")
    counts = jobs.run_upload(spark, str(tmp_path / "b.csv"), root)
    assert (counts["insertadas"], counts["duplicadas"]) == (1, 1)
    assert ["2024-02"] in seen
    rows = store.current(spark, root).table("ledger", ["2024-02"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "mes" in plan and "2024-02" in plan
    assert {r.detalle for r in rows.collect()} == {"cine"}


def test_months_a_window_reaches():
    assert _next_months("2024-01", 21, 1) == {"2024-01", "2024-02"}
    assert _next_months("2024-01", 21, -1) == {"2024-01", "2023-12"}
    assert _next_months("2024-12", 40, 1) == {"2024-12", "2025-01", "2025-02"}
    assert _next_months(store.UNDATED, 21, 1) == {store.UNDATED}


def master_rows(spark, rows):
    names = "id string, fecha date, detalle_norm string, monto double, categoria string"
    df = spark.createDataFrame([(i, dt.date.fromisoformat(d) if d else None, n, m, c) for i, d, n, m, c in rows], names)
    return df.selectExpr("id", "fecha", "detalle_norm as detalle", "monto", "categoria", "detalle_norm")


BATCHES = [
    [("a", "2024-01-20", "UBER*1", -5000.0, "Taxi"), ("b", "2024-01-25", "CAFE*2", -900.0, None), ("c", "2024-05-01", "SALDO", 70.0, None)],
    [("d", "2024-02-05", "JULIA", 4500.0, None), ("e", "2024-02-06", "UBER*3", -20.0, None), ("b", "2024-01-25", "CAFE*2", -900.0, "Otra")],
    [("f", "2023-11-30", "UBER*4", -1.0, "Viejo"), ("g", None, "UBER*5", -2.0, "Nuevo"), ("h", "2024-01-10", "CAFE*9", -4700.0, "Bar")],
    [("i", "2024-03-01", "UBER*6", -3.0, None), ("j", "2024-03-02", "CAFE*6", -3.0, None)],
]


def test_master_in_batches_equals_whole_runs(spark, tmp_path):
    """Each run reads the months it can change; the result is that of runs over everything."""
    root = str(tmp_path / "m")
    rules = spark.createDataFrame([(0, None, None, "SALDO", "Banco")], "ord bigint, since date, since_id string, key string, categoria string")
    master, known = spark.createDataFrame([], MASTER), rules
    for batch in BATCHES:
        new = master_rows(spark, batch)
        before = directories(spark, root, "master") if store.version(spark, root) else {}
        learned = jobs.run_update_master(spark, new, root, rules, MatchConfig())
        whole, known_next = jobs.update_master(new, master, known, MatchConfig())
        master = spark.createDataFrame(whole.select(*MASTER.fieldNames()).collect(), MASTER)
        known = spark.createDataFrame(known_next.collect(), known.schema)
        assert sorted(map(str, store.load_master(spark, root).collect())) == sorted(map(str, master.collect()))
        assert sorted((r.key, r.categoria, r.ord) for r in learned.collect()) == sorted((r.key, r.categoria, r.ord) for r in known.collect())
        if len(before) > 2:
            assert directories(spark, root, "master")["2024-05"] == before["2024-05"]
    rows = {r.id: r for r in store.load_master(spark, root).collect()}
    assert rows["e"].categoria == "Taxi" and rows["i"].categoria == "Nuevo" and rows["c"].categoria == "Banco"
    assert rows["d"].match_id == "a"


def test_master_is_merged_once(spark):
    """The results read the merged rows; a plan that merges them again for each use holds the first row of every id."""
    rules = spark.createDataFrame([(0, None, None, "SALDO", "Banco")], "ord bigint, since date, since_id string, key string, categoria string")
    master = master_rows(spark, BATCHES[0] + BATCHES[0][:1])
    new = master_rows(spark, [*BATCHES[1], ("k", "2024-05-01", "SALDO", 5.0, None), ("k", "2024-05-01", "SALDO", 5.0, None)])
    merged, learned = jobs.update_master(new, master, rules, MatchConfig())
    got = {r.id: (r.categoria, r.match_id) for r in merged.collect()}
    assert got == {
        "a": ("Taxi", None), "b": (None, None), "c": (None, None), "d": (None, "a"), "e": (None, None), "k": ("Banco", None),
    }
    assert merged.count() == 6 and {(r.key, r.categoria) for r in learned.collect()} == {("SALDO", "Banco"), ("UBER", "Taxi")}
    for out in (merged, learned):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" not in plan and "min_by(" not in plan
    assert learned._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [key") == 1


def test_rows_of_single_ids_are_not_compared(spark, tmp_path):
    """Ids that come once pass as they are; the others, and rows without an id, give one row each."""
    root = str(tmp_path / "m")
    once = stage(master_rows(spark, BATCHES[0]))
    assert ing.once_per_id(once) is once
    again = stage(master_rows(spark, [*BATCHES[0], *BATCHES[1], (None, "2024-01-01", "X*1", 1.0, None), (None, None, "X*2", 2.0, None)]))
    want = ing.first_per_id(again).collect()
    assert len(want) == 6 and sorted(map(str, ing.once_per_id(again).collect())) == sorted(map(str, want))
    # A table not written yet takes no join: the planner knows that it is empty.
    empty = store.current(spark, root).table("master")
    assert empty.schema.names == MASTER.names and empty.count() == 0
    joined = once.join(empty.select("id"), "id", "left_anti").unionByName(empty, allowMissingColumns=True)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan
