"""Statement files on disk, the store and the stream."""

import datetime as dt
import gzip
import json
import random
import re

import pytest

from monedero.plans import jobs
from monedero.session import settings
from monedero.sources import exports, statements, store
from monedero.schema import MatchConfig
from monedero.streaming import ingest_stream

LAYOUTS = {
    "a.csv": "Banco\nFecha;Detalle;Monto\n05/03/2024;Café Ñuñoa;-1.234,50\n06/03/2024;Abono;2.000,00\n",
    "b.csv": "fecha,glosa,cargo,abono\r\n05-03-2024,Café,1234.50,\r\n06-03-2024,Traspaso,,2000\r\n",
    "c.csv": "x\ny\nz\nFECHA\tDescripción y detalle\tImporte\n2024-03-05\tCafé\t-1234,5\n",
    "d.csv": 'Fecha|Comercio|Saldo\n05/03/2024|"Café | ""bar"" amigos"|-1234.50\n\n06/03/2024|x|1|sobra\n',
    "e.csv": "Dia;Texto libre;Monto\n05/03/24;Café dividido;-10\n",
}


@pytest.fixture()
def folder(tmp_path):
    for i, (name, text) in enumerate(LAYOUTS.items()):
        data = text.encode("utf-8-sig") if i % 2 == 0 else text.encode("cp1252")
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def blocks_of(spark, size):
    """Files are cut into blocks of at most `size` bytes."""
    return settings(spark, {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"})


def name_of(r):
    return r.source_file.rsplit("/", 1)[1]


def test_raw_statements_of_every_layout(spark, folder):
    got = {
        (name_of(r), r.fecha.isoformat(), r.detalle, r.monto)
        for r in statements.read_standardized(spark, folder).collect()
    }
    assert got == {
        ("a.csv", "2024-03-05", "Café Ñuñoa", -1234.5),
        ("a.csv", "2024-03-06", "Abono", 2000.0),
        ("b.csv", "2024-03-05", "Café", -1234.5),
        ("b.csv", "2024-03-06", "Traspaso", 2000.0),
        ("c.csv", "2024-03-05", "Café", -1234.5),
        ("d.csv", "2024-03-05", 'Café | "bar" amigos', -1234.5),
        ("e.csv", "2024-03-05", "Café dividido", -10.0),
    }
    flags = {name_of(r): r for r in statements.read_standardized(spark, folder).filter("monto < 0").collect()}
    assert flags["e.csv"].es_compartido_posible and flags["e.csv"].monto_mio == -5.0
    assert flags["d.csv"].es_compartido_posible and not flags["a.csv"].es_compartido_posible


def test_a_file_split_over_tasks_keeps_its_order(spark, tmp_path):
    n = 20000
    body = "".join(f"2024-01-{i % 28 + 1:02d};fila {i};{i}.25\n" for i in range(n))
    (tmp_path / "big.csv").write_text("fecha;detalle;monto\n" + body)
    with blocks_of(spark, 65536):
        lines = statements.read_lines(spark, str(tmp_path))
        rows = statements.upload_rows(lines).orderBy("line_no").collect()
        blocks = spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
    assert blocks > 3
    assert [r.detalle for r in rows] == [f"fila {i}" for i in range(n)]
    assert [(r.line_no, r.id) for r in rows] == [(i + 1, str(i + 1)) for i in range(n)]


def test_quoted_line_breaks_and_stray_quotes(spark, tmp_path):
    text = 'fecha;detalle;monto\r\n2024-01-01;"uno\r\ndos; ""tres""";1\n2024-01-02;tubo 5";2\n2024-01-03;x 7";3\n'
    (tmp_path / "q.csv").write_bytes(text.encode())
    rows = statements.read_statements(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.detalle, r.monto) for r in rows] == [('uno\ndos; "tres"', 1.0), ('tubo 5"', 2.0), ('x 7"', 3.0)]


def records_of(text):
    """Records of a whole file by one expression over its text."""
    text = "\n" + re.sub(r"\r\n?", "\n", text.removeprefix("\ufeff"))
    quoted = r'"(?:[^"]++|"")*+"'
    found = re.findall(rf'\n((?:[^\n"]++|(?<![^;,\t|\n]){quoted}|")*+)', text)
    return found[:-1] if found[-1] == "" else found


def records_read(spark, folder):
    got = {}
    for r in statements.read_lines(spark, str(folder)).collect():
        got.setdefault(name_of(r), {})[r.line_no] = r.line
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
    return {k: [v[i] for i in range(len(v))] for k, v in got.items()}


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_records_do_not_depend_on_the_block_size(spark, tmp_path, size):
    draw = random.Random(size)
    texts = {
        "never.csv": 'a;b\n1;"open\nx;y\n"" ;""\nz\n',
        "late.csv": 'a\n;"one\ntwo";"three\nfour\nfive" ;"\n',
        "long.csv": "\ufeffh1;h2\n" + 'x;"' + "in the cell\n" * 30 + '" end;y\nlast;1',
        "breaks.csv": 'a;b\r\n"1\r\n2";3\r4;tubo 5"\n\n\n"";""""\n',
        "latin.csv": "ñ;é\n\"á\nó\";ü\n",
    }
    for i in range(25):
        texts[f"{i}.csv"] = "".join(draw.choice(['"', '"', '""', "\n", "\n", ";", ",", "ab", "é", " "]) for _ in range(draw.randrange(1, 90))).lstrip("\ufeff")
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode("cp1252" if name == "latin.csv" else "utf-8"))
    with blocks_of(spark, size):
        got = records_read(spark, tmp_path)
    for name, text in texts.items():
        assert got.get(name, []) == records_of(text), name


def test_upload_aliases_and_rejected_files(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("Date,Glosa,Importe,categoria\n2024-02-08,Uber,\"1,234.50\",Ocio\n")
    (tmp_path / "parts.csv").write_text("fecha_mov;descripcion larga;monto clp;fraccion_mia\n2024-02-08;x;$ 5;0,5\n")
    (tmp_path / "bad.csv").write_text("fecha;otra\n2024-02-08;1\n")
    lines = statements.read_lines(spark, str(tmp_path))
    rows = {name_of(r): r for r in statements.upload_rows(lines, "YYYY-DD-MM").collect()}
    assert set(rows) == {"ok.csv", "parts.csv"}
    assert (rows["ok.csv"].fecha, rows["ok.csv"].monto, rows["ok.csv"].categoria) == (dt.date(2024, 8, 2), 1234.5, "Ocio")
    assert (rows["parts.csv"].detalle_norm, rows["parts.csv"].monto, rows["parts.csv"].fraccion_mia_sugerida) == ("X", 5.0, 0.5)
    bad = statements.rejected_files(lines).collect()
    assert [(name_of(r), r.missing) for r in bad] == [("bad.csv", ["detalle", "monto"])]


def test_rule_and_config_files(spark, tmp_path):
    names = {"LIME*VIAJE": "Transporte", "ÑAM": "Almuerzo", "A": "x"}
    (tmp_path / "m.json").write_text(json.dumps(names, ensure_ascii=False, indent=2))
    got = exports.read_merchant_rules(spark, str(tmp_path / "m.json")).orderBy("ord").collect()
    assert [(r.key, r.categoria) for r in got] == list(names.items())
    (tmp_path / "c.json").write_text('{"account_aliases": ["JULIA"],\n "reimbursement_window_days": 5, "other": [1]}')
    cfg = exports.read_match_config(spark, str(tmp_path / "c.json"))
    assert cfg == MatchConfig(("JULIA",), 5, 1000.0)


def write_csv(path, rows):
    path.write_text("fecha,detalle,monto\n" + "".join(f"{f},{t},{m}\n" for f, t, m in rows))


PARTS = [
    [("2024-01-01", "uber", 5), ("2024-01-02", "cafe", 7)],
    [("2024-01-01", "uber", 5), ("2023-12-31", "tarde", 1)],
    [("2024-02-01", "cafe", 7), ("2024-01-02", "cafe", 7), ("2024-02-01", "cafe", 7)],
]


def key_rows(df):
    return sorted((r.unique_key, r.detalle, r.monto) for r in df.collect())


def test_stream_in_batches_equals_one_upload(spark, tmp_path):
    one, folder = tmp_path / "one", tmp_path / "in"
    one.mkdir(), folder.mkdir()
    for i, rows in enumerate(PARTS):
        write_csv(one / f"{i}.csv", rows)
    counts = jobs.run_upload(spark, str(one), str(tmp_path / "s1"))
    assert counts == {"insertadas": 4, "duplicadas": 3, "borradas": 0, "ignoradas": 0, "rechazadas": 0}

    root = str(tmp_path / "s2")
    for i, rows in enumerate(PARTS):
        write_csv(folder / f"{i}.csv", rows)
        ingest_stream(spark, str(folder), root, str(tmp_path / "ck"), once=True).awaitTermination()
    assert store.version(spark, root) == 3
    assert key_rows(store.load_ledger(spark, root)) == key_rows(store.load_ledger(spark, str(tmp_path / "s1")))

    # Nothing new: no batch, no version.
    ingest_stream(spark, str(folder), root, str(tmp_path / "ck"), once=True).awaitTermination()
    assert store.version(spark, root) == 3


def test_an_unreadable_file_does_not_stop_the_stream(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "s")
    folder.mkdir()

    def run():
        ingest_stream(spark, str(folder), root, str(tmp_path / "ck"), once=True).awaitTermination()
        (files,) = store.load_tables(spark, root, "files")
        return {(r.path.rsplit("/", 1)[1], r.outcome, r.batch_id) for r in files.collect()}

    write_csv(folder / "a.csv", [("2024-01-01", "uber", 5)])
    (folder / "b.csv.gz").write_bytes(b"not compressed")
    (folder / "c.csv").write_text("fecha,otra\n2024-01-01,1\n")
    first = {("a.csv", "read", 0), ("b.csv.gz", "unreadable", 0), ("c.csv", "rejected", 0)}
    assert run() == first
    assert {r.detalle for r in store.load_ledger(spark, root).collect()} == {"uber"}
    # Still broken: tried again with the next batch, and set aside again.
    write_csv(folder / "d.csv", [("2024-01-02", "pan", 6)])
    second = first | {("d.csv", "read", 1), ("b.csv.gz", "unreadable", 1)}
    assert run() == second
    (folder / "b.csv.gz").write_bytes(gzip.compress(b"fecha,detalle,monto\n2024-01-03,cine,7\n"))
    write_csv(folder / "e.csv", [("2024-01-04", "bus", 8)])
    assert run() == second | {("b.csv.gz", "read", 2), ("e.csv", "read", 2)}
    assert {r.detalle for r in store.load_ledger(spark, root).collect()} == {"uber", "pan", "cine", "bus"}
    (folder / "f.csv.gz").write_bytes(b"bad")  # alone in its batch
    assert ("f.csv.gz", "unreadable", 3) in run()


def test_master_job_learns_for_the_next_run(spark, tmp_path):
    root = str(tmp_path / "store")
    rules = spark.createDataFrame(
        [(0, None, None, "UBER", "Transporte")],
        "ord bigint, since date, since_id string, key string, categoria string",
    )
    (tmp_path / "x.csv").write_text(
        "Fecha;Detalle;Monto\n01/03/2024;UBER*TRIP;-5000\n04/03/2024;JULIA transferencia;4500\n"
    )
    new = statements.read_standardized(spark, str(tmp_path / "x.csv"))
    cfg = MatchConfig(account_aliases=("julia",))
    learned = jobs.run_update_master(spark, new, root, rules, cfg)
    rows = {r.detalle_norm: r for r in store.load_master(spark, root).collect()}
    expense, credit = rows["UBER*TRIP"], rows["JULIA TRANSFERENCIA"]
    assert expense.categoria == "Transporte" and expense.es_gasto and expense.monto_mio == -5000.0
    assert credit.match_id == expense.id and credit.es_entre_cuentas and credit.monto_mio == 0.0
    assert [(r.key, r.categoria) for r in learned.collect()] == [("UBER", "Transporte")]
    jobs.run_update_master(spark, new, root, rules, cfg)
    assert store.load_master(spark, root).count() == 2


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    rules = spark.createDataFrame([("a", "b")], "detalle_norm string, categoria string")
    store.save_snapshot(rules, root, "rules")
    stale = store._latest(spark, root)
    store.commit(spark, root, append={"rules": rules})
    monkeypatch.setattr(store, "_latest", lambda *_: stale)
    with pytest.raises(store.Moved, match="already exists"):
        store.commit(spark, root, append={"rules": rules})
    monkeypatch.undo()
    assert store.version(spark, root) == 2
    assert store.load_tables(spark, root, "rules")[0].count() == 2


def test_result_of_an_older_version_is_refused(spark, tmp_path):
    root = str(tmp_path / "store")
    rules = spark.createDataFrame([("a", "b")], "detalle_norm string, categoria string")
    base = store.current(spark, root)
    assert store.commit(spark, root, append={"rules": rules}, base=base) == 1
    with pytest.raises(store.Moved, match="from version 0"):
        store.commit(spark, root, append={"rules": rules}, base=base)
    assert store.load_tables(spark, root, "rules")[0].count() == 1
    # What a table did not touch may have moved on.
    with pytest.raises(store.Moved):
        store.commit(spark, root, replace={"rules": rules}, base=base, reads=[])
    assert store.commit(spark, root, append={"rules": rules}, base=base, reads=["2024-01"]) == 2


def test_two_uploads_from_one_version_keep_each_key_once(spark, tmp_path, monkeypatch):
    """The second writer commits while the first computes; the first computes again."""
    root, file = str(tmp_path / "store"), tmp_path / "x.csv"
    file.write_text("fecha,glosa,monto\n2024-01-02,cafe,10\n2024-01-03,pan,20\n")
    real, other = store.commit, []

    def commit(*args, **kwargs):
        if not other:
            other.append(True)
            other.append(jobs.run_upload(spark, str(file), root))
        return real(*args, **kwargs)

    monkeypatch.setattr(store, "commit", commit)
    counts = jobs.run_upload(spark, str(file), root)
    assert other[1]["insertadas"] == 2 and counts["insertadas"] == 0 and counts["duplicadas"] == 2
    assert store.version(spark, root) == 2
    assert store.load_ledger(spark, root).count() == 2


def test_upload_stores_what_it_rejects(spark, tmp_path):
    root, folder = str(tmp_path / "store"), tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(
        "fecha,glosa,monto\n2024-01-02,cafe,1,234.50\n2024-01-02,te,99999999999999999999\n2024-01-03,pan,20\n"
    )
    (folder / "b.csv").write_text("fecha,glosa,saldo\n2024-01-02,cafe,1\n")
    counts = jobs.run_upload(spark, str(folder), root)
    assert counts["insertadas"] == 2 and counts["rechazadas"] == 3
    assert jobs.run_upload(spark, str(folder), root)["rechazadas"] == 3  # stored once
    assert store.load_tables(spark, root, "rejected")[0].count() == 3
    got = {
        (name_of(r), r.line_no, r.reason, r.line)
        for r in store.load_tables(spark, root, "rejected")[0].collect()
    }
    assert got == {
        ("a.csv", 1, "too many cells", "2024-01-02,cafe,1,234.50"),
        ("a.csv", 2, "amount too large", "2024-01-02,te,99999999999999999999"),
        ("b.csv", None, "missing: monto", None),
    }


def test_only_the_first_line_loses_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("\ufefffecha;monto\n\ufeffuno;1\n".encode())
    for size in (5, 1 << 20):
        with blocks_of(spark, size):
            got = statements.read_lines(spark, str(tmp_path / "x.csv")).orderBy("line_no").collect()
        assert [r.line for r in got] == ["fecha;monto", "\ufeffuno;1"], size
