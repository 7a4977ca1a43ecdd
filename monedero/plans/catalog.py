"""Named queries: every operator run over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monedero import adapters as a
from monedero import functions as fn
from monedero.operators import ingest as ing
from monedero.operators import metrics, mutate, projection, reimburse, rules, suggest, views
from monedero.plans import changes, jobs
from monedero.schema import LEDGER_COLUMNS, MASTER, MatchConfig
from monedero.session import settings, stage, work_dir
from monedero.sources import exports, statements, store
from monedero.streaming import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]

MONTH = "1998-03"
AT = "2024-01-01"
ALIASES = ("customer#0000000", "FURNITURE*NEW")
CONFIG = MatchConfig(account_aliases=ALIASES)

_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _view(spark, sf) -> DataFrame:
    return views.scopes(a.ledger_orders(spark, sf)).view


def _compare(spark, sf) -> DataFrame:
    return views.scopes(a.ledger_orders(spark, sf)).compare


# --- sources, sinks, snapshots ----------------------------------------------


@query
def read_statements(spark, sf):
    rows = statements.upload_rows(a.upload_lines(spark, sf))
    return rows.drop("line_no")


@query
def read_statement_files(spark, sf):
    """Every order written as CSV files and read back as an upload."""
    folder = work_dir(spark)
    a.ledger_orders(spark, sf).select("fecha", "detalle", "monto").write.option(
        "header", True
    ).csv(folder)
    return statements.read_statements(spark, folder).select(
        "fecha", "detalle", "monto", "detalle_norm"
    )


@query
def read_statement_files_split(spark, sf):
    """Files with quoted line breaks, cut by Spark into many blocks."""
    folder = work_dir(spark)
    a.write_broken_files(spark, sf, folder)
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "65536", "spark.sql.files.openCostInBytes": "1"}):
        rows = stage(statements.read_statements(spark, folder))
    file = F.regexp_extract("source_file", "archivo=([0-9]+)", 1).cast("int")
    return rows.select(file.alias("archivo"), "id", "fecha", "detalle", "monto")


@query
def rejected_rows(spark, sf):
    return statements.rejected_rows(a.flawed_lines(spark, sf))


@query
def decode_files(spark, sf):
    docs = a.table(spark, sf, "documents")
    western = F.col("text").rlike(r"^[\x{00}-\x{7f}\x{a0}-\x{ff}]*$")
    stored = F.when(western, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    raw = docs.select("doc_id", stored.cast("string").alias("value"))
    text = statements.decode_text(F.col("value"), F.is_valid_utf8("value"))
    return raw.select("doc_id", F.md5(text).alias("huella"), F.length(text).alias("largo"))


@query
def sniff_delimiter(spark, sf):
    docs = a.table(spark, sf, "documents")
    lines = docs.select(
        F.col("doc_id").cast("string").alias("source_file"),
        F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"),
    )
    return statements.sniff_delimiter(lines)


@query
def find_header(spark, sf):
    lines = a.statement_lines(spark, sf)
    return statements.find_header(lines, statements.sniff_delimiter(lines))


@query
def column_roles(spark, sf):
    lines = a.statement_lines(spark, sf)
    return statements.column_roles(lines, statements.file_layouts(lines)).select(
        "source_file", "delim", "fecha", "detalle", "abono", "cargo", "monto"
    )


@query
def standardize(spark, sf):
    rows = statements.standardize_lines(a.statement_lines(spark, sf))
    return rows.drop("line_no")


@query
def export_standardized(spark, sf):
    rows = a.movements_orders(spark, sf).select("fecha", "detalle", "monto")
    return exports.standardized_sorted(statements.standardize(rows))


@query
def store_snapshot(spark, sf):
    root = work_dir(spark)
    ledger = a.ledger_orders(spark, sf)
    credit = F.col("monto") > 0
    store.save_snapshot(ledger.filter(credit), root)
    store.commit(spark, root, append={"ledger": ledger.filter(~credit)})
    return store.load_ledger(spark, root)


@query
def export_backup(spark, sf):
    return exports.backup_rows(a.ledger_orders(spark, sf))


@query
def export_enriched(spark, sf):
    """The edited table written as CSV and read back."""
    folder = work_dir(spark)
    table = views.editable_view(_view(spark, sf), a.categories(spark, sf))
    exports.export_csv(table, folder)
    schema = "fecha date, detalle string, monto double, categoria string, nota_usuario string, unique_key string"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(
        folder
    ).withColumn("nota_usuario", F.coalesce("nota_usuario", F.lit("")))


@query
def ledger_profile(spark, sf):
    return exports.ledger_profile(a.ledger_orders(spark, sf), a.ignored_rows(spark, sf))


# --- row-wise cleaning ------------------------------------------------------


def _normal_form(form):
    def run(spark, sf):
        return a.raw_text(spark, sf).select("kind", "id", form(F.col("text")).alias("norm"))

    return run


_QUERIES["norm_db"] = _normal_form(fn.norm_db)
_QUERIES["norm_cli"] = _normal_form(fn.norm_cli)
_QUERIES["norm_alnum"] = _normal_form(fn.norm_alnum)


def _parsed(name, parse, column):
    def run(spark, sf):
        return a.raw_orders(spark, sf).select("o_orderkey", parse(F.col(column)).alias(name))

    return run


_QUERIES["amount_cli"] = _parsed("monto", fn.amount_cli, "amount_text")
_QUERIES["amount_app"] = _parsed("monto", fn.amount_app, "amount_text")
_QUERIES["amount_sep"] = _parsed("monto", lambda c: fn.amount_sep(c, ","), "amount_text")
_QUERIES["date_cli"] = _parsed("fecha", fn.date_cli, "date_text")
_QUERIES["date_app"] = _parsed("fecha", fn.date_app, "date_text")
_QUERIES["date_app_ydm"] = _parsed(
    "fecha", lambda c: fn.date_app(c, "YYYY-DD-MM"), "date_text"
)


@query
def flags_truthy(spark, sf):
    flag = F.col("flag_text")
    return a.raw_orders(spark, sf).select(
        "o_orderkey", fn.truthy(flag).alias("subida"), fn.truthy_stored(flag).alias("guardada")
    )


@query
def signed_amount(spark, sf):
    o = a.raw_orders(spark, sf)
    amount = fn.amount_cli(F.col("amount_text"))
    credit = F.when(F.col("o_orderstatus") == "P", amount)
    debit = F.when(F.col("o_orderstatus") == "F", amount)
    sides = F.col("o_orderpriority") != "5-LOW"
    return o.select(
        "o_orderkey", statements.signed_amount(credit, debit, amount, sides).alias("monto")
    )


@query
def flag_transfer(spark, sf):
    norm = fn.norm_cli(F.col("detalle"))
    return _flag_texts(spark, sf).select("o_orderkey", fn.flag_transfer(norm).alias("transferencia"))


@query
def flag_shared(spark, sf):
    norm = fn.norm_cli(F.col("detalle"))
    return _flag_texts(spark, sf).select("o_orderkey", fn.flag_shared(norm).alias("compartido"))


def _flag_texts(spark, sf):
    words = [
        "Traspaso a", "transferencia de", "abono", "abonos", "Reembolso", "REVERSA", "cashback",
        "pago tc", "pago cuenta", "dividido con", "compartida", "amigos", "amigosos", "sub-traspaso",
        "cena con amigos",
    ]
    word = F.get(F.array(*[F.lit(w) for w in words]), (F.col("o_orderkey") % 15).cast("int"))
    return a.raw_orders(spark, sf).select(
        "o_orderkey", F.concat_ws(" ", F.col("o_orderpriority"), word).alias("detalle")
    )


@query
def my_share(spark, sf):
    fraction, mine = fn.my_share(F.col("monto"), F.col("es_compartido_posible"))
    return a.ledger_orders(spark, sf).select(
        "id", fraction.alias("fraccion_mia"), mine.alias("monto_mio")
    )


@query
def cli_id(spark, sf):
    m = a.movements_orders(spark, sf)
    norm = fn.norm_cli(F.col("detalle"))
    return m.select(
        F.col("id").alias("orden"), fn.cli_id(F.col("fecha"), norm, F.col("monto")).alias("id")
    )


@query
def ledger_key(spark, sf):
    return ing.compute_keys(a.movements_orders(spark, sf).drop("detalle_norm")).select(
        "id", "detalle_norm", "monto_cartola", "unique_key"
    )


@query
def manual_key(spark, sf):
    m = a.movements_orders(spark, sf)
    norm = fn.norm_alnum(F.col("detalle"))
    return m.select("id", fn.manual_key(F.col("fecha"), F.col("monto"), norm).alias("unique_key"))


@query
def force_expense(spark, sf):
    return ing.force_expense(a.movements_orders(spark, sf)).select(
        "id", "monto", "monto_cartola", "tipo", "es_gasto", "es_transferencia_o_abono", "es_compartido_posible"
    )


@query
def default_real(spark, sf):
    real = ing.default_real(
        F.nullif(F.col("monto_real"), F.lit(0.0)),
        F.when(F.col("es_compartido_posible"), F.col("monto_mio_estimado")),
        F.col("monto"),
    )
    return a.ledger_orders(spark, sf).select("id", real.alias("monto_real"))


@query
def row_type(spark, sf):
    ledger = a.ledger_orders(spark, sf)

    def typed(df, basis):
        return views.row_type(df).select("id", F.lit(basis).alias("base"), "tipo")

    transfer = ledger.select("id", "monto", "es_transferencia_o_abono")
    positive = ledger.select("id", F.abs("monto").alias("monto"))
    return (
        typed(ledger, "gasto")
        .unionByName(typed(transfer, "transferencia"))
        .unionByName(typed(ledger.select("id", "monto"), "signo"))
        .unionByName(typed(positive, "positivos"))
    )


@query
def effective_amount(spark, sf):
    amount = views.effective_amount(F.col("monto_real"), F.col("monto"))
    return a.ledger_orders(spark, sf).select("id", amount.alias("monto"))


@query
def category_reset(spark, sf):
    return views.reset_unknown_category(
        a.ledger_orders(spark, sf), a.categories(spark, sf)
    ).select("id", "categoria")


@query
def ignored_parsed(spark, sf):
    return mutate.ignored_listing(a.ignored_rows(spark, sf)).select("unique_key", "nombre", "monto")


# --- ingest and table changes -----------------------------------------------


def _ingest(spark, sf):
    """The upload as it runs on stored tables."""
    return ing.ingest(
        a.upload_batch(spark, sf),
        stage(a.stored_ledger(spark, sf)),
        stage(a.ignored_rows(spark, sf)),
        stage(a.deleted_keys(spark, sf)),
        stage(a.exact_rules(spark, sf)),
        AT,
    )


@query
def ingest(spark, sf):
    return _ingest(spark, sf)[0]


def _payload_fields(ignored: DataFrame) -> DataFrame:
    def field(name):
        return F.get_json_object("payload", f"$.{name}").alias(name)

    return ignored.select("unique_key", field("detalle"), field("nota_usuario"), field("categoria"))


@query
def ingest_ignored(spark, sf):
    return _payload_fields(_ingest(spark, sf)[1])


@query
def ingest_counts(spark, sf):
    return _ingest(spark, sf)[2]


@query
def tombstone_filter(spark, sf):
    keyed = ing.compute_keys(a.upload_batch(spark, sf))
    return ing.drop_tombstoned(keyed, a.deleted_keys(spark, sf)).select("unique_key", "line_no")


@query
def ignored_filter(spark, sf):
    keyed = ing.compute_keys(a.upload_batch(spark, sf))
    return ing.drop_ignored(
        keyed, a.ignored_rows(spark, sf), a.stored_ledger(spark, sf)
    ).select("unique_key", "line_no")


@query
def ignored_filter_empty_ledger(spark, sf):
    keyed = ing.compute_keys(a.upload_batch(spark, sf))
    empty = a.stored_ledger(spark, sf).filter("monto > 0")
    return ing.drop_ignored(keyed, a.ignored_rows(spark, sf), empty).select("unique_key", "line_no")


def _upsert(spark, sf):
    return ing.upsert(
        ing.force_expense(stage(a.upload_batch(spark, sf))),
        stage(a.stored_ledger(spark, sf)),
        stage(a.ignored_rows(spark, sf)),
        AT,
    )


@query
def upsert_inserted(spark, sf):
    return _upsert(spark, sf)[0].select("unique_key", "fecha", "detalle", "monto", "nota_usuario", "categoria")


@query
def upsert_ignored(spark, sf):
    return _payload_fields(_upsert(spark, sf)[1])


@query
def dedup_latest(spark, sf):
    ledger = a.ledger_orders(spark, sf)
    later = ledger.filter("monto_real > 0").withColumns(
        {"fecha": F.date_add("fecha", 7), "nota_usuario": F.lit("movida")}
    )
    return ing.dedup_latest(ledger.unionByName(later))


@query
def master_merge(spark, sf):
    m = a.master_orders(spark, sf)
    master = m.filter("estado <> 'O'").withColumn("categoria", F.lit("vieja"))
    return ing.merge_master(master, m.unionByName(m)).select("id", "fecha", "monto", "categoria")


def _edits(spark, sf):
    """Two edits per credit, by key; one edit per open order, by id."""
    m = a.movements_orders(spark, sf).select("id", "estado")
    ledger = a.ledger_orders(spark, sf).join(m, "id")
    first = ledger.filter("monto > 0").select(
        "unique_key", "id", F.lit(1).alias("seq"), F.lit("Antes").alias("categoria"),
        F.lit(5.0).alias("monto_real"), F.lit("uno").alias("nota_usuario"),
    )
    second = ledger.filter("monto > 0").select(
        "unique_key", "id", F.lit(2).alias("seq"), F.lit(None).cast("string").alias("categoria"),
        (F.col("monto") / 2).alias("monto_real"), F.lit("dos").alias("nota_usuario"),
    )
    by_id = ledger.filter("estado = 'O'").select(
        F.lit("").alias("unique_key"), "id", F.lit(3).alias("seq"), F.lit("Ocio").alias("categoria"),
        F.lit(None).cast("double").alias("monto_real"), F.lit(None).cast("string").alias("nota_usuario"),
    )
    return first.unionByName(second).unionByName(by_id)


@query
def apply_edits(spark, sf):
    return mutate.apply_edits(a.ledger_orders(spark, sf), _edits(spark, sf)).select(
        "id", "unique_key", "categoria", "monto_real", "nota_usuario"
    )


def _delete(spark, sf):
    m = a.movements_orders(spark, sf)
    ledger = a.ledger_orders(spark, sf)
    keys = ledger.filter("monto > 0").select("unique_key")
    ids = m.filter("prioridad = '1-URGENT'").select("id")
    return ledger, keys, ids, mutate.delete_rows(
        ledger, a.ignored_rows(spark, sf), a.deleted_keys(spark, sf), keys, ids, AT
    )


@query
def delete_rows(spark, sf):
    return _delete(spark, sf)[3][0].select("id", "unique_key")


@query
def ignored_after_delete(spark, sf):
    return _delete(spark, sf)[3][1].select(
        "unique_key", F.col("payload").isNull().alias("sin_datos")
    )


@query
def tombstones_after(spark, sf):
    return _delete(spark, sf)[3][2].select("unique_key")


@query
def count_deleted(spark, sf):
    ledger, keys, ids, _ = _delete(spark, sf)
    return mutate.count_deleted(ledger, keys, ids)


@query
def save_diff(spark, sf):
    """Ledger after saving a table without its credits and with every note changed."""
    ledger = a.ledger_orders(spark, sf)
    before = views.editable_view(ledger, a.categories(spark, sf))
    is_credit = ledger.filter("monto > 0").select("unique_key")
    after = before.join(is_credit, "unique_key", "left_anti").withColumn(
        "nota_usuario", F.lit("editada")
    )
    edits, gone = mutate.save_diff(before, after)
    edited = mutate.apply_edits(ledger, edits)
    kept, _, _ = mutate.delete_rows(
        edited, a.ignored_rows(spark, sf), a.deleted_keys(spark, sf), gone, at=AT
    )
    return kept.select("unique_key", "categoria", "monto_real", "nota_usuario")


def _entries(spark, sf):
    m = a.movements_orders(spark, sf)
    return m.select(
        "fecha",
        F.when(F.col("prioridad") == "5-LOW", "  ").otherwise(F.concat(F.lit(" "), "detalle")).alias("detalle"),
        F.when(F.col("prioridad") == "3-MEDIUM", 0.0).otherwise(F.col("monto")).alias("monto"),
        "categoria",
        F.col("nota_usuario").alias("nota"),
        F.col("orden").alias("seq"),
    )


@query
def manual_append(spark, sf):
    once = _entries(spark, sf)
    again = once.withColumns({"seq": F.col("seq") + 1_000_000_000_000, "nota": F.lit("otra vez")})
    ledger = a.ledger_orders(spark, sf)
    held = mutate.manual_rows(once.filter("monto > 0"))
    start = ledger.unionByName(held.select(*LEDGER_COLUMNS))
    return mutate.append_manual(start, once.unionByName(again)).select(
        "unique_key", "fecha", "detalle", "detalle_norm", "monto", "monto_real", "categoria", "nota_usuario"
    )


def _restore(spark, sf):
    ledger = a.ledger_orders(spark, sf).filter("monto < 0").withColumn("nota_usuario", F.lit("actual"))
    deleted = a.deleted_keys(spark, sf).select(
        "unique_key", F.lit(None).cast("string").alias("payload"), F.col("deleted_at").alias("created_at")
    )
    ignored = a.ignored_rows(spark, sf).unionByName(deleted)
    return mutate.restore_ignored(ledger, ignored)


@query
def restore_ignored(spark, sf):
    return _restore(spark, sf)[0]


@query
def ignored_after_restore(spark, sf):
    return _restore(spark, sf)[1].select("unique_key")


@query
def repair_amounts(spark, sf):
    return mutate.repair_amounts(a.ledger_orders(spark, sf))[0].select("id", "monto", "monto_real")


@query
def repair_count(spark, sf):
    return mutate.repair_amounts(a.ledger_orders(spark, sf))[1]


def _draft(spark, sf):
    return a.ledger_orders(spark, sf).filter("monto > 0").select(
        "unique_key",
        (F.col("monto") * 2).alias("monto"),
        F.when(F.col("monto_real") > 0, "Borrador").alias("categoria"),
        F.lit("borrador").alias("nota_usuario"),
    )


@query
def draft_overlay(spark, sf):
    return mutate.overlay_draft(_view(spark, sf), _draft(spark, sf)).select(
        "unique_key", "monto", "categoria", "nota_usuario"
    )


@query
def draft_restrict(spark, sf):
    table = views.editable_view(_view(spark, sf), a.categories(spark, sf))
    return mutate.restrict_to_draft(table, _draft(spark, sf))


@query
def ingest_stream_ledger(spark, sf):
    """Every order written as CSV files, streamed into an empty store."""
    root = work_dir(spark)
    folder = f"{root}/entrada"
    a.ledger_orders(spark, sf).select("fecha", "detalle", "monto").write.option(
        "header", True
    ).csv(folder)
    stream = ingest_stream(spark, folder, f"{root}/store", f"{root}/stream", once=True)
    stream.awaitTermination()
    return store.load_ledger(spark, f"{root}/store").select(
        "unique_key", "fecha", "detalle", "monto", "es_gasto", "categoria"
    )


# --- stored jobs ------------------------------------------------------------


def _stored(spark, **tables: DataFrame) -> str:
    """A new store that holds the tables."""
    root = work_dir(spark)
    store.commit(spark, root, append=tables)
    return root


@query
def job_edit(spark, sf):
    root = _stored(spark, ledger=a.ledger_orders(spark, sf))
    changes.run_edit(spark, root, _edits(spark, sf))
    return store.load_ledger(spark, root).select("id", "unique_key", "categoria", "monto_real", "nota_usuario")


@query
def job_delete_reimport(spark, sf):
    """The urgent rows deleted, then all orders uploaded again: what was deleted stays out."""
    root = _stored(spark, ledger=a.stored_ledger(spark, sf))
    m = a.movements_orders(spark, sf).select("id", "prioridad")
    urgent = a.stored_ledger(spark, sf).join(m, "id").filter("prioridad = '1-URGENT'")
    changes.run_delete(spark, root, keys=urgent.select("unique_key"), at=AT)
    folder = work_dir(spark)
    a.ledger_orders(spark, sf).select("fecha", "detalle", "monto").write.option("header", True).csv(folder)
    jobs.run_upload(spark, folder, root, at=AT)
    return store.load_ledger(spark, root).select("unique_key", "fecha", "monto")


@query
def job_save(spark, sf):
    """The table saved without its credits and with every note changed."""
    ledger = a.ledger_orders(spark, sf)
    root = _stored(spark, ledger=ledger)
    before = views.editable_view(ledger, a.categories(spark, sf))
    credits = ledger.filter("monto > 0").select("unique_key")
    after = before.join(credits, "unique_key", "left_anti").withColumn("nota_usuario", F.lit("editada"))
    changes.run_save(spark, root, before, after, AT)
    return store.load_ledger(spark, root).select("unique_key", "categoria", "monto_real", "nota_usuario")


@query
def job_manual(spark, sf):
    root = _stored(spark, ledger=a.ledger_orders(spark, sf))
    once = _entries(spark, sf)
    changes.run_manual(spark, root, once.filter("monto > 0"))
    again = once.withColumns({"seq": F.col("seq") + 1_000_000_000_000, "nota": F.lit("otra vez")})
    changes.run_manual(spark, root, once.unionByName(again))
    return store.load_ledger(spark, root).select(
        "unique_key", "fecha", "detalle", "detalle_norm", "monto", "monto_real", "categoria", "nota_usuario"
    )


@query
def job_restore(spark, sf):
    ledger = a.ledger_orders(spark, sf).filter("monto < 0").withColumn("nota_usuario", F.lit("actual"))
    root = _stored(spark, ledger=ledger, ignored=a.ignored_rows(spark, sf))
    changes.run_restore(spark, root)
    return store.load_ledger(spark, root)


@query
def job_repair(spark, sf):
    root = _stored(spark, ledger=a.ledger_orders(spark, sf))
    changes.run_repair(spark, root)
    return store.load_ledger(spark, root).select("id", "monto", "monto_real")


@query
def job_rename(spark, sf):
    """The category in the ledger and in the list of names."""
    root = _stored(spark, ledger=a.ledger_orders(spark, sf), categories=a.categories(spark, sf))
    changes.run_rename(spark, root, "Cat3", "Cat4")
    ledger, listed = store.load_tables(spark, root, "ledger", "categories")
    return ledger.select("id", "categoria").unionByName(
        listed.select(F.lit(None).cast("string").alias("id"), F.col("nombre").alias("categoria"))
    )


@query
def job_decisions(spark, sf):
    ledger = a.ledger_orders(spark, sf)
    root = _stored(spark, ledger=ledger, rules=a.exact_rules(spark, sf))
    credit = F.when(F.col("monto") > 0, "Ingresos").otherwise("Sin categoría")
    changes.run_decisions(spark, root, suggest.pending(ledger).select("unique_key", credit.alias("categoria")))
    return store.load_ledger(spark, root).select("id", "categoria")


@query
def run_update_master(spark, sf):
    """The closed orders as the first batch, all orders as the second, one store."""
    m = stage(a.master_orders(spark, sf))
    columns = [f.name for f in MASTER if f.name in m.columns]
    root = work_dir(spark)
    jobs.run_update_master(spark, m.filter("estado <> 'O'").select(*columns), root, a.merchant_rules(spark), CONFIG)
    jobs.run_update_master(spark, m.select(*columns), root, cfg=CONFIG)
    return store.load_master(spark, root).select(
        "id", "categoria", "es_entre_cuentas", "match_id", "es_gasto", "monto_mio"
    )


@query
def master_roundtrip(spark, sf):
    m = a.master_orders(spark, sf)
    root = work_dir(spark)
    store.save_snapshot(m.select(*[f.name for f in MASTER if f.name in m.columns]), root, "master")
    return store.load_master(spark, root).select(
        "id", "fecha", "detalle", "monto", "categoria", "fraccion_mia", "monto_mio", "detalle_norm"
    )


@query
def read_rules(spark, sf):
    """One rule per brand, written as a rule file and read back in the file's order."""
    folder = work_dir(spark)
    brands = a.table(spark, sf, "part").select("p_brand").distinct()
    pair = F.struct(F.col("p_brand").alias("key"), F.concat(F.lit("Marca "), "p_brand").alias("value"))
    names = brands.agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("m"))
    names.select(F.to_json("m").alias("value")).write.text(folder)
    return exports.read_merchant_rules(spark, folder).select("ord", "key", "categoria")


# --- categorisation ---------------------------------------------------------


def _update_master(spark, sf):
    """The master job as it runs on a stored master and a standardised batch."""
    m = stage(a.master_orders(spark, sf))
    columns = [f.name for f in MASTER if f.name in m.columns]
    master = m.filter("estado <> 'O'").select(*columns).withColumn(
        "es_entre_cuentas", F.lit(False)
    )
    return jobs.update_master(m.select(*columns), master, a.merchant_rules(spark), CONFIG)


@query
def update_master(spark, sf):
    return _update_master(spark, sf)[0].select(
        "id", "categoria", "es_entre_cuentas", "match_id", "es_gasto", "monto_mio"
    )


@query
def update_master_rules(spark, sf):
    return _update_master(spark, sf)[1]


@query
def merchant_rules(spark, sf):
    return rules.apply_merchant_rules(a.master_orders(spark, sf), a.merchant_rules(spark)).select(
        "id", "categoria"
    )


@query
def merchant_rules_join(spark, sf):
    """The same rules through the join that serves large rule tables."""
    return rules.apply_merchant_rules(
        a.master_orders(spark, sf), a.merchant_rules(spark), inline_rules=0
    ).select("id", "categoria")


@query
def own_transfers(spark, sf):
    return rules.mark_own_transfers(a.master_orders(spark, sf), ALIASES).select(
        "id", "es_entre_cuentas"
    )


@query
def reimbursements(spark, sf):
    return reimburse.match_reimbursements(a.ledger_orders(spark, sf)).select("id", "match_id")


@query
def reimbursements_events(spark, sf):
    return reimburse.match_reimbursements(a.ledger_events(spark, sf), 3, 1.0).select("id", "match_id")


@query
def net_mine(spark, sf):
    marked = rules.mark_own_transfers(a.master_orders(spark, sf), ALIASES)
    return reimburse.net_mine(marked.drop("fraccion_mia")).select(
        "id", "es_gasto", "fraccion_mia", "monto_mio"
    )


@query
def learn_merchant(spark, sf):
    return rules.learn_merchant_rules(a.master_orders(spark, sf), a.merchant_rules(spark))


@query
def map_categories(spark, sf):
    m = a.movements_orders(spark, sf).withColumn("detalle_norm", fn.norm_alnum(F.col("detalle")))
    return rules.map_categories(m, a.exact_rules(spark, sf)).select("id", "detalle_norm", "categoria")


@query
def learn_rules(spark, sf):
    labelled = a.ledger_orders(spark, sf).withColumn("orden", F.col("id").cast("bigint"))
    return rules.learn_rules(a.exact_rules(spark, sf), labelled, order="orden")


def _rename(spark, sf):
    return rules.rename_category(
        a.ledger_orders(spark, sf), a.exact_rules(spark, sf), a.categories(spark, sf), "Cat3", "Cat4"
    )


@query
def rename_category(spark, sf):
    return _rename(spark, sf)[0].select("id", "categoria")


@query
def rename_category_list(spark, sf):
    return _rename(spark, sf)[2]


@query
def rename_category_rules(spark, sf):
    return rules.rename_category(
        a.ledger_orders(spark, sf), a.exact_rules(spark, sf), a.categories(spark, sf), "Vivienda", "Casa"
    )[1]


@query
def pending(spark, sf):
    return suggest.pending(_view(spark, sf)).select("unique_key", "detalle_norm")


_SUGGESTION = ("unique_key", "detalle", "detalle_norm", "sugerida", "fuente", "confianza")


@query
def suggest_exact(spark, sf):
    rows = suggest.pending(_view(spark, sf))
    return suggest.suggest_exact(rows, a.exact_rules(spark, sf)).select(*_SUGGESTION)


@query
def suggest_dominant(spark, sf):
    ledger = a.ledger_orders(spark, sf)
    return suggest.suggest_dominant(suggest.pending(ledger), ledger).select(*_SUGGESTION)


@query
def history_base(spark, sf):
    return suggest.history_base(a.ledger_orders(spark, sf))


def _alternatives_text(column: str):
    parts = F.transform(
        column,
        lambda r: F.concat(
            r["categoria"], F.lit("="), F.round(r["score"] * 10000).cast("int").cast("string")
        ),
    )
    return F.array_join(parts, "|")


@query
def suggest_similar(spark, sf):
    ledger = stage(a.ledger_orders(spark, sf))
    found = suggest.suggest_similar(suggest.pending(ledger), ledger)
    return found.select(
        "unique_key",
        "sugerida",
        "fuente",
        F.round("confianza", 8).alias("confianza"),
        _alternatives_text("alternativas").alias("alternativas"),
    )


@query
def suggestions(spark, sf):
    ledger = stage(a.ledger_orders(spark, sf))
    rules_table = stage(a.exact_rules(spark, sf))
    found = suggest.suggestions(views.scopes(ledger).view, ledger, rules_table)
    return found.select(
        "unique_key",
        "detalle",
        "detalle_norm",
        "sugerida",
        "fuente",
        F.round("confianza", 8).alias("confianza"),
        _alternatives_text("alternativas_sim").alias("alternativas_sim"),
        "monto",
    )


def _decide(spark, sf):
    ledger = a.ledger_orders(spark, sf)
    rows = suggest.pending(ledger).select(
        "unique_key", F.when(F.col("monto") > 0, "Ingresos").otherwise("Sin categoría").alias("categoria")
    )
    unknown = rows.select(F.concat(F.lit("x"), "unique_key").alias("unique_key"), "categoria")
    return suggest.apply_decisions(ledger, a.exact_rules(spark, sf), rows.unionByName(unknown))


@query
def apply_decisions(spark, sf):
    return _decide(spark, sf)[0].select("id", "categoria")


@query
def apply_decisions_rules(spark, sf):
    return _decide(spark, sf)[1]


# --- filters and views ------------------------------------------------------


@query
def filter_text(spark, sf):
    return views.filter_text(a.ledger_orders(spark, sf), "HOLD customer|new [0-9]*5").select("id")


@query
def filter_range(spark, sf):
    return views.filter_range(a.ledger_orders(spark, sf), "1996-02-10", "1999-11-20").select("id")


@query
def filter_day(spark, sf):
    return views.filter_range(a.ledger_orders(spark, sf), "1998-03-05").select("id")


@query
def filter_month(spark, sf):
    return views.filter_month(a.ledger_orders(spark, sf), MONTH).select("id")


@query
def filter_category(spark, sf):
    return views.filter_category(a.ledger_orders(spark, sf), ["Cat1", "Cat2", ""]).select("id")


@query
def scopes(spark, sf):
    s = views.scopes(
        a.ledger_orders(spark, sf), "customer", "1997-01-01", "1999-12-31", MONTH, ["Cat1", "Cat2", "Cat3"]
    )
    rows = [
        df.select(F.lit(name).alias("alcance"), "id", "monto")
        for name, df in (("vista", s.view), ("analisis", s.analysis), ("comparacion", s.compare))
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def months(spark, sf):
    return views.months(a.ledger_orders(spark, sf))


@query
def date_bounds(spark, sf):
    return views.date_bounds(a.ledger_orders(spark, sf))


@query
def current_month(spark, sf):
    return views.current_month(a.ledger_orders(spark, sf)).select("id", "fecha")


@query
def table_sort(spark, sf):
    table = views.editable_view(_view(spark, sf), a.categories(spark, sf))
    return views.table_sort(table, "monto", desc=True)


@query
def table_summary(spark, sf):
    return views.table_summary(_view(spark, sf))


@query
def editable_view(spark, sf):
    return views.editable_view(_view(spark, sf), a.categories(spark, sf))


# --- aggregates -------------------------------------------------------------


def _metric(f, scope=_view, **params):
    def run(spark, sf):
        return f(scope(spark, sf), **params)

    return run


def _events(spark, sf):
    return views.scopes(a.ledger_events(spark, sf)).view


def _items(spark, sf):
    return views.scopes(a.ledger_lineitem(spark, sf)).view


_QUERIES |= {
    "total_spend": _metric(metrics.total_spend),
    "daily_mean": _metric(metrics.daily_mean),
    "monthly_mean": _metric(metrics.monthly_mean),
    "mom_change": _metric(metrics.mom_change),
    "mom_change_one_month": _metric(metrics.mom_change, _events),
    "top_place": _metric(metrics.top_place),
    "top_category": _metric(metrics.top_category),
    "spend_by_category": _metric(metrics.spend_by_category),
    "top5_places": _metric(metrics.top_places, month=MONTH),
    "top5_places_items": _metric(metrics.top_places, _items),
    "freq_by_category": _metric(metrics.freq_by_category),
    "freq_by_category_top": _metric(metrics.freq_by_category, k=12),
    "spend_by_weekday": _metric(metrics.spend_by_weekday),
    "ticket_by_category": _metric(metrics.ticket_by_category),
    "ticket_by_category_top": _metric(metrics.ticket_by_category, k=12),
    "month_compare": _metric(metrics.month_compare, _compare, month=MONTH),
    "month_compare_order": _metric(metrics.month_compare_order, _compare, month=MONTH),
    "monthly_trend": _metric(metrics.monthly_trend),
    "monthly_trend_items": _metric(metrics.monthly_trend, _items),
    "month_category": _metric(projection.month_category, _compare),
    "category_stats": _metric(projection.category_stats, _compare),
    "category_stats_one_month": _metric(projection.category_stats, _events),
    "last_k_presence": _metric(projection.last_k_presence, _compare),
    "stable_categories": _metric(projection.stable_categories, _compare),
}


def project(spark, sf):
    s = views.scopes(a.ledger_orders(spark, sf), month=MONTH)
    return projection.projection(s.compare, s.view)


_QUERIES["projection"] = project


@query
def projection_totals(spark, sf):
    return projection.projection_totals(project(spark, sf))
