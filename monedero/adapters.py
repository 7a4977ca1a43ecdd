"""Ledgers and batches derived from the generic test tables.

Each adapter reads whole tables; the oracle SQL builds the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monedero.functions import ledger_key, my_share, norm_alnum, norm_cli, norm_db
from monedero.operators.casting import ledger_value
from monedero.operators.ingest import default_real
from monedero.schema import LEDGER_COLUMNS, UNCATEGORISED
from monedero.session import stage, tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; one that comes in fewer pieces than there are cores is spread over them.

    A table of many files or row groups already fills the cores and is not shuffled.
    """
    df = tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _FACTS and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


_FACTS = ("orders", "lineitem", "events", "documents")


def as_ledger(df: DataFrame) -> DataFrame:
    """Project to the ledger schema; absent columns are NULL."""
    return df.select(*[ledger_value(df, c) for c in LEDGER_COLUMNS])


def _keyed(df: DataFrame) -> DataFrame:
    norm = norm_db(norm_alnum(F.col("detalle")))
    return df.withColumn("detalle_norm", norm).withColumn(
        "unique_key", ledger_key(F.col("fecha"), F.col("detalle_norm"), F.col("monto"))
    )


def movements_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as movements: status 'P' is a credit, the rest expenses.

    Every 31st order is at a merchant seen only once; every 5th lacks a category
    in one of the three spellings the ledger knows.
    """
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    is_new = key % 31 == 0
    place = F.when(is_new, F.concat(F.lit("NEW "), key.cast("string"))).otherwise(F.col("c_name"))
    total = F.col("o_totalprice")
    monto = F.when(F.col("o_orderstatus") == "P", total).otherwise(-total)
    category = (
        F.when(is_new, None)
        .when(key % 15 == 0, "")
        .when(key % 15 == 5, UNCATEGORISED)
        .when(key % 5 == 0, None)
        .when(key % 10 < 8, F.concat(F.lit("Cat"), (cust % 7).cast("string")))
        .otherwise(F.col("o_orderpriority"))
    )
    shared = cust % 9 == 0
    transfer = key % 23 == 0
    fraction, mine = my_share(monto, shared)
    real = F.when(key % 4 == 0, F.floor(total * 0.75).cast("double")).when(key % 4 == 1, F.lit(0.0))
    return (
        o.join(c, cust == F.col("c_custkey"))
        .select(
            key.cast("string").alias("id"),
            F.col("o_orderdate").cast("date").alias("fecha"),
            F.concat("c_mktsegment", F.lit("*"), place).alias("detalle"),
            monto.alias("monto"),
            ((monto < 0) & ~transfer).alias("es_gasto"),
            transfer.alias("es_transferencia_o_abono"),
            shared.alias("es_compartido_posible"),
            fraction.alias("fraccion_mia_sugerida"),
            mine.alias("monto_mio_estimado"),
            category.alias("categoria"),
            real.alias("monto_real"),
            F.when(key % 3 == 0, F.col("o_orderpriority")).alias("nota_usuario"),
            F.col("o_orderstatus").alias("estado"),
            F.col("o_orderpriority").alias("prioridad"),
            key.alias("orden"),
        )
    )


def ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ledger(_keyed(movements_orders(spark, sf_dir)))


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger of a single month: sign-ups are credits."""
    e = table(spark, sf_dir, "events")
    credit = F.col("event_type") == "signup"
    rows = e.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").cast("date").alias("fecha"),
        F.concat("event_type", F.lit("*"), F.col("user_id").cast("string")).alias("detalle"),
        F.when(credit, F.col("value")).otherwise(-F.col("value")).alias("monto"),
        (~credit).alias("es_gasto"),
        F.lit(False).alias("es_transferencia_o_abono"),
        F.lit(False).alias("es_compartido_posible"),
        F.col("event_type").alias("categoria"),
    )
    return as_ledger(_keyed(rows))


def ledger_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a ledger: returned items are credits."""
    item = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    price = F.col("l_extendedprice")
    rows = item.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.col("l_shipdate").cast("date").alias("fecha"),
        F.concat_ws(" ", "p_name", "p_brand").alias("detalle"),
        F.when(F.col("l_returnflag") == "R", price).otherwise(-price).alias("monto"),
        (F.col("l_returnflag") != "R").alias("es_gasto"),
        F.col("p_type").alias("categoria"),
    )
    return as_ledger(_keyed(rows))


def master_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the standardised layout of the master table."""
    m = movements_orders(spark, sf_dir)
    return m.select(
        "id",
        "fecha",
        "detalle",
        "monto",
        "es_transferencia_o_abono",
        "es_compartido_posible",
        F.nullif(F.col("categoria"), F.lit("")).alias("categoria"),
        F.col("fraccion_mia_sugerida").alias("fraccion_mia"),
        F.col("monto_mio_estimado").alias("monto_mio"),
        norm_cli(F.col("detalle")).alias("detalle_norm"),
        "estado",
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw text: amounts in five layouts, dates in eight, flags in nine spellings."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    exact = F.col("o_totalprice").cast("decimal(18,2)")
    grouped = F.format_number(exact, 2)
    day = F.col("o_orderdate").cast("date")
    amount = (
        F.when(key % 5 == 0, exact.cast("string"))
        .when(key % 5 == 1, grouped)
        .when(key % 5 == 2, F.translate(grouped, ",.", ".,"))
        .when(key % 5 == 3, F.concat(F.lit("$ "), F.replace(exact.cast("string"), F.lit("."), F.lit(","))))
        .otherwise(F.concat(F.lit("CLP "), F.floor(exact).cast("string")))
    )
    date_text = F.get(
        F.array(
            F.date_format(day, "yyyy-MM-dd"),
            F.date_format(day, "dd/MM/yyyy"),
            F.date_format(day, "dd-MM-yyyy"),
            F.date_format(day, "dd.MM.yyyy"),
            F.date_format(day, "dd/MM/yy"),
            F.date_format(day, "MM/dd/yyyy"),
            F.date_format(day, "yyyy/MM/dd"),
            F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 00:00:00")),
        ),
        (key % 8).cast("int"),
    )
    flags = ["1", "0", " Si", "SÍ", "no", "True", "s", "2", "verdadero"]
    flag = F.get(F.array(*[F.lit(f) for f in flags]), (key % 9).cast("int"))
    return o.select(
        key,
        F.col("o_custkey"),
        F.col("o_orderstatus"),
        F.col("o_orderpriority"),
        day.alias("dia"),
        amount.alias("amount_text"),
        date_text.alias("date_text"),
        flag.alias("flag_text"),
    )


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, text): every document and every part name."""
    d = table(spark, sf_dir, "documents")
    p = table(spark, sf_dir, "part")
    return d.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(
        p.select(
            F.lit("part").alias("kind"),
            F.col("p_partkey").alias("id"),
            F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"),
        )
    )


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger before the next upload: the orders no longer open, all as expenses."""
    m = movements_orders(spark, sf_dir).filter(F.col("estado") != "O")
    expense = m.withColumns({"monto": -F.abs("monto"), "es_gasto": F.lit(True)})
    real = default_real(F.col("monto_real"), F.col("monto_mio_estimado"), F.col("monto"))
    return as_ledger(_keyed(expense).withColumn("monto_real", real))


def upload_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next upload: all orders, and the urgent ones once more with another note."""
    m = movements_orders(spark, sf_dir)
    columns = [
        F.lit("extracto.csv").alias("source_file"),
        "orden",
        "id",
        "fecha",
        "detalle",
        "monto",
        "es_compartido_posible",
        "monto_mio_estimado",
        "categoria",
        norm_alnum(F.col("detalle")).alias("detalle_norm"),
    ]
    once = m.select(*columns, "nota_usuario", (F.col("orden") * 2).alias("line_no"))
    again = m.filter(F.col("prioridad") == "1-URGENT").select(
        *columns, F.lit("repetido").alias("nota_usuario"), (F.col("orden") * 2 + 1).alias("line_no")
    )
    return once.unionByName(again).drop("orden")


def _expense_key() -> Column:
    norm = norm_db(norm_alnum(F.col("detalle")))
    return ledger_key(F.col("fecha"), norm, F.col("monto"))


def deleted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones: the open orders of low priority."""
    m = movements_orders(spark, sf_dir)
    return m.filter((F.col("estado") == "O") & (F.col("prioridad") == "5-LOW")).select(
        _expense_key().alias("unique_key"), F.lit("2024-01-01").cast("timestamp").alias("deleted_at")
    )


def ignored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignored list: the open orders of medium priority, with the payload of an earlier upload."""
    m = movements_orders(spark, sf_dir)
    chosen = m.filter((F.col("estado") == "O") & (F.col("prioridad") == "3-MEDIUM"))
    rows = as_ledger(_keyed(chosen))
    return rows.select(
        "unique_key",
        F.to_json(F.struct(*LEDGER_COLUMNS), {"ignoreNullFields": "false"}).alias("payload"),
        F.col("fecha").cast("timestamp").alias("created_at"),
    )


def exact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One learned rule per building-trade customer; machinery customers have a blank one."""
    c = table(spark, sf_dir, "customer")
    name = F.concat("c_mktsegment", F.lit("*"), "c_name")
    category = F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise("Vivienda")
    return c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        norm_db(norm_alnum(name)).alias("detalle_norm"), category.alias("categoria")
    )


# Hand-written merchant rules over the segment names; the order is the meaning.
MERCHANT_RULES = (
    ("AUTOMOBILE*NEW", "Compras"),
    ("AUTO", "Transporte"),
    ("BUILDING*CUSTOMER#00000000", "Hogar"),
    ("BUILD", "Vivienda"),
    ("HOUSEHOLD", "Hogar"),
    ("HOLD*NEW", "Otros"),
    ("CHINE", "Servicios"),
    ("FURNITURE*NEW 1", "Compras"),
)


def merchant_rules(spark: SparkSession) -> DataFrame:
    rows = [(i, None, None, k, c) for i, (k, c) in enumerate(MERCHANT_RULES)]
    return spark.createDataFrame(
        rows, "ord bigint, since date, since_id string, key string, categoria string"
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active category list: the base category and the categories 'Cat0' to 'Cat6' in use."""
    used = ledger_orders(spark, sf_dir).select(F.col("categoria").alias("nombre"))
    base = spark.createDataFrame([(UNCATEGORISED,)], "nombre string")
    return stage(used.filter(F.col("nombre").startswith("Cat")).unionByName(base).distinct())


def _statement_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement file per customer, in one of five layouts chosen by customer number."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.withColumns(
        {
            "source_file": F.concat(F.lit("cliente-"), F.col("c_custkey").cast("string")),
            "kind": (F.col("c_custkey") % 5).cast("int"),
            "junk": F.when(F.col("c_custkey") % 5 == 4, 0)
            .otherwise(F.col("c_custkey") % 4)
            .cast("int"),
        }
    )


def _by_kind(kind: Column, values: list[Column]) -> Column:
    return F.get(F.array(*values), kind)


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw statement lines of every customer: junk lines, a header, one line per order.

    Layouts: one signed amount, debit and credit, tabs, quoted text with the
    delimiter in it, and column names that say nothing.
    """
    src = _statement_sources(spark, sf_dir)
    o = table(spark, sf_dir, "orders")
    headers = [
        "Fecha;Detalle;Monto",
        "fecha,glosa,cargo,abono",
        "FECHA MOV.\tDescripcion\tImporte Monto",
        "Fecha|Comercio|Saldo",
        "Dia;Texto libre;Monto",
    ]
    head = src.select(
        "source_file",
        F.explode(F.sequence(F.lit(0), F.col("junk"))).alias("i"),
        "junk",
        _by_kind(F.col("kind"), [F.lit(h) for h in headers]).alias("h"),
    ).select(
        "source_file",
        F.col("i").cast("bigint").alias("line_no"),
        F.when(F.col("i") == F.col("junk"), F.col("h"))
        .otherwise(F.concat(F.lit("Banco de Prueba hoja "), F.col("i").cast("string")))
        .alias("line"),
    )
    key, total = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    day = F.col("o_orderdate").cast("date")
    credit = F.col("o_orderstatus") == "P"
    signed = F.when(credit, total).otherwise(-total)
    comma = F.replace(signed.cast("string"), F.lit("."), F.lit(","))
    grouped = F.translate(F.format_number(signed, 2), ",.", ".,")
    dash, slash = F.date_format(day, "dd-MM-yyyy"), F.date_format(day, "dd/MM/yyyy")
    debit_text = F.when(credit, "").otherwise(total.cast("string"))
    credit_text = F.when(credit, total.cast("string")).otherwise("")
    note = _order_note()
    text = F.concat(F.col("c_mktsegment"), F.lit("*"), F.col("c_name"), note)
    body = o.join(src, F.col("o_custkey") == F.col("c_custkey")).select(
        "source_file",
        (F.lit(10) + key).alias("line_no"),
        _by_kind(
            F.col("kind"),
            [
                F.concat_ws(";", slash, text, grouped),
                F.concat_ws(",", dash, text, debit_text, credit_text),
                F.concat_ws("\t", F.date_format(day, "yyyy-MM-dd"), text, comma),
                F.concat_ws(
                    "|", slash, F.concat(F.lit('"'), text, F.lit('|sucursal"')), total.cast("string")
                ),
                F.concat_ws(";", F.date_format(day, "dd/MM/yy"), text, comma),
            ],
        ).alias("line"),
    )
    return head.unionByName(body)


def _order_note() -> Column:
    key = F.col("o_orderkey")
    return (
        F.when(key % 7 == 0, " Transferencia")
        .when(key % 7 == 1, " gasto compartido")
        .otherwise("")
    )


def upload_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload files of every customer: names in the first line, four layouts of aliases."""
    src = _statement_sources(spark, sf_dir).withColumn("kind", (F.col("c_custkey") % 4).cast("int"))
    o = table(spark, sf_dir, "orders")
    headers = [
        "fecha,detalle,monto,categoria",
        "Date;Glosa;Cargo;Monto_Real",
        "fecha_mov|concepto del pago|importe total|id",
        "Fecha Movimiento\tComercio\tDebito\tnota_usuario",
    ]
    head = src.select(
        "source_file",
        F.lit(0).cast("bigint").alias("line_no"),
        _by_kind(F.col("kind"), [F.lit(h) for h in headers]).alias("line"),
    )
    key, total = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    day = F.col("o_orderdate").cast("date")
    plain, comma = total.cast("string"), F.replace(total.cast("string"), F.lit("."), F.lit(","))
    iso = F.date_format(day, "yyyy-MM-dd")
    text = F.concat(F.col("c_mktsegment"), F.lit("*"), F.col("c_name"))
    body = o.join(src, F.col("o_custkey") == F.col("c_custkey")).select(
        "source_file",
        (key + 1).alias("line_no"),
        _by_kind(
            F.col("kind"),
            [
                F.concat_ws(",", iso, text, plain, "o_orderpriority"),
                F.concat_ws(";", F.date_format(day, "dd/MM/yyyy"), text, F.concat(F.lit("$ "), comma), plain),
                F.concat_ws("|", iso, text, F.concat(F.lit("CLP "), plain), key.cast("string")),
                F.concat_ws("\t", F.date_format(day, "dd.MM.yyyy"), text, F.concat(F.lit("-"), comma), "o_orderpriority"),
            ],
        ).alias("line"),
    )
    return head.unionByName(body)


def flawed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload file per customer with orders; some lack the amount column, some orders
    have a cell too many or an amount beyond the exact type."""
    orders = table(spark, sf_dir, "orders").withColumn(
        "source_file", F.concat(F.lit("cliente-"), F.col("o_custkey").cast("string"))
    )
    header = F.when(F.col("o_custkey") % 5 == 1, "fecha,glosa,saldo").otherwise("fecha,glosa,monto")
    heads = orders.select("source_file", F.lit(0).cast("bigint").alias("line_no"), header.alias("line")).distinct()
    huge = F.col("o_orderpriority") == "2-HIGH"
    line = F.concat_ws(
        ",",
        F.lit("2024-01-02"),
        "o_orderpriority",
        F.when(huge, "99999999999999999999").otherwise(F.col("o_orderkey").cast("string")),
        F.when(F.col("o_orderpriority") == "1-URGENT", "sobra"),
    )
    rows = orders.select("source_file", F.col("o_orderkey").cast("bigint").alias("line_no"), line.alias("line"))
    return heads.unionByName(rows.filter("line_no > 0"))


def write_broken_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Three upload files of all orders: byte-order mark, blank lines, stray quotes, and
    quoted cells with line breaks, delimiters and quotes in them."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit('"uno ""'), key, F.lit('"";\ndos\n\n; tres"')))
        .when(key % 4 == 1, F.concat(F.lit('tubo 5" '), key))
        .when(key % 4 == 2, F.concat(F.lit('"todo; '), key, F.lit('"')))
        .otherwise(F.concat(F.lit("simple "), key))
    )
    day = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    line = F.concat_ws(";", day, text, F.col("o_totalprice").cast("decimal(18,2)"))
    # A line break more makes a blank line.
    rows = orders.select(
        (key % 3).cast("int").alias("archivo"), key.alias("orden"), F.when(key % 10 == 0, F.concat(line, F.lit("\n"))).otherwise(line).alias("value")
    )
    head = spark.range(3).select(
        F.col("id").cast("int").alias("archivo"), F.lit(-1).cast("bigint").alias("orden"), F.lit("\ufefffecha;detalle;monto").alias("value")
    )
    (
        head.unionByName(rows)
        .repartition("archivo")
        .sortWithinPartitions("archivo", "orden")
        .select("archivo", "value")
        .write.partitionBy("archivo")
        .text(folder)
    )
