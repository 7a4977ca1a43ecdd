"""Ingest: clean a batch, key it, drop deleted and ignored rows, insert the rest once.

A batch row carries its place in the input as (`source_file`, `line_no`); "first
wins" always means first in that order. The place is packed into one number, so that
de-duplication works on hash aggregates per key, which Spark combines before the
shuffle, and rows are then picked by a join on (key, place), which is unique per row:
a key that fills a third of the batch never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monedero.functions import ledger_key, money, norm_db, truthy
from monedero.functions.text import blank
from monedero.operators.casting import ledger_value
from monedero.operators.rules import map_categories
from monedero.schema import LEDGER_COLUMNS
from monedero.session import stage

PLACE = ("source_file", "line_no")


#: More than any file's lines.
_LINES = 10**12


def place():
    return F.struct(*PLACE)


def with_place(rows: DataFrame) -> DataFrame:
    """Adds `_place`, a number that orders the rows by file and line.

    The files are numbered in name order: sorted in ranges, one number after the other
    in each, higher ones in later ranges. One row per file is written and joined.
    """
    files = rows.select("source_file").distinct().repartitionByRange("source_file").sortWithinPartitions("source_file")
    numbers = stage(files.withColumn("_file", F.monotonically_increasing_id()))
    first = F.col("_file").cast("decimal(20,0)") * F.lit(_LINES).cast("decimal(13,0)")
    return rows.join(numbers, "source_file").withColumn("_place", first + F.col("line_no")).drop("_file")


def force_expense(df: DataFrame) -> DataFrame:
    """Every uploaded row is an expense: negative amount, expense flag set."""
    return df.withColumns(
        {
            "monto_cartola": F.abs("monto"),
            "monto": -F.abs("monto"),
            "tipo": F.lit("Gasto"),
            "es_gasto": F.lit(True),
            "es_transferencia_o_abono": F.lit(False),
            "es_compartido_posible": (
                truthy(F.col("es_compartido_posible"))
                if "es_compartido_posible" in df.columns
                else F.lit(False)
            ),
        }
    )


def compute_keys(df: DataFrame, normalised: bool = False) -> DataFrame:
    """Normalise `detalle_norm`, unless it is already, and add `monto_cartola` and `unique_key`."""
    source = "detalle_norm" if "detalle_norm" in df.columns else "detalle"
    base = "monto_cartola" if "monto_cartola" in df.columns else "monto"
    norm = F.col("detalle_norm") if normalised else norm_db(F.col(source))
    keyed = df.withColumns(
        {
            "detalle_norm": norm,
            "monto_cartola": F.coalesce(money(F.col(base)).cast("double"), F.abs(base)),
        }
    )
    key_text = F.when(blank(F.col("detalle_norm")), norm_db(F.col("detalle"))).otherwise(
        F.col("detalle_norm")
    )
    return keyed.withColumn(
        "unique_key", ledger_key(F.col("fecha"), key_text, F.col("monto_cartola"))
    )


def drop_tombstoned(df: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows whose key was never deleted by the user."""
    return df.join(tombstones.select("unique_key"), "unique_key", "left_anti")


def effective_ignored(ignored: DataFrame, ledger: DataFrame, filled: bool | None = None) -> DataFrame:
    """Ignored keys that count: all of them, or only 'id:' keys while the ledger is empty.

    `filled` says whether the ledger has rows, where `ledger` holds only some of them.
    """
    if filled is not None:
        return ignored.select("unique_key").filter(F.lit(filled) | F.col("unique_key").startswith("id:"))
    return (
        ignored.select("unique_key")
        .withColumn("_filled", ledger.select("unique_key").exists())
        .filter(F.col("_filled") | F.col("unique_key").startswith("id:"))
        .drop("_filled")
    )


def drop_ignored(
    df: DataFrame, ignored: DataFrame, ledger: DataFrame, filled: bool | None = None
) -> DataFrame:
    """Rows whose key is not on the ignored list."""
    return df.join(effective_ignored(ignored, ledger, filled), "unique_key", "left_anti")


def default_real(monto_real, monto_mio, monto):
    """Corrected amount of a new row: given, else my share, else the expense itself."""
    own = F.when(monto < 0, F.abs(monto)).otherwise(F.lit(0.0))
    return F.coalesce(monto_real, F.abs(monto_mio), own)


def to_ledger(df: DataFrame) -> DataFrame:
    """Project to the ledger columns plus the place columns; absent ones are NULL."""
    if "fraccion_mia" in df.columns and "fraccion_mia_sugerida" not in df.columns:
        df = df.withColumnRenamed("fraccion_mia", "fraccion_mia_sugerida")
    if "monto_mio" in df.columns and "monto_mio_estimado" not in df.columns:
        df = df.withColumnRenamed("monto_mio", "monto_mio_estimado")
    places = [*PLACE, *(["_place"] if "_place" in df.columns else [])]
    typed = df.select(*[ledger_value(df, c) for c in LEDGER_COLUMNS], *places)
    return typed.withColumn(
        "monto_real",
        default_real(F.col("monto_real"), F.col("monto_mio_estimado"), F.col("monto")),
    )


def _text_marks(text):
    """Two hashes that stand for a text in aggregates, whose buffers hold numbers only."""
    return F.xxhash64(text).alias("mark"), F.xxhash64(F.lit(1), text).alias("mark2")


def pick_winners(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """(unique_key, _place) of the one row per key that enters the ledger.

    Two rows are duplicates when they share the key, or share (date, text, amount).
    Where the text is not blank both say the same, so the key decides. Rows with
    blank text are keyed by their raw description: of all of them on one date and
    amount only the first may enter, and it gives way to an earlier row of its key.
    """
    has_text = F.col("detalle_norm") != ""
    dated = F.col("fecha").isNotNull()
    mark, mark2 = (F.max(F.when(has_text, m)) for m in _text_marks(F.col("detalle_norm")))
    per_key = rows.groupBy("unique_key").agg(
        F.max("fecha").alias("fecha"),
        F.max(money(F.col("monto"))).alias("cents"),
        mark.alias("mark"),
        mark2.alias("mark2"),
        F.min(F.when(has_text | ~dated, F.col("_place"))).alias("text_first"),
        F.min(F.when(~has_text & dated, F.col("_place"))).alias("blank_first"),
    )
    signature = ["fecha", "cents", "mark", "mark2"]
    stored = ledger.filter(dated).select(
        "fecha", money(F.col("monto")).alias("cents"), *_text_marks(F.col("detalle_norm"))
    )

    # What the ledger already holds goes first: such rows block nothing.
    free = per_key.join(ledger.select("unique_key"), "unique_key", "left_anti")
    text_side = (
        free.filter(F.col("text_first").isNotNull())
        .join(stored, signature, "left_anti")
        .select("unique_key", "text_first")
    )
    blank_side = (
        free.filter(F.col("blank_first").isNotNull())
        .drop("mark", "mark2")
        .select("*", *_text_marks(F.lit("")))
        .join(stored, signature, "left_anti")
        .select("unique_key", "fecha", "cents", "blank_first")
    )
    both = blank_side.join(text_side, "unique_key", "full")
    leads = F.col("blank_first").isNotNull() & (
        F.col("text_first").isNull() | (F.col("blank_first") < F.col("text_first"))
    )
    # A place is one row's own, so it says whose key wins.
    chosen_blank = (
        both.filter(leads)
        .groupBy("fecha", "cents")
        .agg(F.min("blank_first").alias("blank_first"))
        .select("blank_first", F.lit(True).alias("blank_wins"))
    )
    first = F.when(F.col("blank_wins"), F.col("blank_first")).otherwise(F.col("text_first"))
    return (
        both.join(chosen_blank, "blank_first", "left")
        .select("unique_key", first.alias("_place"))
        .filter(F.col("_place").isNotNull())
    )


def split_batch(rows: DataFrame, winners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keyed and placed ledger rows as (rows to insert, duplicate rows)."""
    on = ["unique_key", "_place"]
    return rows.join(winners, on, "left_semi"), rows.join(winners, on, "left_anti")


def payload_of(columns=LEDGER_COLUMNS):
    """JSON text of the ledger row, NULL fields included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def record_ignored(duplicates: DataFrame, ignored: DataFrame, at=None, rows: DataFrame | None = None) -> DataFrame:
    """New ignored entries: the first duplicate row of each key not yet on the list.

    `rows`, where given, are all rows the duplicates were split from. The place of a
    duplicate is no winner's, so the entries are picked from them without a second split.
    """
    when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    first = (
        duplicates.groupBy("unique_key")
        .agg(F.min("_place").alias("_place"))
        .join(ignored.select("unique_key"), "unique_key", "left_anti")
    )
    chosen = (duplicates if rows is None else rows).join(first, ["unique_key", "_place"], "left_semi")
    return chosen.select("unique_key", payload_of().alias("payload"), when.alias("created_at"))


def upsert(
    df: DataFrame, ledger: DataFrame, ignored: DataFrame, at=None
) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, new ignored entries) of a batch that has passed the cleaning.

    The keyed rows are written once, so keys are hashed one time, and so are the winners.
    """
    rows = stage(to_ledger(drop_ignored(compute_keys(with_place(df)), ignored, ledger)))
    winners = stage(pick_winners(rows, ledger))
    inserted, duplicates = split_batch(rows, winners)
    return inserted.select(*LEDGER_COLUMNS), record_ignored(duplicates, ignored, at, rows)


def clean_batch(raw: DataFrame, rules: DataFrame) -> DataFrame:
    """Raw statement rows to keyed expense rows with a category."""
    return compute_keys(map_categories(force_expense(raw), rules), normalised=True)


def ingest(
    raw: DataFrame,
    ledger: DataFrame,
    ignored: DataFrame,
    tombstones: DataFrame,
    rules: DataFrame,
    at=None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to insert, new ignored entries, counts) of one raw batch.

    `counts` has one row: inserted, duplicates, rows dropped as deleted, and rows
    dropped because their key is on the ignored list. The cleaned batch is written
    once, so files are parsed and keys hashed one time, and so are its wanted rows
    and the winners, which the results share.
    """
    return ingest_batch(stage(clean_batch(raw, rules)), ledger, ignored, tombstones, at)


def ingest_batch(
    batch: DataFrame,
    ledger: DataFrame,
    ignored: DataFrame,
    tombstones: DataFrame,
    at=None,
    filled: bool | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`ingest` of a cleaned and keyed batch.

    A row clashes with ledger rows of its own date only, so `ledger` may be the months
    of the batch; `filled` then says whether the whole ledger has rows.
    """
    rows = stage(wanted_rows(with_place(batch), ledger, ignored, tombstones, filled))
    winners = stage(pick_winners(rows, ledger))
    inserted, duplicates = split_batch(rows, winners)
    return (
        inserted.select(*LEDGER_COLUMNS),
        record_ignored(duplicates, ignored, at, rows),
        ingest_counts(batch, winners, ledger, ignored, tombstones, filled),
    )


def wanted_rows(
    batch: DataFrame, ledger: DataFrame, ignored: DataFrame, tombstones: DataFrame, filled: bool | None = None
) -> DataFrame:
    """Ledger rows of a keyed batch without the deleted and the ignored ones."""
    return to_ledger(drop_ignored(drop_tombstoned(batch, tombstones), ignored, ledger, filled))


def ingest_counts(
    batch: DataFrame,
    winners: DataFrame,
    ledger: DataFrame,
    ignored: DataFrame,
    tombstones: DataFrame,
    filled: bool | None = None,
) -> DataFrame:
    """Inserted, duplicate, deleted and ignored rows of a keyed batch, as one row."""
    per_key = batch.groupBy("unique_key").agg(F.count(F.lit(1)).alias("n"))
    deleted = tombstones.select("unique_key", F.lit(True).alias("_del")).distinct()
    listed = effective_ignored(ignored, ledger, filled).distinct().withColumn("_ign", F.lit(True))
    new = winners.select("unique_key", F.lit(1).alias("_new"))
    marked = (
        per_key.join(deleted, "unique_key", "left")
        .join(listed, "unique_key", "left")
        .join(new, "unique_key", "left")
    )
    is_del = F.coalesce(F.col("_del"), F.lit(False))
    is_ign = ~is_del & F.coalesce(F.col("_ign"), F.lit(False))
    new_rows = F.coalesce(F.col("_new"), F.lit(0))

    def add(c, name):
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)

    return marked.agg(
        add(new_rows, "insertadas"),
        add(F.when(~is_del & ~is_ign, F.col("n") - new_rows), "duplicadas"),
        add(F.when(is_del, F.col("n")), "borradas"),
        add(F.when(is_ign, F.col("n")), "ignoradas"),
    )


def dedup_latest(ledger: DataFrame) -> DataFrame:
    """One row per key, the newest by date; rows of equal date by the greatest id."""
    newest = F.struct(F.col("fecha"), F.col("id"), F.col("monto"))
    row = F.struct(*ledger.columns)
    return (
        ledger.groupBy("unique_key")
        .agg(F.max_by(row, newest).alias("_row"))
        .select("_row.*")
    )


def merge_master(
    master: DataFrame, new: DataFrame, master_is_unique: bool = False, new_is_fresh: bool = False
) -> DataFrame:
    """Master rows plus the new rows whose id it lacks, one row per id.

    A master row always beats a new one. Equal ids mean equal date, text and
    amount, so among equals the first by the remaining columns stays. A master
    made by this function is unique and need not be looked through again, nor new
    rows of which none has an id of the master.
    """
    fresh = new if new_is_fresh else new.join(master.select("id"), "id", "left_anti").select(*new.columns)
    known = master if master_is_unique else first_per_id(master)
    return known.unionByName(first_per_id(fresh), allowMissingColumns=True)


def first_per_id(df: DataFrame) -> DataFrame:
    """One row per id, the first by date, text, amount and category."""
    order = F.struct("fecha", "detalle", "monto", "categoria")
    row = F.struct(*df.columns)
    return df.groupBy("id").agg(F.min_by(row, order).alias("_row")).select("_row.*")


def once_per_id(df: DataFrame) -> DataFrame:
    """`first_per_id` of a written table: only rows whose id comes again are compared and shuffled whole."""
    h = F.xxhash64("id")
    again = stage(df.groupBy(h.alias("_h")).count().filter(F.col("count") > 1).select("_h"))
    if again.isEmpty():
        return df
    marked = df.withColumn("_h", h)
    alone = marked.join(again, "_h", "left_anti").select(*df.columns)
    return alone.unionByName(first_per_id(marked.join(again, "_h", "left_semi").select(*df.columns)))
