"""Edits, deletes, manual entries, restores, repairs and draft overlays.

Each operator takes the tables involved and returns their new state; nothing is
written here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monedero.functions import manual_key, norm_alnum
from monedero.functions.text import blank
from monedero.operators.casting import ledger_value
from monedero.schema import EDITABLE_COLUMNS, LEDGER, LEDGER_COLUMNS, UNCATEGORISED

DRAFT_COLUMNS = ("monto", "categoria", "nota_usuario")


def _at(at) -> Column:
    return F.current_timestamp() if at is None else F.lit(at).cast("timestamp")


def apply_edits(ledger: DataFrame, edits: DataFrame, order: str = "seq") -> DataFrame:
    """Ledger with the edits applied; NULL in an edit overwrites.

    An edit finds its row by `unique_key`, or by `id` where the key is blank.
    Of several edits to one row the last by `order` wins; without that column
    at most one edit per row is expected.
    """
    columns = [c for c in EDITABLE_COLUMNS if c in edits.columns]
    if not columns:
        return ledger
    seq = F.col(order) if order in edits.columns else F.lit(0)
    has_id = "id" in edits.columns
    values = F.struct(*[ledger_value(edits, c) for c in columns])
    numbered = edits.withColumns({"_seq": seq, "_new": values})
    keyed = ~blank(F.col("unique_key")) if "unique_key" in edits.columns else F.lit(False)

    def last(rows: DataFrame, on: str, tag: str) -> DataFrame:
        return rows.groupBy(F.col(on).alias(tag)).agg(
            F.max_by(F.struct("_seq", "_new"), "_seq").alias(f"{tag}_edit")
        )

    result = ledger
    found = []
    if "unique_key" in edits.columns:
        by_key = last(numbered.filter(keyed), "unique_key", "_k")
        result = result.join(by_key, F.col("unique_key") == F.col("_k"), "left")
        found.append("_k_edit")
    if has_id:
        by_id = last(numbered.filter(~keyed & F.col("id").isNotNull()), "id", "_i")
        result = result.join(by_id, F.col("id") == F.col("_i"), "left")
        found.append("_i_edit")
    if len(found) == 2:
        k, i = F.col("_k_edit"), F.col("_i_edit")
        by_key_wins = i.isNull() | (k["_seq"] >= i["_seq"])
        edit = F.when(k.isNotNull() & by_key_wins, k).otherwise(i)
    else:
        edit = F.col(found[0])
    result = result.withColumn("_edit", edit)
    hit = F.col("_edit").isNotNull()
    return result.withColumns(
        {c: F.when(hit, F.col("_edit")["_new"][c]).otherwise(F.col(c)) for c in columns}
    ).select(*ledger.columns)


def delete_rows(
    ledger: DataFrame,
    ignored: DataFrame,
    tombstones: DataFrame,
    keys: DataFrame | None = None,
    ids: DataFrame | None = None,
    at=None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger, ignored, tombstones) after deleting rows by key and by id.

    The keys join the ignored list in any case, and the tombstones only when at
    least one row was deleted.
    """
    if keys is None and ids is None:
        return ledger, ignored, tombstones
    rest, new_ignored, new_tombs = deletion(ledger, ignored, tombstones, keys, ids, at)
    return rest, ignored.unionByName(new_ignored), tombstones.unionByName(new_tombs)


def deletion(
    ledger: DataFrame,
    ignored: DataFrame,
    tombstones: DataFrame,
    keys: DataFrame | None = None,
    ids: DataFrame | None = None,
    at=None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger rows left, new ignored entries, new tombstones) of a delete by key and by id."""
    wanted = []
    rest = ledger
    if keys is not None:
        wanted.append(keys.select(F.trim("unique_key").alias("unique_key")))
    if ids is not None:
        by_id = ids.select("id").filter(F.col("id").isNotNull()).distinct()
        hit = ledger.select("id", "unique_key").join(by_id, "id", "left_semi")
        wanted.append(hit.select("unique_key"))
        rest = rest.join(by_id, "id", "left_anti")
    gone = wanted[0]
    for more in wanted[1:]:
        gone = gone.unionByName(more)
    gone = gone.filter(~blank(F.col("unique_key"))).distinct()
    rest = rest.join(gone, "unique_key", "left_anti").select(*ledger.columns)
    deleted = ledger.select("unique_key").join(gone, "unique_key", "left_semi").exists()
    if ids is not None:
        deleted = deleted | ledger.select("id").join(by_id, "id", "left_semi").exists()

    new_ignored = gone.join(ignored.select("unique_key"), "unique_key", "left_anti").select(
        "unique_key", F.lit(None).cast("string").alias("payload"), _at(at).alias("created_at")
    )
    new_tombs = (
        gone.join(tombstones.select("unique_key"), "unique_key", "left_anti")
        .withColumn("_any", deleted)
        .filter("_any")
        .select("unique_key", _at(at).alias("deleted_at"))
    )
    return rest, new_ignored, new_tombs


def count_deleted(
    ledger: DataFrame, keys: DataFrame | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """How many ledger rows a delete by these keys and ids removes."""
    row = ledger.select("unique_key", "id")
    hit = F.lit(False)
    if keys is not None:
        k = keys.select(F.trim("unique_key").alias("_k")).distinct()
        row = row.join(k, F.col("unique_key") == F.col("_k"), "left")
        hit = hit | F.col("_k").isNotNull()
    if ids is not None:
        i = ids.select(F.col("id").alias("_i")).distinct()
        row = row.join(i, F.col("id") == F.col("_i"), "left")
        hit = hit | F.col("_i").isNotNull()
    return row.agg(F.count_if(hit).alias("borradas"))


def save_diff(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, keys to delete) that turn the table shown into the table saved.

    The shown amount is the corrected one, so it is saved as `monto_real`.
    """
    kept = after.filter(F.col("unique_key").isNotNull())
    gone = (
        before.select("unique_key")
        .filter(F.col("unique_key").isNotNull())
        .join(kept.select("unique_key"), "unique_key", "left_anti")
        .distinct()
    )
    return kept.withColumnRenamed("monto", "monto_real"), gone


def manual_rows(entries: DataFrame) -> DataFrame:
    """Manual entries as ledger rows; entries without text or amount are refused.

    The first of several equal entries by `seq` stays. An entry without a
    readable date is dated today.
    """
    detalle = F.trim("detalle")
    monto = F.abs("monto")
    seq = F.col("seq") if "seq" in entries.columns else F.lit(0)
    rows = (
        entries.withColumn("_seq", seq)
        .filter(~blank(detalle) & (monto > 0))
        .select(
            "_seq",
            F.coalesce(F.col("fecha").try_cast("date"), F.current_date()).alias("fecha"),
            detalle.alias("detalle"),
            monto.alias("monto"),
            norm_alnum(detalle).alias("detalle_norm"),
            F.coalesce(F.nullif(F.col("categoria"), F.lit("")), F.lit(UNCATEGORISED)).alias("categoria"),
            F.coalesce("nota", F.lit("")).alias("nota_usuario"),
        )
        .withColumns(
            {
                "monto_real": F.col("monto"),
                "es_gasto": F.lit(True),
                "es_transferencia_o_abono": F.lit(False),
                "unique_key": manual_key(F.col("fecha"), F.col("monto"), F.col("detalle_norm")),
            }
        )
    )
    rows = rows.select("_seq", *[ledger_value(rows, c) for c in LEDGER_COLUMNS])
    first = F.struct("_seq", "detalle", "categoria", "nota_usuario")
    return (
        rows.groupBy("unique_key")
        .agg(F.min_by(F.struct(*LEDGER_COLUMNS), first).alias("_row"))
        .select("_row.*")
    )


def append_manual(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """Ledger with the manual entries it does not hold yet."""
    new = manual_rows(entries).join(ledger.select("unique_key"), "unique_key", "left_anti")
    return ledger.unionByName(new.select(*ledger.columns))


def parse_payload(ignored: DataFrame) -> DataFrame:
    """Ignored rows with the name and amount read from their JSON text.

    Bad JSON gives an empty name and no amount; a decimal comma is accepted.
    """
    texts = F.from_json(
        "payload",
        "detalle string, detalle_norm string, monto_real string, monto string",
        {"mode": "PERMISSIVE"},
    )
    p = F.col("_p")
    real = p["monto_real"]
    number = F.replace(real, F.lit(","), F.lit(".")).try_cast("double")
    unset = real.isNull() | (real == "") | F.coalesce(number == 0, F.lit(False))
    amount = F.when(unset, p["monto"]).otherwise(real)
    return (
        ignored.withColumn("_p", texts)
        .withColumns(
            {
                "nombre": F.coalesce(
                    F.nullif(p["detalle"], F.lit("")), F.nullif(p["detalle_norm"], F.lit("")), F.lit("")
                ),
                "monto": F.replace(amount, F.lit(","), F.lit(".")).try_cast("double"),
            }
        )
        .drop("_p")
    )


def ignored_listing(ignored: DataFrame) -> DataFrame:
    """The ignored rows, newest first, with name and amount."""
    return (
        parse_payload(ignored)
        .select("created_at", "nombre", "monto", "unique_key")
        .orderBy(F.desc("created_at"), F.asc("unique_key"))
    )


def restore_ignored(
    ledger: DataFrame, ignored: DataFrame, keys: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(ledger, ignored) after bringing back the selected, or all, rows with a payload.

    A restored row replaces the ledger row of its key. Entries without a payload
    stand for deletes and stay.
    """
    rows = restorable(ignored, keys)
    return replace_rows(ledger, rows), ignored.join(rows.select("unique_key"), "unique_key", "left_anti").select(
        *ignored.columns
    )


def replace_rows(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """Ledger with the rows in place of those of the same keys."""
    kept = ledger.join(rows.select("unique_key"), "unique_key", "left_anti").select(*LEDGER_COLUMNS)
    return kept.unionByName(rows.select(*LEDGER_COLUMNS))


def restorable(ignored: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Ledger rows of the selected, or all, ignored entries with a payload."""
    chosen = ignored.filter(F.coalesce(F.col("payload"), F.lit("")) != "")
    if keys is not None:
        chosen = chosen.join(keys.select("unique_key"), "unique_key", "left_semi")
    return chosen.select(
        "unique_key", F.from_json("payload", LEDGER, {"mode": "PERMISSIVE"}).alias("r")
    ).select(
        *[F.col(f"r.{c}").alias(c) for c in LEDGER_COLUMNS if c != "unique_key"], "unique_key"
    )


def discrepant() -> Column:
    """Whether the corrected amount differs from the original."""
    monto, real = F.col("monto"), F.col("monto_real")
    off = monto.isNull() | (monto == 0) | (F.abs(monto) != real)
    return F.coalesce((real > 0) & off, F.lit(False))


def repair_amounts(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger with `monto` set to the corrected amount where they differ, row count repaired)."""
    fixed = F.when(discrepant(), F.abs("monto_real")).otherwise(F.col("monto"))
    return (
        ledger.withColumn("monto", fixed),
        ledger.agg(F.count_if(discrepant()).alias("reparados")),
    )


def _draft(draft: DataFrame) -> DataFrame:
    columns = [c for c in DRAFT_COLUMNS if c in draft.columns]
    return draft.select(
        F.col("unique_key").alias("_k"), *[F.col(c).alias(f"_d_{c}") for c in columns]
    )


def overlay_draft(view: DataFrame, draft: DataFrame) -> DataFrame:
    """View with the unsaved edits laid over the rows of the same key, NULLs included."""
    d = _draft(draft)
    hit = F.col("_k").isNotNull()
    cells = {
        c: F.when(hit, F.col(f"_d_{c}")).otherwise(F.col(c))
        for c in DRAFT_COLUMNS
        if c in draft.columns and c in view.columns
    }
    return (
        view.join(d, F.col("unique_key") == F.col("_k"), "left")
        .withColumns(cells)
        .select(*view.columns)
    )


def restrict_to_draft(view: DataFrame, draft: DataFrame) -> DataFrame:
    """As `overlay_draft`, but rows the draft no longer holds are left out."""
    kept = view.join(draft.select("unique_key"), "unique_key", "left_semi")
    return overlay_draft(kept.select(*view.columns), draft)
