"""The jobs that change the stored ledger: edits, deletes, entries, restores, repairs, names.

Each job finds the months its rows are in, reads and rewrites those months only, and
commits what it changed, in all tables, as one version. Where another writer touches the
same months meanwhile it is computed again. Jobs return what they did as counts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monedero.functions.text import blank
from monedero.operators import mutate, rules, suggest
from monedero.plans.jobs import months_in, repeated
from monedero.schema import DEFAULT_CATEGORIES, UNCATEGORISED
from monedero.session import stage, tune
from monedero.sources import store

_ROW = ("unique_key", "id", "mes")


def _months_with(now: store.Version, months: Iterable[str] | None, *hits: DataFrame | None) -> list[str]:
    """The ledger months that hold a row of any of the frames, each keyed by key or by id.

    Two or three columns of the ledger are read, of the given months where they are known.
    """
    rows = now.table("ledger", months, with_month=True).select(*_ROW)
    found = [rows.join(h, h.columns[0], "left_semi").select("mes") for h in hits if h is not None]
    if not found:
        return []
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return sorted(r.mes for r in every.distinct().collect())


def _keys(df: DataFrame | None) -> DataFrame | None:
    """The keys that are not blank, each once."""
    if df is None or "unique_key" not in df.columns:
        return None
    return df.select(F.trim("unique_key").alias("unique_key")).filter(~blank(F.col("unique_key"))).distinct()


def _ids(df: DataFrame | None) -> DataFrame | None:
    """The ids of the rows without a key."""
    if df is None or "id" not in df.columns:
        return None
    rows = df.filter(blank(F.col("unique_key"))) if "unique_key" in df.columns else df
    return rows.select("id").filter(F.col("id").isNotNull()).distinct()


def _hits(rows: DataFrame, keys: DataFrame | None, ids: DataFrame | None) -> int:
    return mutate.count_deleted(rows, keys, ids).first().borradas


def run_edit(
    spark: SparkSession, root: str, edits: DataFrame, months: Iterable[str] | None = None
) -> dict[str, int]:
    """Apply edits to the stored ledger; returns the rows edited.

    `months`, where the caller knows them, spare the search for the rows.
    """
    tune(spark)
    edits = stage(edits)

    def attempt(now: store.Version) -> dict[str, int]:
        keys, ids = _keys(edits), _ids(edits)
        touched = _months_with(now, months, keys, ids)
        rows = now.table("ledger", touched)
        n = _hits(rows, keys, ids)
        if n:
            new = {"ledger": (touched, mutate.apply_edits(rows, edits))}
            store.commit(spark, root, months=new, base=now, reads=touched)
        return {"editadas": n}

    return repeated(spark, root, attempt)


def _unknown(rows: DataFrame, keys: DataFrame | None) -> bool:
    return keys is not None and not keys.join(rows.select("unique_key"), "unique_key", "left_anti").isEmpty()


def run_delete(
    spark: SparkSession,
    root: str,
    keys: DataFrame | None = None,
    ids: DataFrame | None = None,
    at=None,
    months: Iterable[str] | None = None,
) -> dict[str, int]:
    """Delete rows by key and by id, so that no later upload brings them back; returns how many.

    Keys enter the ignored list in any case and the tombstones where a row was deleted.
    """
    if keys is None and ids is None:
        return {"borradas": 0}
    tune(spark)
    keys, ids = (None if df is None else stage(df) for df in (_keys(keys), ids))

    def attempt(now: store.Version) -> dict[str, int]:
        touched = _months_with(now, months, keys, None if ids is None else ids.select("id"))
        rows = now.table("ledger", touched)
        n = _hits(rows, keys, ids)
        rest, ignored, tombs = mutate.deletion(
            rows, now.table("ignored"), now.table("tombstones"), keys, ids, at
        )
        # A key without a row may belong to any month.
        more = [store.ANYTHING] if _unknown(rows, keys) else []
        store.commit(
            spark, root, append={"ignored": ignored, "tombstones": tombs},
            months={"ledger": (touched, rest)} if n else None, base=now,
            reads=[*touched, *more], touched=[*touched, *more],
        )
        return {"borradas": n}

    return repeated(spark, root, attempt)


def run_save(
    spark: SparkSession,
    root: str,
    before: DataFrame,
    after: DataFrame,
    at=None,
    learn: bool = True,
    months: Iterable[str] | None = None,
) -> dict[str, int]:
    """Save an edited table: rows that left it are deleted, the others edited, in one version.

    With `learn`, each name's category in the saved table, the newest row's, becomes its rule.
    """
    tune(spark)
    edits, gone = (stage(df) for df in mutate.save_diff(before, after))

    def attempt(now: store.Version) -> dict[str, int]:
        keys, deleted = _keys(edits), _keys(gone)
        touched = _months_with(now, months, keys, deleted)
        rows = now.table("ledger", touched)
        numbers = {"editadas": _hits(rows, keys, None), "borradas": _hits(rows, deleted, None)}
        changed = stage(mutate.apply_edits(rows, edits))
        rest, ignored, tombs = mutate.deletion(
            changed, now.table("ignored"), now.table("tombstones"), deleted, None, at
        )
        replaced = {}
        if learn:
            shown = changed.join(keys, "unique_key", "left_semi")
            newest = F.struct(F.coalesce(-F.unix_date("fecha"), F.lit(1 << 30)), "unique_key")
            replaced["rules"] = rules.learn_rules(now.table("rules"), shown.withColumn("_order", newest), order="_order")
        store.commit(
            spark, root, append={"ignored": ignored, "tombstones": tombs}, replace=replaced,
            months={"ledger": (touched, rest)}, base=now, reads=touched, touched=touched,
        )
        return numbers

    return repeated(spark, root, attempt)


def run_manual(spark: SparkSession, root: str, entries: DataFrame) -> dict[str, int]:
    """Append the manual entries the ledger does not hold yet; returns how many."""
    tune(spark)
    wanted = stage(mutate.manual_rows(entries))
    touched = months_in(wanted)

    def attempt(now: store.Version) -> dict[str, int]:
        held = now.table("ledger", touched).select("unique_key")
        new = stage(wanted.join(held, "unique_key", "left_anti").select(*wanted.columns))
        n = new.count()
        if n:
            store.commit(spark, root, append={"ledger": new}, base=now, reads=touched)
        return {"insertadas": n}

    return repeated(spark, root, attempt)


def run_restore(spark: SparkSession, root: str, keys: DataFrame | None = None) -> dict[str, int]:
    """Bring back the selected, or all, ignored rows with a payload; returns how many.

    A key says its date, so a restored row replaces a row of its own month.
    """
    tune(spark)
    keys = None if keys is None else stage(_keys(keys))

    def attempt(now: store.Version) -> dict[str, int]:
        ignored = now.table("ignored")
        back = stage(mutate.restorable(ignored, keys))
        touched = months_in(back)
        n = back.count()
        if n:
            left = ignored.join(back.select("unique_key"), "unique_key", "left_anti").select(*ignored.columns)
            rows = mutate.replace_rows(now.table("ledger", touched), back)
            store.commit(
                spark, root, replace={"ignored": left}, months={"ledger": (touched, rows)}, base=now, reads=touched
            )
        return {"restauradas": n}

    return repeated(spark, root, attempt)


def _months_where(now: store.Version, condition) -> list[str]:
    rows = now.table("ledger", with_month=True).filter(condition).select("mes").distinct()
    return sorted(r.mes for r in rows.collect())


def run_repair(spark: SparkSession, root: str) -> dict[str, int]:
    """Set `monto` to the corrected amount where they differ; returns the rows repaired."""
    tune(spark)

    def attempt(now: store.Version) -> dict[str, int]:
        touched = _months_where(now, mutate.discrepant())
        rows, counts = mutate.repair_amounts(now.table("ledger", touched))
        n = counts.first().reparados
        if n:
            store.commit(spark, root, months={"ledger": (touched, rows)}, base=now, reads=touched)
        return {"reparadas": n}

    return repeated(spark, root, attempt)


def category_list(now: store.Version) -> DataFrame:
    """The stored category list, the usual one before the first is stored."""
    if now.tables.get("categories"):
        return now.table("categories")
    return now.spark.createDataFrame([(c,) for c in DEFAULT_CATEGORIES], "nombre string")


def run_rename(spark: SparkSession, root: str, old: str, new: str) -> dict[str, int]:
    """Rename a category in the ledger, the rules and the category list; returns the ledger rows."""
    tune(spark)
    if not old or not new or old == new or old == UNCATEGORISED:
        return {"renombradas": 0}

    def attempt(now: store.Version) -> dict[str, int]:
        named = F.col("categoria") == old
        touched = _months_where(now, named)
        ledger = now.table("ledger", touched)
        n = ledger.filter(named).count()
        rows, learned, listed = rules.rename_category(ledger, now.table("rules"), category_list(now), old, new)
        store.commit(
            spark, root, replace={"rules": learned, "categories": listed},
            months={"ledger": (touched, rows)} if n else None, base=now, reads=touched,
        )
        return {"renombradas": n}

    return repeated(spark, root, attempt)


def run_decisions(
    spark: SparkSession, root: str, decisions: DataFrame, months: Iterable[str] | None = None
) -> dict[str, int]:
    """Store accepted and manual categories and the rules they teach; returns the rows decided."""
    tune(spark)
    valid = ~blank(F.col("categoria")) & (F.col("categoria") != UNCATEGORISED)
    decisions = stage(decisions.filter(valid))

    def attempt(now: store.Version) -> dict[str, int]:
        keys = _keys(decisions)
        touched = _months_with(now, months, keys)
        ledger = now.table("ledger", touched)
        n = _hits(ledger, keys, None)
        if n:
            rows, learned = suggest.apply_decisions(ledger, now.table("rules"), decisions)
            store.commit(
                spark, root, replace={"rules": learned}, months={"ledger": (touched, rows)}, base=now, reads=touched
            )
        return {"decididas": n}

    return repeated(spark, root, attempt)


def run_learn(spark: SparkSession, root: str, labelled: DataFrame, order: str | None = None) -> None:
    """Store the exact rules that labelled rows teach."""
    tune(spark)
    labelled = stage(labelled)

    def attempt(now: store.Version) -> None:
        learned = rules.learn_rules(now.table("rules"), labelled, order)
        store.commit(spark, root, replace={"rules": learned}, base=now, reads=[])

    repeated(spark, root, attempt)
