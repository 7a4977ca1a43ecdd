"""The two jobs that change stored tables: uploading statements and updating the master."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Sequence
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monedero.operators import ingest as ing
from monedero.operators.reimburse import match_reimbursements, net_mine
from monedero.operators.rules import (
    apply_merchant_rules,
    learn_merchant_rules,
    mark_own_transfers,
    merged_teachers,
    teaching_rows,
    with_learned,
)
from monedero.schema import FILES, MASTER, MERCHANT_RULES, MatchConfig
from monedero.session import stage, tune
from monedero.sources import store
from monedero.sources.statements import read_lines, read_upload

T = TypeVar("T")
#: Times a change is computed before it gives way to other writers.
ATTEMPTS = 5


def run_upload(
    spark: SparkSession,
    path: str | Sequence[str],
    root: str,
    date_format: str = "YYYY-MM-DD",
    batch_id: int | None = None,
    source: str | None = None,
    at=None,
    unreadable: dict[str, str] | None = None,
) -> dict[str, int]:
    """Read statement files, ingest them into the store under `root`, return the counts.

    New rows, new ignored entries and the input that does not count (`rejected`, counted
    as `rechazadas`) enter the store in one version. Only the ledger's months that the
    batch has rows of are read. Where another writer touches those months meanwhile, the
    upload is computed again from the newer version.

    With `unreadable`, files set aside with the reason of each, the outcome of these and of
    every file in `path` enters the table `files`.
    """
    raw, flawed = read_upload(read_lines(tune(spark), path), date_format)
    flawed = stage(flawed)

    def attempt(now: store.Version) -> dict[str, int]:
        batch = stage(ing.clean_batch(raw, now.table("rules")))
        months = months_in(batch)
        ledger, ignored, tombstones = now.table("ledger", months), now.table("ignored"), now.table("tombstones")
        filled = not now.table("ledger").isEmpty()
        inserted, entries, counts = ing.ingest_batch(batch, ledger, ignored, tombstones, at, filled)
        known = now.table("rejected")
        same = [flawed[c].eqNullSafe(known[c]) for c in flawed.columns]
        new = {"ledger": inserted, "ignored": entries, "rejected": flawed.join(known, same, "left_anti")}
        if unreadable is not None:
            new["files"] = _outcomes(spark, path, flawed, unreadable, batch_id)
        numbers = counts.first().asDict() | {"rechazadas": flawed.count()}
        store.commit(
            spark, root, append=new, batch_id=batch_id, source=source, base=now,
            reads=months if filled else [store.ANYTHING], touched=months,
        )
        return numbers

    return repeated(spark, root, attempt)


def _same_path(path: str) -> str:
    """A path as Spark's file metadata spells it."""
    return re.sub("^file:/+", "file:///", path)


def _outcomes(
    spark: SparkSession, paths: Sequence[str], flawed: DataFrame, unreadable: dict[str, str], batch_id: int | None
) -> DataFrame:
    """One row per file: as many as the caller named."""
    missing = {
        _same_path(r.source_file): r.reason
        for r in flawed.filter(F.col("line_no").isNull()).select("source_file", "reason").distinct().collect()
    }
    rows = [(p, "rejected" if _same_path(p) in missing else "read", missing.get(_same_path(p)), batch_id) for p in paths]
    rows += [(p, "unreadable", reason, batch_id) for p, reason in unreadable.items()]
    return spark.createDataFrame(rows, FILES)


def months_in(rows: DataFrame) -> list[str]:
    """The months of the rows: as many values as there are months, whatever the rows."""
    return sorted(r.mes for r in rows.select(store.month_name("fecha").alias("mes")).distinct().collect())


def repeated(spark: SparkSession, root: str, attempt: Callable[[store.Version], T]) -> T:
    """Run an attempt on the newest version, again where another writer was faster."""
    for left in reversed(range(ATTEMPTS)):
        try:
            return attempt(store.current(spark, root))
        except store.Moved:
            if not left:
                raise
    raise AssertionError("unreachable")


def update_master(
    new: DataFrame,
    master: DataFrame,
    rules: DataFrame,
    cfg: MatchConfig = MatchConfig(),
    master_is_unique: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(master, rules) after merging standardised rows.

    Rules and own accounts act on the new rows only; matching, my amounts and
    learning act on the whole master. What is learned now acts from the next run.
    """
    fresh = new.join(master.select("id"), "id", "left_anti").select(*new.columns)
    fresh = mark_own_transfers(apply_merchant_rules(fresh, rules), cfg.account_aliases)
    # Expenses, credits and answers are taken from the merged rows, which are put together once.
    whole = stage(ing.merge_master(master, fresh, master_is_unique, new_is_fresh=True))
    merged = net_mine(
        match_reimbursements(whole, cfg.reimbursement_window_days, cfg.reimbursement_amount_tolerance)
    )
    columns = [f.name for f in MASTER if f.name in merged.columns]
    return merged.select(*columns), learn_merchant_rules(merged, rules)


def _next_months(month: str, days: int, step: int) -> set[str]:
    """The month and those within `days` after its last day, or before its first one."""
    if month == store.UNDATED:
        return {month}
    first = dt.date.fromisoformat(f"{month}-01")
    last = (first + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
    reach = last if step > 0 else first
    days_in = (reach + dt.timedelta(days=step * n) for n in range(days + 1))
    return {month} | {d.isoformat()[:7] for d in days_in}


def run_update_master(
    spark: SparkSession,
    new: DataFrame,
    root: str,
    rules: DataFrame | None = None,
    cfg: MatchConfig = MatchConfig(),
) -> DataFrame:
    """Merge standardised rows into the stored master and return the rules it then has.

    The rules live in the store: `rules` are the hand-written ones it starts with, and what
    a run learns acts from the next run on. A new row can change the match of credits up to
    the matching window after it, so only the months of the new rows and those the window
    reaches are read and replaced; the months before them are read for their expenses. The
    newest row that taught each merchant is kept with the rules, so learning looks at the
    new rows only.
    """
    tune(spark)
    new = stage(new.select(*[f.name for f in MASTER if f.name in new.columns]))
    # Equal ids are settled once, before any attempt: only their rows are compared.
    once = ing.once_per_id(new)
    days = cfg.reimbursement_window_days

    def attempt(now: store.Version) -> DataFrame:
        known = now.table("merchant_rules")
        if not now.tables.get("merchant_rules") and rules is not None:
            known = rules.select(*[f.name for f in MERCHANT_RULES])
        # An id says its date, so a known row is in the same month.
        held = now.table("master", months_in(new)).select("id")
        fresh = once.join(held, "id", "left_anti").select(*new.columns)
        fresh = stage(mark_own_transfers(apply_merchant_rules(fresh, known), cfg.account_aliases))
        touched = set().union(*[_next_months(m, days, 1) for m in months_in(fresh)])
        before = set().union(*[_next_months(m, days, -1) for m in touched]) - touched
        old = now.table("master", touched)
        merged = old.unionByName(fresh, allowMissingColumns=True).withColumn("_own", F.lit(True))
        spent = now.table("master", before).filter("monto < 0").withColumn("_own", F.lit(False))
        matched = match_reimbursements(merged.unionByName(spent), days, cfg.reimbursement_amount_tolerance)
        kept = net_mine(matched.filter("_own")).select(*[f.name for f in MASTER])
        # The first run also learns from what is there.
        teachers = now.table("merchant_teachers")
        everything = now.tables.get("master") and not now.tables.get("merchant_teachers")
        taught = now.table("master").unionByName(fresh, allowMissingColumns=True) if everything else fresh
        taught_by = stage(merged_teachers(teaching_rows(taught), teachers))
        newest = taught_by.select(*teachers.columns)
        learned = stage(with_learned(known, taught_by))
        store.commit(
            spark,
            root,
            replace={"merchant_rules": learned, "merchant_teachers": newest},
            months={"master": (touched, kept)},
            base=now,
            reads=touched | before,
        )
        return learned

    learned = repeated(spark, root, attempt)
    return learned.orderBy("ord", F.asc_nulls_last("since"), "since_id")
