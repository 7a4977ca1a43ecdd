"""Plan shapes that matter at scale, with every size-based broadcast switched off."""

import re

import pytest

from monedero.operators import metrics, reimburse, views
from monedero.plans import catalog
from monedero.sources import store

SF = "/root/testdata/sf0.001"
HEAVY = (
    "ingest", "ingest_ignored", "ingest_counts", "suggestions", "suggest_similar", "reimbursements",
    "update_master", "merchant_rules_join", "apply_edits", "delete_rows", "projection", "current_month",
)


@pytest.fixture()
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    yield spark
    for k in keys:
        spark.conf.unset(k)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HEAVY)
def test_no_pairing_and_no_python(no_broadcast, name):
    plan = plan_of(catalog.queries()[name](no_broadcast, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|EvalPython|MapInPandas", plan)


def test_filters_and_columns_reach_the_stored_ledger(spark, tmp_path):
    ledger = catalog.queries()["export_backup"](spark, SF)
    store.save_snapshot(ledger, str(tmp_path / "s"))
    month = views.filter_month(store.load_ledger(spark, str(tmp_path / "s")), "1998-03")
    plan = plan_of(metrics.spend_by_category(month))
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "GreaterThanOrEqual(fecha" in scan and "detalle" not in scan


def test_month_pruning(spark, tmp_path):
    ledger = catalog.queries()["export_backup"](spark, SF)
    store.save_snapshot(ledger, str(tmp_path / "s"))
    part = store.load_ledger(spark, str(tmp_path / "s"), "1998-03-05", "1998-04-10")
    partition_filters = re.search(r"PartitionFilters: \[([^\]]*)", plan_of(part)).group(1)
    assert "mes" in partition_filters and "1998-03" in partition_filters
    want = views.filter_range(ledger, "1998-03-05", "1998-04-10")
    assert part.count() == want.count() > 0


def above(lines, at):
    """The operators between a line of a plan and its root, by indentation."""
    out, depth = [], len(lines[at]) - len(lines[at].lstrip(" :+-"))
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            out.append(line.lstrip(" :+-").split("(")[0].split(" ")[0])
            depth = own
    return out


def test_only_credits_meet_the_reimbursement_answers(no_broadcast, tmp_path):
    path = str(tmp_path / "ledger")
    catalog.queries()["export_backup"](no_broadcast, SF).write.parquet(path)
    found = reimburse.match_reimbursements(no_broadcast.read.parquet(path))
    lines = [x for x in plan_of(found).splitlines() if x.strip()]
    scans = [i for i, x in enumerate(lines) if "FileScan" in x]
    # The last scan is that of all other rows.
    assert "Union" in above(lines, scans[-1]) and "Exchange" not in above(lines, scans[-1])
    assert "Exchange" in above(lines, scans[0])
    assert found.count() == no_broadcast.read.parquet(path).count()
