"""Reimbursements, suggestions and merchant rules against brute force."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from monedero.operators import reimburse, rules, suggest
from monedero.schema import EXACT_RULES, LEDGER, MERCHANT_RULES

DAY = dt.date(2024, 1, 1)
MOVES = "id string, fecha date, monto double"


def brute_matches(rows, window, tol):
    out = {}
    for cid, cf, cm in rows:
        if cm <= 0 or cf is None:
            continue
        best = None
        for gid, gf, gm in rows:
            if gm >= 0 or gf is None or not cf - dt.timedelta(window) <= gf <= cf:
                continue
            gap = abs(abs(Decimal(str(gm))) - Decimal(str(cm)))
            if gap <= Decimal(str(tol)):
                cand = (gap, -gf.toordinal(), gid)
                best = min(best, cand) if best else cand
        out[cid] = best[2] if best else None
    return out


def matches(spark, rows, window, tol):
    df = spark.createDataFrame(rows, MOVES)
    found = reimburse.match_reimbursements(df, window, tol).filter("monto > 0").collect()
    return {r.id: r.match_id for r in found if r.fecha is not None}


def test_reimbursements_equal_brute_force(spark):
    for seed, (window, tol, spread) in enumerate(
        [(21, 1000, 9000), (3, 1.0, 8), (0, 5, 40), (21, 0, 3), (5, 0.5, 2000)]
    ):
        r = random.Random(seed)
        rows = [
            (
                f"{i:04d}",
                None if r.random() < 0.05 else DAY + dt.timedelta(r.randrange(40)),
                r.choice([-1, -1, 1]) * round(r.uniform(0, spread) + 0.01, 2),
            )
            for i in range(250)
        ]
        rows += [(f"h{i:03d}", DAY + dt.timedelta(i % 9), 2.5 if i % 3 else -2.5) for i in range(90)]
        assert matches(spark, rows, window, tol) == brute_matches(rows, window, tol), (window, tol)


def test_reimbursement_edges(spark):
    at = lambda n: DAY + dt.timedelta(n)
    rows = [
        ("e1", at(0), -2000.0),
        ("e2", at(30), -500.0),
        ("far", at(21), 3000.0),  # gap equals the tolerance, 21 days
        ("late", at(22), 2000.0),  # 22 days
        ("same", at(30), 500.0),  # same day
        ("twice", at(31), 500.0),  # the same expense again
        ("none", at(31), 9000.0),
    ]
    assert matches(spark, rows, 21, 1000.0) == {
        "far": "e1", "late": None, "same": "e2", "twice": "e2", "none": None,
    }


def test_credits_ask_few_units():
    """Every day of the window is asked exactly once, by far fewer questions than it has days."""
    for window in (0, 1, 3, 21, 365):
        block = reimburse._block_days(window)
        for phase in range(block):
            units = reimburse.units_asked(window, block, phase)
            days = [d for size, start in units for d in range(start, start + size)]
            assert sorted(days) == list(range(-window, 1)), (window, phase)
            assert all(size in (1, block) and (size == 1 or (phase + start) % block == 0) for size, start in units)
            assert window != 21 or len(units) <= 10


def test_reimbursement_ties_across_units(spark):
    """Equal gaps below and above, on one day and on days of one block or of two, before and after 1970."""
    for first in (dt.date(1969, 12, 20), DAY):
        r = random.Random(first.year)
        rows = [
            (f"{i:04d}", first + dt.timedelta(r.randrange(30)), r.choice([-1, -1, 1]) * r.choice([90.0, 95.0, 100.0, 105.0, 110.0]))
            for i in range(60)
        ]
        for window, tol in ((21, 20.0), (21, 5.0), (2, 10.0), (1, 5.0), (40, 3.0)):
            assert matches(spark, rows, window, tol) == brute_matches(rows, window, tol), (first, window, tol)
    rows = [("b", DAY, -90.0), ("a", DAY, -110.0), ("z", DAY + dt.timedelta(1), -111.0), ("c", DAY + dt.timedelta(3), 100.0)]
    assert matches(spark, rows, 21, 50.0) == {"c": "a"}


def ledger_of(spark, rows):
    """(key, name, category, amount) rows as a ledger."""
    base = spark.createDataFrame(rows, "unique_key string, detalle_norm string, categoria string, monto double")
    have = base.columns
    return base.withColumn("detalle", F.col("detalle_norm")).select(
        *[
            F.col(f.name) if f.name in [*have, "detalle"] else F.lit(None).cast(f.dataType).alias(f.name)
            for f in LEDGER
        ]
    )


def brute_similar(pending, history):
    out = {}
    for key, name, _, amount in pending:
        up = name.strip().upper()
        hits = [h for h in history if h[1].strip().upper() == up]
        if not hits and len(up) >= 4:
            hits = [h for h in history if up[:4] in h[1].strip().upper()]
        m = abs(Decimal(str(amount or 0)))
        if m > 0:
            tol = max(m * Decimal("0.25"), Decimal(1000))
            near = [h for h in hits if m - tol <= abs(Decimal(str(h[3] or 0))) <= m + tol]
            hits = near or hits
        counts = {}
        for h in hits:
            counts[h[2]] = counts.get(h[2], 0) + 1
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]
        if top:
            total = sum(n for _, n in top)
            out[key] = [(c, round(n / total, 9)) for c, n in top]
    return out


def test_similar_equals_brute_force(spark):
    for seed in range(2):
        r = random.Random(seed)
        names = ["uber eats", "uber", "UBER trip", "ub", "super uno", "superdos", "xuberx", "otro", "abc"]
        cats = ["A", "B", "C", "D", ""]
        amounts = [0.0, None, 5.0, -999.99, 1000.0, -1500.25, 4000.0, -5000.0, 6250.0, -90000.0, 120000.0]
        history = [(f"h{i}", r.choice(names[:7]), r.choice(cats), r.choice(amounts)) for i in range(60)]
        pend = [(f"p{i}", r.choice(names + ["uberto", "supe"]), None, r.choice(amounts)) for i in range(60)]
        ledger = ledger_of(spark, history + pend)
        found = suggest.suggest_similar(suggest.pending(ledger), ledger).collect()
        got = {x.unique_key: [(a.categoria, round(a.score, 9)) for a in x.alternativas] for x in found}
        # Rows categorised "" are pending as well as history.
        blank = [h for h in history if h[2] == ""]
        assert got == brute_similar(pend + blank, history), seed


def test_cascade_gives_each_pending_row_one_suggestion(spark):
    history = [(f"d{i}", "dominado", "A" if i < 7 else "B", 10.0) for i in range(10)]
    history += [(f"t{i}", "dividido", "A" if i < 699 else "B", 10.0) for i in range(1000)]
    history += [("b1", "vacio", "", 10.0)]
    pend = [
        ("p1", "regla", None, 1.0), ("p2", "dominado", None, 1.0), ("p3", "dividido", "Sin categoría", 10.0),
        ("p4", "xyz", None, 1.0), ("p5", "", None, 1.0), ("p6", "vacio", None, 10.0),
    ]
    ledger = ledger_of(spark, history + pend)
    rule_table = spark.createDataFrame([("regla", "Hogar"), ("xyz", " ")], EXACT_RULES)
    got = {r.unique_key: r for r in suggest.suggestions(ledger, ledger, rule_table).collect()}
    assert set(got) == {"p1", "p2", "p3", "p4", "p6", "b1"}
    assert (got["p1"].sugerida, got["p1"].fuente, got["p1"].confianza) == ("Hogar", "Mapa exacto", 1.0)
    assert (got["p2"].sugerida, got["p2"].fuente, got["p2"].confianza) == ("A", "Historial dominante", 0.8)
    assert (got["p3"].sugerida, got["p3"].fuente) == ("A", "Nombres similares (0.70)")
    assert abs(got["p3"].confianza - 0.699) < 1e-12
    assert (got["p4"].sugerida, got["p4"].fuente, got["p4"].confianza) == ("Sin categoría", "Sin sugerencia", 0.0)
    assert got["p6"].sugerida == "" and got["p6"].confianza == 1.0


def test_empty_history_and_rules(spark):
    ledger = ledger_of(spark, [("p1", "uber", None, 5.0)])
    got = suggest.suggestions(ledger, ledger, spark.createDataFrame([], EXACT_RULES)).collect()
    assert [(r.sugerida, r.fuente) for r in got] == [("Sin categoría", "Sin sugerencia")]


def test_merchant_rules_first_wins_in_both_plans(spark):
    r = random.Random(5)
    words = ["uber", "ub", "eats", "er e", "lime*viaje", "lime", "x"]
    keys = [(i, None, None, r.choice(words), f"C{i}") for i in range(12)]
    keys += [(50, DAY, "b", "net", "late"), (50, DAY, "a", "net p", "early")]
    table = spark.createDataFrame(keys, MERCHANT_RULES)
    texts = ["".join(r.choice(words + [" "]) for _ in range(3)) for _ in range(50)] + ["net parking", "", None]
    rows = [(i, t, "given" if i % 9 == 0 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, detalle_norm string, categoria string")

    def expected(text, given):
        if given or text is None:
            return given
        order = sorted(keys, key=lambda k: (k[0], k[1] is None, str(k[1]), k[2] or ""))
        return next((k[4] for k in order if k[3] in text), None)

    want = {i: expected(t, c) for i, t, c in rows}
    for limit in (100, 0):
        got = {x.i: x.categoria for x in rules.apply_merchant_rules(df, table, limit).collect()}
        assert got == want, limit


def test_learned_rules_keep_place_and_follow_newest_row(spark):
    old = spark.createDataFrame([(0, None, None, "UBER", "Viejo"), (1, None, None, "ZZZ", "Queda")], MERCHANT_RULES)
    df = spark.createDataFrame(
        [
            ("1", dt.date(2024, 1, 2), "UBER*TRIP", "Primero"),
            ("2", dt.date(2024, 1, 3), "UBER *EATS", " Ultimo "),
            ("3", None, "UBER", "SinFecha"),
            ("4", dt.date(2024, 1, 1), "NUEVO*1", "N"),
            ("5", dt.date(2024, 1, 1), "AB*CDEF", "corta"),
            ("6", dt.date(2024, 1, 1), "ABC", "corto"),
            ("7", dt.date(2024, 1, 1), "OTRO LADO", " "),
        ],
        "id string, fecha date, detalle_norm string, categoria string",
    )
    got = {r.key: (r.ord, r.categoria) for r in rules.learn_merchant_rules(df, old).collect()}
    assert got == {"UBER": (0, "SinFecha"), "ZZZ": (1, "Queda"), "NUEVO": (2, "N")}
