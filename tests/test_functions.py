"""Edge values of the text, amount, date, flag and key expressions."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from monedero import functions as fn


def evaluate(spark, values, f):
    """Apply `f` to each text."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


AMOUNTS = {
    # text: (raw statement, upload)
    "1.234,56": (1234.56, 1.23456),
    "1,234.56": (1.23456, 1234.56),
    "1.234": (1.234, 1.234),
    "1,234,567": (1234567.0, None),
    "$ 12.000": (12.0, 12.0),
    "CLP 5": (5.0, 5.0),
    "": (None, None),
    "-": (None, None),
    "abc": (None, None),
    None: (None, None),
    "1.0d": (1.0, None),
    "nan": (None, None),
    "1 234": (1234.0, 1234.0),
    "-1.500,25": (-1500.25, -1.50025),
    "12,5": (12.5, 12.5),
    "3-4": (None, None),
}


def test_amounts(spark):
    assert evaluate(spark, list(AMOUNTS), fn.amount_cli) == [v[0] for v in AMOUNTS.values()]
    assert evaluate(spark, list(AMOUNTS), fn.amount_app) == [v[1] for v in AMOUNTS.values()]


def test_amount_with_known_separator(spark):
    texts = ["1.234", "1.234,5", "12.000", "x"]
    assert evaluate(spark, texts, lambda c: fn.amount_sep(c, ",")) == [1234.0, 1234.5, 12000.0, None]
    assert evaluate(spark, texts, lambda c: fn.amount_sep(c, ".")) == [1.234, 1.2345, 12.0, None]
    with pytest.raises(ValueError):
        fn.amount_sep(F.lit("1"), ";")


def test_dates(spark):
    d = dt.date
    texts = [
        "2026-08-02", "31/12/24", "12/31/2024", "5.3.2024", "2024-02-30", "2024-03-05T10:00:00",
        " 2024-03-05 10:00:00", "", None, "31-12-1999", "1/2/69", "1/2/68", "2024/13/01", "05-13-2024",
        "2024-3/5", "2026-25-02",
    ]
    app = [
        d(2026, 8, 2), d(2024, 12, 31), d(2024, 12, 31), d(2024, 3, 5), None, d(2024, 3, 5),
        d(2024, 3, 5), None, None, d(1999, 12, 31), d(1969, 2, 1), d(2068, 2, 1), d(2024, 1, 13), None,
        None, d(2026, 2, 25),
    ]
    assert evaluate(spark, texts, fn.date_app) == app
    free = [
        "05/03/2024 14:33", "05-03-2024 14:33:10", "5 mar 2024", "05 Jan 2024", "20240305", "05.03.2024 8:05",
        "5 de marzo de 2024", "March 5, 2024", "05-dic-24", "5/3/24 2:30 pm", "5 marzipan 2024", "20241305", "31 feb 2024",
    ]
    read = [
        d(2024, 3, 5), d(2024, 3, 5), d(2024, 3, 5), d(2024, 1, 5), d(2024, 3, 5), d(2024, 3, 5),
        d(2024, 3, 5), d(2024, 3, 5), d(2024, 12, 5), d(2024, 3, 5), None, None, None,
    ]
    assert evaluate(spark, free, fn.date_app) == read
    assert evaluate(spark, free, fn.date_cli) == read
    assert evaluate(spark, ["2024/03/05 10:00"], fn.date_app) == [d(2024, 3, 5)]
    weekdays = [
        "martes 5 de marzo de 2024", "Mar, 05/03/2024", "Tuesday, March 5, 2024", "mar 5 mar 2024 10:15", "tue 2024-03-05",
        "Mar 5, 2024", "mar 5 2024", "miércoles", "martes 31/02/2024", "marte 5 mar 2024",
    ]
    days = [d(2024, 3, 5)] * 7 + [None] * 3
    assert evaluate(spark, weekdays, fn.date_app) == days
    assert evaluate(spark, weekdays, fn.date_cli) == days
    slashes = ["2024/03/05", "2024/25/03", "2024-25-03", "2024/03/05 08:00", "2024/31/31"]
    assert evaluate(spark, slashes, fn.date_cli) == [d(2024, 3, 5), d(2024, 3, 25), None, d(2024, 3, 5), None]
    swapped = evaluate(spark, ["2026-08-02", "2026-02-25"], lambda c: fn.date_app(c, "YYYY-DD-MM"))
    assert swapped == [d(2026, 2, 8), d(2026, 2, 25)]
    cli = evaluate(spark, ["05/03/2024", "12/31/2024", "2024-03-05", "31-12-70", "5.3.2024", "2024/03/05"], fn.date_cli)
    assert cli == [d(2024, 3, 5), d(2024, 12, 31), d(2024, 3, 5), d(1970, 12, 31), d(2024, 3, 5), d(2024, 3, 5)]
    with pytest.raises(ValueError):
        fn.date_app(F.lit("x"), "DD-MM")


def test_normal_forms(spark):
    texts = ["  Café  ÑUÑOA ", "Café\t x\ny", "Nº 5", "***", None, "LIME*VIAJE", "straße"]
    assert evaluate(spark, texts, fn.norm_db) == [
        "cafe nunoa", "cafe x y", "nº 5", "***", "", "lime*viaje", "straße",
    ]
    assert evaluate(spark, texts, fn.norm_cli) == [
        "CAFE NUNOA", "CAFE X Y", "Nº 5", "***", "", "LIME*VIAJE", "STRASSE",
    ]
    assert evaluate(spark, texts, fn.norm_alnum) == [
        "CAFE NUNOA", "CAFE X Y", "NO 5", "", "", "LIME VIAJE", "STRASSE",
    ]


def test_flags(spark):
    texts = ["1", "0", " SÍ ", "verdadero", "2", "-3", "no", None, "true", "00"]
    assert evaluate(spark, texts, fn.truthy) == [
        True, False, True, False, False, False, False, False, True, False,
    ]
    assert evaluate(spark, texts, fn.truthy_stored) == [
        True, False, True, True, True, True, False, None, True, False,
    ]


def test_keys_match_their_definition(spark):
    day = F.lit("2024-03-05").cast("date")
    row = spark.range(1).select(
        fn.ledger_key(day, F.lit("cafe"), F.lit(-12.5)).alias("k"),
        fn.ledger_key(day, F.lit("cafe"), F.lit(12.50)).alias("k2"),
        fn.ledger_key(F.lit(None).cast("date"), F.lit("cafe"), F.lit(None).cast("double")).alias("u"),
        fn.manual_key(day, F.lit(12.5), F.lit("CAFE")).alias("m"),
        fn.cli_id(day, F.lit("CAFE"), F.lit(-12.5)).alias("c"),
    ).first()
    sha256 = lambda t: hashlib.sha256(t.encode()).hexdigest()[:16]
    sha1 = lambda t: hashlib.sha1(t.encode()).hexdigest()[:16]
    assert row.k == row.k2 == "k:" + sha256("2024-03-05|cafe|12.50")
    assert row.u == "k:" + sha256("NaT|cafe|0.00")
    assert row.m == "m:" + sha1("2024-03-05|12.50|CAFE")
    assert row.c == sha1("2024-03-05|CAFE|-12.50")


def test_amounts_beyond_the_exact_type_keep_their_row(spark):
    values = ["99999999999999999999", "99999999999999999998000", "12.5"]
    assert evaluate(spark, values, lambda c: fn.money(fn.amount_app(c)).cast("double")) == [None, None, 12.5]
    keys = evaluate(spark, values, lambda c: fn.ledger_key(F.lit(None).cast("date"), F.lit("x"), fn.amount_app(c)))
    assert len(set(keys)) == 3 and None not in keys
