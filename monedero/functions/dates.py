"""Date parsers: text to DATE by trying layouts in order, NULL when none fits.

The shape of the text picks the few layouts worth trying, so a row seldom pays
for a failed parse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes: three numbers with one separator twice.
_YEAR_FIRST = r"^[0-9]{4}([-/])[0-9]{1,2}\1[0-9]{1,2}$"
_YEAR_LAST = r"^[0-9]{1,2}([-/.])[0-9]{1,2}\1[0-9]{4}$"
_SHORT_YEAR = r"^[0-9]{1,2}([-/])[0-9]{1,2}\1[0-9]{2}$"
_TIMESTAMP = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ][0-9]{1,2}:[0-9]{2}"
_COMPACT = r"^[0-9]{8}$"
# A time of day after the date.
_TIME = r"(?i)[T ,]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?(?: ?[ap]\.?m\.?)?(?:Z| ?[+-][0-9]{2}:?[0-9]{2})?$"
# --- fixed values: month names, Spanish then English ------------------------
_MONTH = (
    "ene(?:ro)?|jan(?:uary)?|feb(?:rero|ruary)?|mar(?:zo|ch)?|abr(?:il)?|apr(?:il)?|mayo?|jun(?:io|e)?|jul(?:io|y)?"
    "|ago(?:sto)?|aug(?:ust)?|sep(?:t|tiembre|tember)?|set(?:iembre)?|oct(?:ubre|ober)?|nov(?:iembre|ember)?"
    "|dic(?:iembre)?|dec(?:ember)?"
)
_MONTH_NUMBERS = {
    "ene": 1, "jan": 1, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "aug": 8,
    "sep": 9, "set": 9, "oct": 10, "nov": 11, "dic": 12, "dec": 12,
}
_WEEKDAY = (
    "lun(?:es)?|mar(?:tes)?|mi[eé](?:rcoles)?|jue(?:ves)?|vie(?:rnes)?|s[aá]b(?:ado)?|dom(?:ingo)?"
    "|mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:rs(?:day)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
)
# ----------------------------------------------------------------------------
# A weekday, and after it a date by numbers, by day and month, or by month and day.
_AFTER_WEEKDAY = rf"(?i)^(?:{_WEEKDAY})\.?,? +(?=[0-9]{{1,4}}[-/.]|[0-9]{{1,2}} +(?:de )?[a-z]|(?:{_MONTH})\.? +[0-9])"
_DAY_NAME = rf"(?i)^([0-9]{{1,2}})[ ./-]+(?:de )?({_MONTH})\.?[ ,./-]+(?:del? )?([0-9]{{4}}|[0-9]{{2}})$"
_NAME_DAY = rf"(?i)^({_MONTH})\.? +([0-9]{{1,2}}),? +([0-9]{{4}})$"


def _text(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(" \t\n\r\u00a0"))


def _read(text: Column, layout: str) -> Column:
    """Parse with dashes whatever the separator was."""
    return F.try_to_date(F.translate(text, "/.", "--"), layout)


def _read_short_year(text: Column) -> Column:
    """Two-digit years from 69 on belong to the last century."""
    day = _read(text, "d-M-yy")
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)


def _read_timestamp(text: Column) -> Column:
    return F.try_to_date(F.regexp_extract(text, "^[0-9-]+", 0), "yyyy-M-d")


def _day_first(text: Column) -> Column:
    month_first = F.when(F.contains(text, F.lit("/")), _read(text, "M-d-yyyy"))
    return F.coalesce(_read(text, "d-M-yyyy"), month_first)


def _numbered(text: Column) -> Column:
    """'5 mar 2024', '5 de marzo de 2024' or 'March 5, 2024' as '5-3-2024', other text unchanged."""
    day_first = F.regexp_replace(text, _NAME_DAY, "$2 $1 $3")
    numbers = F.create_map(*[F.lit(x) for name, no in _MONTH_NUMBERS.items() for x in (name, str(no))])
    name = F.lower(F.left(F.regexp_extract(day_first, _DAY_NAME, 2), F.lit(3)))
    day, year = (F.regexp_extract(day_first, _DAY_NAME, i) for i in (1, 3))
    dash = F.lit("-")
    return F.coalesce(F.concat(day, dash, F.try_element_at(numbers, name), dash, year), text)


def _free(text: Column) -> Column:
    """What follows the plain layouts: weekdays, a time after the date, compact dates, month names."""
    day = _numbered(F.regexp_replace(F.regexp_replace(text, _TIME, ""), _AFTER_WEEKDAY, ""))
    return (
        F.when(day.rlike(_YEAR_LAST), _day_first(day))
        .when(day.rlike(_SHORT_YEAR), _read_short_year(day))
        .when(day.rlike(_YEAR_FIRST), _read(day, "yyyy-M-d"))
        .when(day.rlike(_COMPACT), F.try_to_date(day, "yyyyMMdd"))
    )


def date_app(c: Column, date_format: str = "YYYY-MM-DD") -> Column:
    """Upload rule; `date_format` says whether year-first text has month or day second."""
    if date_format not in ("YYYY-MM-DD", "YYYY-DD-MM"):
        raise ValueError("date_format must be 'YYYY-MM-DD' or 'YYYY-DD-MM'")
    text = _text(c)
    order = ["yyyy-M-d", "yyyy-d-M"]
    if date_format == "YYYY-DD-MM":
        order.reverse()
    return (
        F.when(text.rlike(_YEAR_FIRST), F.coalesce(*[_read(text, f) for f in order]))
        .when(text.rlike(_YEAR_LAST), _day_first(text))
        .when(text.rlike(_SHORT_YEAR), _read_short_year(text))
        .when(text.rlike(_TIMESTAMP), _read_timestamp(text))
        .otherwise(_free(text))
    )


def date_cli(c: Column) -> Column:
    """Raw-statement rule: day first, then year first, then month first.

    Year-first text has the month second; with slashes also the day, where that alone fits.
    """
    text = _text(c)
    swapped = F.when(F.contains(text, F.lit("/")), _read(text, "yyyy-d-M"))
    return (
        F.when(text.rlike(_YEAR_LAST), _day_first(text))
        .when(text.rlike(_SHORT_YEAR), _read_short_year(text))
        .when(text.rlike(_YEAR_FIRST), F.coalesce(_read(text, "yyyy-M-d"), swapped))
        .when(text.rlike(_TIMESTAMP), _read_timestamp(text))
        .otherwise(_free(text))
    )


def month_of(c: Column) -> Column:
    """Calendar month as 'yyyy-MM'."""
    return F.date_format(c, "yyyy-MM")
