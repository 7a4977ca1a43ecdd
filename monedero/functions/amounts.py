"""Amount parsers. Every parser gives NULL where the text is no number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from monedero.schema import MONEY

_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_NOT_AMOUNT = r"[^0-9,.\-]"
_NBSP = "\u00a0"


def _to_double(c: Column) -> Column:
    # The pattern keeps out spellings only Java reads as numbers ('1.0d', 'NaN').
    return F.regexp_extract(c, _NUMBER, 0).try_cast("double")


def amount_cli(c: Column) -> Column:
    """Raw-statement rule: with both separators the dot groups and the comma is decimal."""
    text = c.cast("string")
    kept = F.regexp_replace(text, _NOT_AMOUNT, "")
    both = text.rlike(r",.*\.|\..*,")
    many_commas = text.rlike(r",.*,")
    return _to_double(
        F.when(both, F.translate(kept, ",.", "."))
        .when(many_commas, F.translate(kept, ",", ""))
        .otherwise(F.translate(kept, ",", "."))
    )


def amount_app(c: Column) -> Column:
    """Upload rule: a comma is decimal only where there is no dot, else it groups."""
    text = F.btrim(c.cast("string"), F.lit("\t\n\r" + _NBSP + " "))
    kept = F.regexp_replace(text, f"[$ {_NBSP}]|CLP", "")
    only_comma = text.rlike(r"^[^.]*,[^.]*$")
    return _to_double(
        F.when(only_comma, F.translate(kept, ",", ".")).otherwise(F.translate(kept, ",", ""))
    )


def amount_sep(c: Column, decimal_sep: str) -> Column:
    """Explicit rule for a known layout: `decimal_sep` is '.' or ','; the other one groups."""
    if decimal_sep not in (".", ","):
        raise ValueError("decimal_sep must be '.' or ','")
    group = "," if decimal_sep == "." else "."
    kept = F.regexp_replace(c.cast("string"), _NOT_AMOUNT, "")
    # The group mark has no counterpart in the second list and is dropped.
    return _to_double(F.translate(kept, decimal_sep + group, "."))


def money(c: Column) -> Column:
    """Absolute amount as an exact two-decimal number; NULL counts as 0.

    NULL where the number has more digits than MONEY holds.
    """
    return F.abs(F.coalesce(c, F.lit(0.0))).try_cast(MONEY)


def money_text(c: Column) -> Column:
    """`money` as text for keys; a number too large for it keeps its own text."""
    return F.coalesce(money(c).cast("string"), F.abs(c).cast("string"))
