"""Deterministic row keys. Amount text is the exact two-decimal number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from monedero.functions.amounts import money_text
from monedero.schema import MONEY


def _iso(fecha: Column) -> Column:
    return F.coalesce(F.date_format(fecha, "yyyy-MM-dd"), F.lit("NaT"))


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 16)


def cli_id(fecha: Column, norm: Column, monto: Column) -> Column:
    """Id of a standardised row: date, `norm_cli` text and signed amount."""
    amount = F.coalesce(monto.try_cast(MONEY).cast("string"), monto.cast("string"), F.lit("nan"))
    return _short(F.sha1(F.concat_ws("|", _iso(fecha), norm, amount)))


def ledger_key(
    fecha: Column, norm: Column, monto_abs: Column, fecha_text: Column | None = None
) -> Column:
    """Key of an uploaded row: date, `norm_db` text and absolute amount.

    A row without a readable date keeps `fecha_text` in its key where given.
    """
    day = F.date_format(fecha, "yyyy-MM-dd")
    if fecha_text is not None:
        day = F.coalesce(day, F.trim(fecha_text))
    day = F.coalesce(day, F.lit("NaT"))
    raw = F.concat_ws("|", day, norm, money_text(monto_abs))
    return F.concat(F.lit("k:"), _short(F.sha2(raw, 256)))


def manual_key(fecha: Column, monto: Column, norm: Column) -> Column:
    """Key of a manual entry: date, absolute amount, `norm_alnum` text."""
    raw = F.concat_ws("|", _iso(fecha), money_text(monto), norm)
    return F.concat(F.lit("m:"), _short(F.sha1(raw)))
