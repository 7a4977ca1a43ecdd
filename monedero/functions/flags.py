"""Boolean flags and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
_YES = ("1", "true", "t", "yes", "y", "si", "sí")
_YES_STORED = _YES + ("s", "verdadero")
_TRANSFER = r"\bTRASPAS|\bTRANSFER|\bABONO\b|\bREEMB|\bREVERSA|\bCASHBACK|\bPAGO T|\bPAGO TARJ"
_SHARED = r"\bDIVIDID|\bCOMPARTID|\bAMIGOS\b"
# ----------------------------------------------------------------------------


def truthy(c: Column) -> Column:
    """Upload flag: a short list of words means true, anything else false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*_YES), F.lit(False))


def truthy_stored(c: Column) -> Column:
    """Stored flag: NULL stays NULL, any whole number but 0 is true, two more words count."""
    text = F.lower(F.trim(c.cast("string")))
    whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.rlike("[1-9]"))
    return F.coalesce(whole, text.isin(*_YES_STORED))


def flag_transfer(norm: Column) -> Column:
    """Transfer or credit, read from `norm_cli` text."""
    return F.coalesce(norm.rlike(_TRANSFER), F.lit(False))


def flag_shared(norm: Column) -> Column:
    """Possibly shared with others, read from `norm_cli` text."""
    return F.coalesce(norm.rlike(_SHARED), F.lit(False))


def my_share(monto: Column, shared: Column) -> tuple[Column, Column]:
    """(my fraction, my amount): half of a shared expense; credits carry no amount of mine."""
    fraction = F.when(shared, 0.5).otherwise(1.0)
    return fraction, F.when(monto < 0, monto * fraction).otherwise(0.0)
