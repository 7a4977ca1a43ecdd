"""Values of any column type to the type the ledger stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monedero.functions import truthy_stored
from monedero.schema import FLAG_COLUMNS, LEDGER_TYPES


def ledger_value(df: DataFrame, name: str) -> Column:
    """Column `name` of `df` as stored: flag words become booleans, what cannot be read NULL."""
    if name not in df.columns:
        return F.lit(None).cast(LEDGER_TYPES[name]).alias(name)
    given, wanted = df.schema[name].dataType, LEDGER_TYPES[name]
    column = F.col(name)
    if given == wanted:
        return column
    if name in FLAG_COLUMNS and not isinstance(given, T.NullType):
        return truthy_stored(column).alias(name)
    return column.try_cast(wanted).alias(name)
