"""Column expressions: text normal forms, amounts, dates, keys and flags."""

from monedero.functions.amounts import amount_app, amount_cli, amount_sep, money
from monedero.functions.dates import date_app, date_cli, month_of
from monedero.functions.flags import flag_shared, flag_transfer, my_share, truthy, truthy_stored
from monedero.functions.keys import cli_id, ledger_key, manual_key
from monedero.functions.text import norm_alnum, norm_cli, norm_db

__all__ = [
    "amount_app",
    "amount_cli",
    "amount_sep",
    "cli_id",
    "date_app",
    "date_cli",
    "flag_shared",
    "flag_transfer",
    "ledger_key",
    "manual_key",
    "money",
    "month_of",
    "my_share",
    "norm_alnum",
    "norm_cli",
    "norm_db",
    "truthy",
    "truthy_stored",
]
