"""The three text normal forms of a movement's description.

Accents are folded with one `translate` whose table is derived from the
Unicode database, so the whole form stays inside generated code. Characters
whose decomposition is longer than one character (Hangul syllables, ligatures)
are left as they are.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"[\x{09}-\x{0d}\x{1c}-\x{20}]+"


@lru_cache(maxsize=None)
def _folding(form: str) -> tuple[str, str]:
    """`translate` arguments: decompose to `form`, drop marks, blank out Unicode spaces."""

    def is_mark(ch: str) -> bool:
        return unicodedata.category(ch) == "Mn" if form == "NFD" else unicodedata.combining(ch) > 0

    kept, replaced, dropped = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        if ch.isspace():
            kept.append(ch)
            replaced.append(" ")
            continue
        base = "".join(c for c in unicodedata.normalize(form, ch) if not is_mark(c))
        if not base:
            dropped.append(ch)
        elif base != ch and len(base) == 1:
            kept.append(ch)
            replaced.append(base)
    return "".join(kept + dropped), "".join(replaced)


def _fold(c: Column, form: str) -> Column:
    return F.translate(c, *_folding(form))


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _BLANKS, " "))


def norm_db(c: Column) -> Column:
    """Lower case, no accents, single blanks; punctuation kept. NULL gives ''."""
    return F.coalesce(_squeeze(_fold(F.lower(c), "NFD")), F.lit(""))


def norm_cli(c: Column) -> Column:
    """Upper case, no accents, single blanks; punctuation kept. NULL gives ''."""
    return F.coalesce(F.upper(_squeeze(_fold(c, "NFD"))), F.lit(""))


def norm_alnum(c: Column) -> Column:
    """Upper case letters and digits, everything else one blank. NULL gives ''."""
    words = F.regexp_replace(_fold(c, "NFKD"), r"[^\p{L}\p{N}]+", " ")
    return F.coalesce(F.upper(F.trim(words)), F.lit(""))


def blank(c: Column) -> Column:
    """True for NULL and for text that is empty once trimmed."""
    return F.coalesce(F.trim(c) == "", F.lit(True))
