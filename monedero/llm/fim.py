"""Fill-in-the-middle: cut each text in three at unit boundaries and reorder the parts.

A unit is a run of ASCII letters or any other single character. Cuts are drawn in
units, are wanted in code points, and are made in bytes. Each conversion goes
through a sparse index of exceptions: of the characters only those of several bytes
are recorded (position, excess bytes), and of the units only the letter runs
(position, excess characters). Between exceptions positions advance by one, so a
binary search and one addition convert a cut, and plain ASCII needs no index at all.

Only the cuts are computed in Python. The texts are cut, joined and restored by
Spark's own expressions, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monedero.llm.common import tune

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentage of texts that are reordered, and of those, of suffix-first ones.
FIM_PERCENT, SPM_PERCENT = 90, 20


class Exceptions:
    """Converts cuts between a coarse and a fine count of one sequence.

    `at` holds the coarse positions, ascending, of the items that take more than
    one fine step, `excess` how many more.
    """

    def __init__(self, at: np.ndarray, excess: np.ndarray):
        self.coarse_at = at
        self.sums = np.concatenate([[0], np.cumsum(excess)])
        self.fine_at = at + self.sums[:-1]

    def fine(self, cut):
        return cut + self.sums[np.searchsorted(self.coarse_at, cut)]

    def coarse(self, cut):
        return cut - self.sums[np.searchsorted(self.fine_at, cut)]


def characters(raw: np.ndarray) -> Exceptions:
    """Index of UTF-8 bytes by code points; a byte that belongs to no sequence counts as one."""
    lead = np.flatnonzero(raw >= 0xC0)
    first = raw[lead]
    follows = np.concatenate([(raw & 0xC0) == 0x80, [False] * 3])
    one = follows[lead + 1]
    two = one & (first >= 0xE0) & follows[lead + 2]
    three = two & (first >= 0xF0) & follows[lead + 3]
    excess = one.astype(np.int64) + two + three
    lead, excess = lead[one], excess[one]
    return Exceptions(lead - (np.cumsum(excess) - excess), excess)


def units(raw: np.ndarray, chars: Exceptions) -> Exceptions:
    """Index of code points by units: the letter runs of more than one letter."""
    low = raw | 0x20
    letter = np.concatenate([[False], (low >= 97) & (low <= 122), [False]])
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    starts, excess = edges[::2], edges[1::2] - edges[::2] - 1
    starts, excess = chars.coarse(starts[excess > 0]), excess[excess > 0]
    return Exceptions(starts - (np.cumsum(excess) - excess), excess)


def cuts(raw: np.ndarray, h1: int, h2: int) -> tuple[int, int, int, int, int]:
    """(units, code point cuts, byte cuts) of one text and two draws."""
    chars = characters(raw)
    runs = units(raw, chars)
    total = int(chars.coarse(len(raw)))
    n = int(runs.coarse(total))
    where = np.sort(np.array([h1 % (n + 1), h2 % (n + 1)]))
    points = runs.fine(where)
    at = chars.fine(points)
    return n, *points.tolist(), *at.tolist()


_CUTS = pa.struct([(c, pa.int64()) for c in ("n", "char1", "char2", "byte1", "byte2")])


def _cuts_of(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    rows = [
        cuts(np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid else np.zeros(0, np.uint8), a, b)
        for t, a, b in zip(text, h1.to_pylist(), h2.to_pylist(), strict=True)
    ]
    columns = np.array(rows, np.int64).reshape(-1, len(_CUTS))
    return pa.StructArray.from_arrays([pa.array(c) for c in columns.T], fields=list(_CUTS))


def draws(key: str, seed: int) -> list[Column]:
    """Four 32-bit draws of a row: the first hex groups of sha256("seed:key")."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    columns=("doc_id",),
    seed: int = 1,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """The given columns of every row with n, form, prefix_chars, middle_chars and `output`.

    `form` is `psm` (prefix, suffix, middle), `spm` (suffix, prefix, middle) or
    `plain`: texts drawn to stay, empty ones and those that hold a mark themselves,
    so that every output can be restored. A null text counts as empty. The draw
    depends on the key alone: rows with equal keys get equal draws, a null key
    draws as an empty one. Malformed UTF-8 is cut between bytes and not altered.
    """
    tune(docs.sparkSession)
    find = F.arrow_udf(_cuts_of, "n long, char1 long, char2 long, byte1 long, byte2 long")
    kept = [F.col(c) for c in columns]
    whole = F.coalesce(F.col(text), F.lit("")).alias("_t")
    rows = docs.select(*[c.alias(f"_c{i}") for i, c in enumerate(kept)], whole, F.array(*draws(key, seed)).alias("_h"))
    t, h = F.col("_t"), F.col("_h")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(t, F.lit(mark))
    plain = (t == "") | marked | (h[2] % 100 >= fim_percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("*", form.alias("form"), find(t.cast("binary"), h[0], h[1]).alias("_at"))

    raw, at = t.cast("binary"), F.col("_at")
    prefix = F.substring(raw, F.lit(1), at["byte1"].cast("int"))
    middle = F.substring(raw, (at["byte1"] + 1).cast("int"), (at["byte2"] - at["byte1"]).cast("int"))
    suffix = F.substring(raw, (at["byte2"] + 1).cast("int"), F.octet_length(raw))
    p, s, m = (F.lit(x).cast("binary") for x in (PREFIX, SUFFIX, MIDDLE))
    output = (
        F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(raw)
    )
    moved = F.col("form") != "plain"
    return rows.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)],
        at["n"].alias("n"),
        "form",
        F.when(moved, at["char1"]).alias("prefix_chars"),
        F.when(moved, at["char2"] - at["char1"]).alias("middle_chars"),
        output.cast("string").alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The exact text of an output: no part holds a mark, so each mark stands once."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring_index(output, first, -1)
        rest = F.substring_index(body, second, -1)
        return (
            F.substring_index(body, second, 1),
            F.substring_index(rest, MIDDLE, 1),
            F.substring_index(rest, MIDDLE, -1),
        )

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    late_suffix, late_prefix, late_middle = parts(SUFFIX, PREFIX)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(late_prefix, late_middle, late_suffix))
        .otherwise(output)
    )


def oracle_sql() -> str:
    """The registered query for DuckDB, by lists of units."""

    def draw(i: int) -> str:
        return f"CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)"

    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
),
c AS (
  SELECT *, len(u) AS n, least({draw(0)} % (len(u) + 1), {draw(1)} % (len(u) + 1)) AS a,
    greatest({draw(0)} % (len(u) + 1), {draw(1)} % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
      OR {draw(2)} % 100 >= {FIM_PERCENT} THEN 'plain' WHEN {draw(3)} % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM t
),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
    array_to_string(u[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
