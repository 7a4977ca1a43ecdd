"""Bank-statement files of unknown encoding, delimiter, header row and columns.

Files are read as lines in the blocks Spark cuts them into, whatever their size, and
quoted line breaks are carried across the blocks. What has to be known per file
(delimiter, header, column roles) is worked out from its first records into one small
row per file and joined back to its records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from monedero.functions import (
    amount_app,
    amount_cli,
    cli_id,
    date_app,
    date_cli,
    flag_shared,
    flag_transfer,
    money,
    my_share,
    norm_alnum,
    norm_cli,
)
from monedero.session import stage

# --- fixed values -----------------------------------------------------------
DELIMITERS = (";", ",", "\t", "|")
HEADER_KEYWORDS = (
    "fecha",
    "detalle",
    "glosa",
    "comercio",
    "descripcion",
    "monto",
    "cargo",
    "abono",
    "debe",
    "haber",
    "saldo",
    "movim",
)
DELIMITER_LINES = 40
HEADER_LINES = 200
# Column name patterns of the raw-statement roles, first matching column wins.
ROLE_PATTERNS = {
    "fecha": r"(?i)fech",
    "detalle": r"(?i)(detalle|glosa|descri|concepto|comercio|nombre|movim)",
    "abono": r"(?i)(abono|haber|credito)",
    "cargo": r"(?i)(cargo|debe|debito)",
    "monto": r"(?i)(monto|importe|saldo)",
}
# Upload aliases, in order of preference, used where the target itself is absent.
ALIASES = {
    "fecha": ("fecha movimiento", "date", "fecha_mov"),
    "detalle": ("glosa", "descripcion", "concepto", "comercio"),
    "monto": ("cargo", "debe", "debito", "importe"),
    "fraccion_mia_sugerida": ("fraccion_mia",),
    "monto_mio_estimado": ("monto_mio",),
}
# Last resort of the upload: the first column whose name contains one of these.
PARTS = {
    "detalle": ("detalle", "glosa", "descripcion", "concepto"),
    "monto": ("monto", "importe", "cargo", "abono"),
}
# ----------------------------------------------------------------------------
_DATE_LIKE = r"[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}"
_CP1252 = bytes(range(0x80, 0xA0)).decode("latin-1")
_CP1252_TEXT = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")


# A quoted cell starts right after a separator; any other quote is plain text.
_CELL_START = r"(?<![^;,\t|])"
_INSIDE = r'(?:[^"]++|"")*+'
_QUOTED = rf'"{_INSIDE}"'
# Ends in a quoted cell that is still open, seen from outside of one.
_OPENS = rf'(?:[^"]++|{_CELL_START}{_QUOTED}|(?<=[^;,\t|])")*+{_CELL_START}"{_INSIDE}\z'


def decode_text(value: Column, is_utf8: Column) -> Column:
    """Bytes of a file to text: UTF-8, else Windows-1252; a leading byte-order mark is dropped."""
    return F.regexp_replace(_decoded(value, is_utf8), "^\ufeff", "")


def _decoded(value: Column, is_utf8: Column) -> Column:
    western = F.translate(
        F.decode(value.cast("binary"), "ISO-8859-1"), _CP1252, _CP1252_TEXT
    )
    return F.when(is_utf8, value).otherwise(western)


def _text(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    return spark.read.text(path if isinstance(path, str) else list(path), **options)


def _ends_open(line: Column) -> Column:
    """Whether a quoted cell is open at the end of a line that starts a record."""
    return line.rlike("^" + _OPENS)


def _opens_again(line: Column) -> Column:
    """Whether a line that starts inside a quoted cell closes it and ends in another one."""
    return line.rlike(f'^{_INSIDE}"' + _OPENS)


def _stays_open(line: Column) -> Column:
    """Whether a quoted cell is open at the end of a line that starts inside of one."""
    return line.rlike(rf"^{_INSIDE}\z") | _opens_again(line)


def _open_after(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds `from_out` and `from_in`: whether a quoted cell is open after each row.

    A row turns the state it meets into `if_out` or `if_in`. It either fixes the
    state, flips it or lets it be, so the state after any row is what the last
    fixing row left, flipped as often as rows flip it since: two running values.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.col("if_out") == F.col("if_in")
    flips = F.sum((F.col("if_out") & ~F.col("if_in")).cast("bigint")).over(w)
    df = df.withColumn("_flips", flips).withColumns(
        {
            "_left": F.last(F.when(fixed, F.col("if_out")), ignorenulls=True).over(w),
            "_then": F.last(F.when(fixed, F.col("_flips")), ignorenulls=True).over(w),
        }
    )
    odd = (F.col("_flips") - F.coalesce("_then", F.lit(0))) % 2 == 1
    return df.withColumns(
        {
            "from_out": F.coalesce("_left", F.lit(False)) != odd,
            "from_in": F.coalesce("_left", F.lit(True)) != odd,
        }
    ).drop("_flips", "_left", "_then")


def _block_effects(raw: DataFrame) -> DataFrame:
    """What the lines of each block do to an open quoted cell, one row per block with a line that
    opens or closes one.

    `out_lines` and `in_lines` count the lines up to the last effective one that start
    inside a quoted cell, for a block that starts outside and inside of one.
    """
    block = ["source_file", "block"]
    lines = (
        raw.filter(F.contains("value", F.lit('"')))
        .select(
            *block,
            "seq",
            _ends_open(F.col("value")).alias("if_out"),
            _stays_open(F.col("value")).alias("if_in"),
            _opens_again(F.col("value")).alias("again"),
        )
        .filter("if_out or not if_in or again")
    )
    reach = F.lead("seq").over(Window.partitionBy(*block).orderBy("seq")) - F.col("seq")
    return (
        _open_after(lines, block, "seq")
        .withColumn("reach", reach)
        .groupBy(*block)
        .agg(
            F.min("seq").alias("first_effect"),
            F.max("seq").alias("last_effect"),
            F.max_by("from_out", "seq").alias("if_out"),
            F.max_by("from_in", "seq").alias("if_in"),
            F.sum(F.when(F.col("from_out"), F.col("reach"))).alias("out_lines"),
            F.sum(F.when(F.col("from_in"), F.col("reach"))).alias("in_lines"),
        )
    )


def _blocks(raw: DataFrame) -> DataFrame:
    """One row per block of a file: where it stands in the file's records, and the file's encoding.

    `base` is the number of records that start in earlier blocks, `open` tells whether
    the block starts inside a quoted cell, `joined` whether it holds part of a record
    of several lines. A quoted cell that never closes is plain text: after the line
    `cut`, which opens it, every line is a record.
    """
    key = ["source_file", "block"]
    sizes = raw.groupBy(*key).agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.bool_and(F.is_valid_utf8("value")).alias("ok")
    )
    blocks = sizes.join(_block_effects(raw), key, "left").withColumns(
        {"if_out": F.coalesce("if_out", F.lit(False)), "if_in": F.coalesce("if_in", F.lit(True))}
    )
    file = Window.partitionBy("source_file")
    ahead = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = _open_after(blocks, ["source_file"], "block").withColumns(
        {
            "open": F.coalesce(F.lag("from_out").over(file.orderBy("block")), F.lit(False)),
            "never_closed": F.max_by("from_out", "block").over(file),
            "opener": F.max(F.when(F.col("last_effect").isNotNull(), F.col("block"))).over(file),
            "utf8": F.bool_and("ok").over(file),
        }
    )
    unclosed = F.col("never_closed") & (F.col("block") >= F.col("opener"))
    blocks = blocks.withColumns(
        {
            "open": F.col("open") & ~(F.col("never_closed") & (F.col("block") > F.col("opener"))),
            "after": F.col("from_out") & ~unclosed,
            "cut": F.when(unclosed, F.col("last_effect")),
        }
    )
    lines = F.col("last") - F.col("first") + 1
    until = F.coalesce(F.col("first_effect") - F.col("first") + 1, lines)
    tail = F.when(F.col("after"), F.col("last") - F.col("last_effect"))
    inner = F.when(F.col("open"), until + F.coalesce("in_lines", F.lit(0))).otherwise(F.coalesce("out_lines", F.lit(0)))
    return (
        blocks.withColumn("inner", inner + F.coalesce(tail, F.lit(0)))
        .withColumns(
            {
                "base": F.coalesce(F.sum(lines - F.col("inner")).over(ahead), F.lit(0)),
                "joined": (F.col("inner") > 0) | F.col("after"),
            }
        )
        .select(*key, "first", "utf8", "base", "open", "cut", "joined")
    )


def _joined_records(lines: DataFrame) -> DataFrame:
    """Records of the blocks that hold records of several lines."""
    block = ["source_file", "block"]
    w = Window.partitionBy(*block).orderBy("seq")
    effects = lines.withColumns({"if_out": _ends_open(F.col("value")), "if_in": _stays_open(F.col("value"))})
    after = F.when(F.col("open"), F.col("from_in")).otherwise(F.col("from_out"))
    inside = F.coalesce(F.lag("after").over(w), F.col("open")) & (
        F.col("cut").isNull() | (F.col("seq") <= F.col("cut"))
    )
    numbered = (
        _open_after(effects, block, "seq")
        .withColumn("after", after)
        .withColumn("inside", inside.cast("bigint"))
        .withColumn("line_no", F.col("line_no") - F.sum("inside").over(w))
    )
    parts = F.array_sort(F.collect_list(F.struct("block", "seq", "line")))
    return (
        numbered.groupBy("source_file", "line_no")
        .agg(parts.alias("parts"))
        .select("source_file", "line_no", F.array_join(F.col("parts")["line"], "\n").alias("line"))
    )


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(source_file, line_no, line) of the records of all files, decoded file by file.

    A record is a line, or several where a quoted cell holds line breaks; `line_no`
    counts the records of a file from 0. Spark may split files into blocks anywhere:
    what a block's quotes do is worked out per block and carried along the blocks, so
    records and numbers are the same for any block size. Only blocks with records of
    several lines are shuffled.
    """
    raw = _text(spark, path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )
    # Written, so that the planner knows its size and need not shuffle the lines.
    known = stage(_blocks(raw))
    lines = raw.join(known, ["source_file", "block"])
    line_no = F.col("base") + F.col("seq") - F.col("first")
    how = F.col("value"), F.col("utf8")
    # Only the start of a file can hold a byte-order mark.
    line = F.when(line_no == 0, decode_text(*how)).otherwise(_decoded(*how))
    lines = lines.withColumns({"line_no": line_no, "line": line})
    single = lines.filter(~F.col("joined")).select("source_file", "line_no", "line")
    return single.unionByName(_joined_records(lines.filter("joined")))


def sniff_delimiter(lines: DataFrame) -> DataFrame:
    """(source_file, delim): the most frequent candidate in the first lines of each file."""
    head = F.col("line_no") < DELIMITER_LINES
    line = F.col("line")

    def seen(d: str) -> Column:
        n = F.length(line) - F.length(F.replace(line, F.lit(d)))
        return F.coalesce(F.sum(F.when(head, n)), F.lit(0))

    # Most frequent first; equal counts keep the order of the candidates.
    ranked = F.array_sort(
        F.array(
            *[
                F.struct((-seen(d)).alias("neg"), F.lit(i).alias("pos"), F.lit(d).alias("d"))
                for i, d in enumerate(DELIMITERS)
            ]
        )
    )
    return lines.groupBy("source_file").agg(F.get(ranked, F.lit(0))["d"].alias("delim"))


def _split(line: Column, delim: Column) -> Column:
    """Plain split at the file's delimiter."""
    return F.split(line, F.concat(F.lit("\\"), delim), -1)


def _parse(line: Column, delim: Column) -> Column:
    """Cells of a line; a quoted cell may hold the delimiter, and "" stands for a quote."""
    # Every cell starts with a delimiter, the first one with an added one.
    cell = F.concat(
        F.lit("["), delim, F.lit('](([^"'), delim, F.lit("]++|(?<![^"), delim,
        F.lit(f']){_QUOTED}|")*+)'),
    )
    quoted = F.regexp_extract_all(F.concat(delim, line), cell, F.lit(1))
    bare = F.transform(
        quoted,
        lambda c: F.replace(F.regexp_replace(c, r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"')),
    )
    return F.when(F.contains(line, F.lit('"')), bare).otherwise(_split(line, delim))


def find_header(lines: DataFrame, delims: DataFrame) -> DataFrame:
    """(source_file, header_line): the first line that looks like column names, else line 0."""
    cells = F.transform(
        _split(F.col("line"), F.col("delim")),
        lambda c: F.lower(F.regexp_replace(c, r"[^A-Za-zÁÉÍÓÚÑáéíóúñ0-9 ]", "")),
    )
    hits = F.size(
        F.filter(
            cells,
            lambda c: F.exists(
                F.array(*[F.lit(k) for k in HEADER_KEYWORDS]), lambda k: F.contains(c, k)
            ),
        )
    )
    looks = (hits >= 2) & (F.size(cells) >= 3)
    return (
        lines.filter(F.col("line_no") < HEADER_LINES)
        .join(delims, "source_file")
        .groupBy("source_file")
        .agg(F.coalesce(F.min(F.when(looks, F.col("line_no"))), F.lit(0)).alias("header_line"))
    )


def file_layouts(lines: DataFrame, search_header: bool = True) -> DataFrame:
    """(source_file, delim, header_line, header) of each file.

    Without the search the first line is the header.
    """
    # A few lines per file, read by several steps: written once.
    head = stage(lines.filter(F.col("line_no") < HEADER_LINES))
    delims = sniff_delimiter(head)
    if search_header:
        heads = find_header(head, delims)
    else:
        heads = delims.select("source_file", F.lit(0).cast("bigint").alias("header_line"))
    header = F.transform(_parse(F.col("line"), F.col("delim")), lambda c: F.trim(c))
    # Written, so that the planner knows its size when it joins it to the lines.
    return stage(
        heads.join(delims, "source_file")
        .join(
            head.select("source_file", F.col("line_no").alias("header_line"), "line"),
            ["source_file", "header_line"],
        )
        .select(
            "source_file",
            "delim",
            "header_line",
            F.filter(header, lambda c: c.isNotNull()).alias("header"),
        )
    )


def _rows_of_any_width(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """The lines below each header that are not blank, with their layout and `cells`."""
    width = F.size("header")
    cells = F.filter(
        F.transform(
            _parse(F.col("line"), F.col("delim")), lambda c, i: F.struct(i.alias("i"), c.alias("c"))
        ),
        lambda s: (s["i"] < width) | s["c"].isNotNull(),
    )
    return (
        lines.join(layouts, "source_file")
        .filter((F.col("line_no") > F.col("header_line")) & (F.trim("line") != ""))
        .withColumn("cells", F.transform(cells, lambda s: F.nullif(s["c"], F.lit(""))))
    )


def statement_rows(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """(source_file, line_no, header, cells, …) of the lines below each header.

    Blank lines are left out, and so are lines with more cells than the header.
    """
    rows = _rows_of_any_width(lines, layouts).filter(F.size("cells") <= F.size("header"))
    return rows.drop("line", "delim", "header_line")


def _first_match(header: Column, test) -> Column:
    """1-based place of the first header cell that passes, 0 for none."""
    return F.array_position(F.transform(header, test), F.lit(True))


def column_roles(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """Layouts plus the 1-based column of each role, 0 where the file has none.

    Names decide. A file without a date name takes its first column holding a
    date-like value, one without a description name its column with the longest
    mean text; only such files are looked into.
    """

    def named_like(pattern: str) -> Column:
        return _first_match(
            F.col("header"), lambda h: F.coalesce(h.rlike(pattern), F.lit(False))
        ).cast("int")

    named = layouts.withColumns({r: named_like(p) for r, p in ROLE_PATTERNS.items()})
    unsure = named.filter((F.col("fecha") == 0) | (F.col("detalle") == 0))
    if unsure.isEmpty():
        return named
    cells = (
        statement_rows(lines, unsure.select("source_file", "delim", "header_line", "header"))
        .select("source_file", "header", F.posexplode("cells").alias("pos", "cell"))
        .filter(F.coalesce(F.get("header", F.col("pos")), F.lit("")) != "")
    )
    columns = cells.groupBy("source_file", "pos").agg(
        F.coalesce(F.bool_or(F.col("cell").rlike(_DATE_LIKE)), F.lit(False)).alias("dated"),
        # An empty cell counts three characters.
        F.avg(F.coalesce(F.length("cell"), F.lit(3))).alias("mean_len"),
    )
    guesses = columns.groupBy("source_file").agg(
        F.min(F.when(F.col("dated"), F.col("pos") + 1)).alias("_fecha"),
        (F.min(F.struct(-F.col("mean_len"), "pos"))["pos"] + 1).alias("_detalle"),
    )

    def role(name: str) -> Column:
        guess = F.coalesce(f"_{name}", F.lit(0))
        return F.when(F.col(name) > 0, F.col(name)).otherwise(guess).alias(name)

    return named.join(guesses, "source_file", "left").select(
        "source_file",
        "delim",
        "header_line",
        "header",
        role("fecha"),
        role("detalle"),
        "abono",
        "cargo",
        "monto",
    )


def _cell(place: Column) -> Column:
    return F.when(place > 0, F.get("cells", place - 1))


def signed_amount(credit: Column, debit: Column, amount: Column, has_sides: Column) -> Column:
    """Inflow minus outflow where the file has such columns, else its amount column."""
    sides = F.coalesce(credit, F.lit(0.0)) - F.coalesce(debit, F.lit(0.0))
    return F.when(has_sides, sides).otherwise(amount)


def standardize_lines(lines: DataFrame) -> DataFrame:
    """Raw statement lines to the standardised table, one row per movement."""
    layouts = file_layouts(lines)
    rows = statement_rows(lines, column_roles(lines, layouts))
    credit = amount_cli(_cell(F.col("abono")))
    debit = amount_cli(_cell(F.col("cargo")))
    amount = amount_cli(_cell(F.col("monto")))
    has_sides = (F.col("abono") > 0) | (F.col("cargo") > 0)
    parsed = rows.select(
        "source_file",
        "line_no",
        date_cli(_cell(F.col("fecha"))).alias("fecha"),
        _cell(F.col("detalle")).alias("detalle"),
        F.round(signed_amount(credit, debit, amount, has_sides), 6).alias("monto"),
    )
    return standardize(parsed)


def standardize(raw: DataFrame) -> DataFrame:
    """Parsed rows (fecha, detalle, monto) to the standardised columns, flags, share and id."""
    flagged = raw.withColumn("detalle_norm", norm_cli(F.col("detalle"))).withColumns(
        {
            "es_transferencia_o_abono": flag_transfer(F.col("detalle_norm")),
            "es_compartido_posible": flag_shared(F.col("detalle_norm")),
        }
    )
    fraction, mine = my_share(F.col("monto"), F.col("es_compartido_posible"))
    place = [c for c in ("source_file", "line_no") if c in raw.columns]
    return flagged.select(
        cli_id(F.col("fecha"), F.col("detalle_norm"), F.col("monto")).alias("id"),
        "fecha",
        "detalle",
        "monto",
        "es_transferencia_o_abono",
        "es_compartido_posible",
        F.lit(None).cast("string").alias("categoria"),
        fraction.alias("fraccion_mia"),
        mine.alias("monto_mio"),
        "detalle_norm",
        *place,
    )


def read_standardized(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Raw statement files to the standardised table."""
    return standardize_lines(read_lines(spark, path))


def upload_columns(layouts: DataFrame) -> DataFrame:
    """Upload layouts plus `place`: 1-based column of each ledger field the file offers."""
    header = F.col("lower")

    def at(name: str) -> Column:
        return F.array_position(header, F.lit(name))

    def place(target: str) -> Column:
        tries = [at(target), *[at(a) for a in ALIASES.get(target, ())]]
        if target in PARTS:
            parts = PARTS[target]

            def holds(h):
                hit = F.lit(False)
                for p in parts:
                    hit = hit | F.contains(h, F.lit(p))
                return F.coalesce(hit, F.lit(False))

            tries.append(_first_match(header, holds))
        found = F.lit(None)
        for t in reversed(tries):
            found = F.when(t > 0, t).otherwise(found)
        return found.cast("int")

    lower = F.transform("header", lambda h: F.lower(F.trim(h)))
    return layouts.withColumn("lower", lower).withColumn(
        "place", F.struct(*[place(c).alias(c) for c in UPLOAD_FIELDS])
    ).drop("lower")


UPLOAD_FIELDS = (
    "id",
    "fecha",
    "detalle",
    "monto",
    "es_compartido_posible",
    "fraccion_mia_sugerida",
    "monto_mio_estimado",
    "categoria_sugerida",
    "detalle_norm",
    "monto_real",
    "categoria",
    "nota_usuario",
)
REQUIRED_FIELDS = ("fecha", "detalle", "monto")


def upload_rows(lines: DataFrame, date_format: str = "YYYY-MM-DD") -> DataFrame:
    """Statement lines with names in the first line to raw upload rows.

    Files without a date, description or amount column give no rows; see
    `rejected_files`.
    """
    return _upload_rows(lines, _upload_layouts(lines), date_format)


def _upload_layouts(lines: DataFrame) -> DataFrame:
    return upload_columns(file_layouts(lines, search_header=False))


def _upload_rows(lines: DataFrame, layouts: DataFrame, date_format: str) -> DataFrame:
    rows = statement_rows(lines, layouts.filter(_complete()))

    def text(field: str) -> Column:
        return F.get("cells", F.col("place")[field] - 1)

    norm = F.when(F.col("place")["detalle_norm"].isNull(), norm_alnum(text("detalle"))).otherwise(
        F.coalesce(text("detalle_norm"), F.lit(""))
    )
    parsed = {
        "fecha": date_app(text("fecha"), date_format),
        "detalle_norm": norm,
        "id": F.coalesce(text("id"), F.col("line_no").cast("string")),
        "detalle": F.coalesce(text("detalle"), F.lit("")),
    }
    # A column the file has holds text in every row.
    for c in ("categoria", "nota_usuario"):
        empty = F.when(F.col("place")[c].isNotNull(), F.lit(""))
        parsed[c] = F.coalesce(text(c), empty)
    amounts = ("monto", "fraccion_mia_sugerida", "monto_mio_estimado", "monto_real")
    parsed |= {c: amount_app(text(c)) for c in amounts}
    return rows.select(
        "source_file", "line_no", *[parsed.get(c, text(c)).alias(c) for c in UPLOAD_FIELDS]
    )


def _complete() -> Column:
    ok = F.lit(True)
    for c in REQUIRED_FIELDS:
        ok = ok & F.col("place")[c].isNotNull()
    return ok


def _missing() -> Column:
    names = [F.when(F.col("place")[c].isNull(), F.lit(c)) for c in sorted(REQUIRED_FIELDS)]
    return F.filter(F.array(*names), lambda c: c.isNotNull())


def rejected_files(lines: DataFrame) -> DataFrame:
    """(source_file, missing): upload files that lack a required column."""
    layouts = _upload_layouts(lines)
    return layouts.filter(~_complete()).select("source_file", _missing().alias("missing"))


def _rejected_rows(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    files = layouts.filter(~_complete()).select(
        "source_file",
        F.lit(None).cast("bigint").alias("line_no"),
        F.concat(F.lit("missing: "), F.array_join(_missing(), ", ")).alias("reason"),
        F.lit(None).cast("string").alias("line"),
    )
    amount = amount_app(F.get("cells", F.col("place")["monto"] - 1))
    reason = F.when(F.size("cells") > F.size("header"), "too many cells").when(
        amount.isNotNull() & money(amount).isNull(), "amount too large"
    )
    rows = _rows_of_any_width(lines, layouts.filter(_complete())).withColumn("reason", reason)
    return files.unionByName(
        rows.filter(F.col("reason").isNotNull()).select("source_file", "line_no", "reason", "line")
    )


def rejected_rows(lines: DataFrame) -> DataFrame:
    """(source_file, line_no, reason, line) of upload input that does not count.

    A file without a required column is one row without line; a line with more cells
    than the header gives no movement; a line whose amount exceeds the exact type
    gives one that counts in no exact sum.
    """
    return _rejected_rows(lines, _upload_layouts(lines))


def read_upload(lines: DataFrame, date_format: str = "YYYY-MM-DD") -> tuple[DataFrame, DataFrame]:
    """(raw upload rows, rejected input) of statement lines, with one look at the layouts."""
    layouts = _upload_layouts(lines)
    return _upload_rows(lines, layouts, date_format), _rejected_rows(lines, layouts)


def read_statements(
    spark: SparkSession, path: str | Sequence[str], date_format: str = "YYYY-MM-DD"
) -> DataFrame:
    """Upload files to raw rows for `ingest`."""
    return upload_rows(read_lines(spark, path), date_format)
