"""Category rules: merchant substrings, learned exact names, own accounts, renames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monedero.functions import norm_db
from monedero.functions.text import blank
from monedero.schema import UNCATEGORISED

# Up to this many merchant rules travel with the plan as one array; beyond it
# the texts meet the rules by an equi-join on substrings.
INLINE_RULES = 500


def rule_order() -> Column:
    """Comparable rule position; rules without a teaching date come last in their `ord`."""
    return F.struct("ord", F.col("since").isNull().alias("undated"), "since", "since_id")


def _distinct_rules(rules: DataFrame) -> DataFrame:
    """(key, categoria, pos): the first rule of each key."""
    return (
        rules.filter(F.col("key") != "")
        .groupBy("key")
        .agg(
            F.min_by("categoria", rule_order()).alias("categoria"),
            F.min(rule_order()).alias("pos"),
        )
    )


def _match_inline(df: DataFrame, rules: DataFrame) -> DataFrame:
    entries = rules.agg(
        F.array_sort(F.collect_list(F.struct("pos", "key", "categoria"))).alias("r")
    ).select("r").scalar()
    hit = F.filter(F.col("_rules"), lambda r: F.contains(F.col("detalle_norm"), r["key"]))
    return (
        df.withColumn("_rules", entries)
        .withColumn("_rule", F.get(hit, F.lit(0))["categoria"])
        .drop("_rules")
    )


def _match_by_substring(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Equi-join form for many rules: each distinct text meets only the rules it holds.

    A distinct text is cut into its substrings of the lengths that occur among
    the keys, so the rows made grow with the text, never with texts times rules.
    """
    lengths = rules.select(F.sort_array(F.collect_set(F.length("key"))).alias("l")).scalar()
    text = F.col("detalle_norm")
    cuts = F.array_distinct(
        F.flatten(
            F.transform(
                F.filter(F.col("_lens"), lambda n: n <= F.length(text)),
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.length(text) - n + 1),
                    lambda i: F.substring(text, i, n),
                ),
            )
        )
    )
    texts = df.select("detalle_norm").filter(text.isNotNull()).distinct()
    found = (
        texts.withColumn("_lens", lengths)
        .select("detalle_norm", F.explode(cuts).alias("key"))
        .join(rules, "key")
        .groupBy("detalle_norm")
        .agg(F.min_by("categoria", "pos").alias("_rule"))
    )
    return df.join(found, "detalle_norm", "left")


def apply_merchant_rules(
    df: DataFrame, rules: DataFrame, inline_rules: int = INLINE_RULES
) -> DataFrame:
    """Fill a missing category from the first rule whose key is part of `detalle_norm`."""
    first = _distinct_rules(rules)
    few = first.limit(inline_rules + 1).count() <= inline_rules
    matched = _match_inline(df, first) if few else _match_by_substring(df, first)
    filled = F.coalesce(F.col("categoria"), F.col("_rule"))
    return matched.withColumn("categoria", filled).select(*df.columns)


def mark_own_transfers(df: DataFrame, aliases: Iterable[str]) -> DataFrame:
    """Flag rows whose text holds one of the user's own account names."""
    names = [a.upper() for a in aliases]
    hit = F.lit(False)
    for name in names:
        hit = hit | F.contains(F.col("detalle_norm"), F.lit(name))
    return df.withColumn("es_entre_cuentas", F.coalesce(hit, F.lit(False)))


def teaching_rows(df: DataFrame) -> DataFrame:
    """The categorised rows that name a merchant, with its `key`."""
    return (
        df.filter(~blank(F.col("categoria")) & (F.length("detalle_norm") > 3))
        .withColumn("key", F.trim(F.substring_index("detalle_norm", "*", 1)))
        .filter(F.length("key") >= 3)
    )


def learn_merchant_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules plus one per merchant of the categorised rows; the newest row's category wins.

    The merchant is the text before the first '*'. A known key keeps its place
    and takes the new category; new keys come after all known ones, ordered by
    the first row that taught them.
    """
    # Both teachers of a merchant in one aggregate: the rows are made once.
    learned = teaching_rows(df).groupBy("key").agg(_newest("categoria"), _first_teacher())
    return with_learned(rules, learned.select("key", "categoria", *_since()))


def _row_order() -> Column:
    return F.struct(F.col("fecha").isNull(), "fecha", "id")


def _newest(column: str) -> Column:
    return F.max_by(column, _row_order()).alias(column)


def _first_teacher() -> Column:
    return F.min(_row_order()).alias("_first")


def _since() -> list[Column]:
    return [F.col("_first.fecha").alias("_since"), F.col("_first.id").alias("_sid")]


def merged_teachers(rows: DataFrame, teachers: DataFrame) -> DataFrame:
    """(key, fecha, id, categoria, _since, _sid): the newest row of each merchant among new rows and
    earlier teachers, and the first of the new rows; rows without a date are newest."""
    columns = ["key", "fecha", "id", "categoria"]
    every = rows.select(*columns, F.lit(True).alias("_new")).unionByName(
        teachers.select(*columns, F.lit(False).alias("_new"))
    )
    first = F.min(F.when(F.col("_new"), _row_order())).alias("_first")
    newest = F.max_by(F.struct(*columns[1:]), _row_order()).alias("_newest")
    return every.groupBy("key").agg(newest, first).select("key", "_newest.*", *_since())


def with_learned(rules: DataFrame, learned: DataFrame) -> DataFrame:
    """Rules with the categories learned: a known key keeps its place, new keys come last."""
    learned = learned.select("key", F.trim("categoria").alias("_learned"), "_since", "_sid")
    last = rules.select((F.coalesce(F.max("ord"), F.lit(0)) + 1).alias("n")).scalar()
    known = rules.withColumn("_known", F.lit(True))
    return (
        known.join(learned, "key", "full")
        .withColumn("_next", last)
        .select(
            F.coalesce("ord", "_next").alias("ord"),
            F.when(F.col("_known"), F.col("since")).otherwise(F.col("_since")).alias("since"),
            F.when(F.col("_known"), F.col("since_id")).otherwise(F.col("_sid")).alias("since_id"),
            "key",
            F.coalesce("_learned", "categoria").alias("categoria"),
        )
    )


def map_categories(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Fill blank categories from the exact rules by `norm_db` text, else 'Sin categoría'."""
    source = "detalle_norm" if "detalle_norm" in df.columns else "detalle"
    if "categoria" not in df.columns:
        df = df.withColumn("categoria", F.lit(None).cast("string"))
    learned = rules.select(
        F.col("detalle_norm").alias("_name"), F.col("categoria").alias("_rule")
    )
    given = F.col("categoria")
    given = F.when(blank(given) | F.trim(given).isin("nan", "None"), None).otherwise(given)
    return (
        df.withColumn("detalle_norm", norm_db(F.col(source)))
        .join(learned, F.col("detalle_norm") == F.col("_name"), "left")
        .withColumn(
            "categoria",
            F.coalesce(
                F.nullif(F.coalesce(given, F.col("_rule")), F.lit("")), F.lit(UNCATEGORISED)
            ),
        )
        .drop("_name", "_rule")
    )


def learn_rules(rules: DataFrame, labelled: DataFrame, order: str | None = None) -> DataFrame:
    """Exact rules after learning: the first labelled row of a name overwrites its rule.

    `order` names the column that says which row is first; without it the
    smallest category decides, so the result never depends on the partitioning.
    """
    rank = F.col(order) if order else F.col("categoria")
    learned = (
        labelled.filter(F.col("detalle_norm").isNotNull() & ~blank(F.col("categoria")))
        .groupBy("detalle_norm")
        .agg(F.min_by("categoria", rank).alias("_learned"))
    )
    return rules.join(learned, "detalle_norm", "full").select(
        "detalle_norm", F.coalesce("_learned", "categoria").alias("categoria")
    )


def rename_category(
    ledger: DataFrame, rules: DataFrame, categories: DataFrame, old: str, new: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ledger, rules and category list with the new name; the base category is never renamed."""
    if not old or not new or old == new or old == UNCATEGORISED:
        return ledger, rules, categories

    def swap(c: str) -> Column:
        return F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)).alias(c)

    added = categories.sparkSession.createDataFrame([(new,)], "nombre string")
    listed = categories.select(swap("nombre")).unionByName(added)
    return (
        ledger.withColumn("categoria", swap("categoria")),
        rules.withColumn("categoria", swap("categoria")),
        listed.distinct(),
    )
