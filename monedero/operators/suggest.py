"""Category suggestions for uncategorised rows, from three sources in turn.

All three work on distinct names, or distinct (name, amount) pairs, and are
attached to the pending rows at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monedero.functions.text import blank
from monedero.operators.mutate import apply_edits
from monedero.operators.reimburse import cents
from monedero.operators.rules import learn_rules
from monedero.schema import UNCATEGORISED
from monedero.session import stage

ALTERNATIVES = "array<struct<categoria:string,score:double>>"
_PREFIX = 4
# Width of an amount bucket of the counting sweep, in hundredths of a cent.
_BUCKET = 10_000_000


def pending(df: DataFrame) -> DataFrame:
    """Uncategorised rows that have a name."""
    c = F.col("categoria")
    open_row = c.isNull() | c.isin("", UNCATEGORISED)
    return df.filter(open_row & (F.coalesce(F.col("detalle_norm"), F.lit("")) != ""))


def _categorised(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("categoria").isNotNull() & (F.col("categoria") != UNCATEGORISED))


def compare_name(c: Column) -> Column:
    return F.upper(F.trim(c))


def history_base(ledger: DataFrame) -> DataFrame:
    """Categorised rows with a name: (name, categoria, cents)."""
    return (
        _categorised(ledger)
        .select(
            compare_name(F.col("detalle_norm")).alias("name"),
            "categoria",
            cents(F.col("monto")).alias("cents"),
        )
        .filter(F.col("name") != "")
    )


def exact_names(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(detalle_norm, sugerida) for the names an exact rule covers."""
    useful = rules.filter(~blank(F.col("categoria"))).select(
        "detalle_norm", F.col("categoria").alias("sugerida")
    )
    return names.join(useful, "detalle_norm")


def suggest_exact(pending_rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Pending rows whose name has an exact rule: confidence 1."""
    useful = rules.filter(~blank(F.col("categoria"))).select(
        "detalle_norm", F.col("categoria").alias("sugerida")
    )
    return pending_rows.join(useful, "detalle_norm").select(
        "unique_key",
        "detalle",
        "detalle_norm",
        "sugerida",
        F.lit("Mapa exacto").alias("fuente"),
        F.lit(1.0).alias("confianza"),
    )


def dominant_names(ledger: DataFrame, min_pct: float = 70.0) -> DataFrame:
    """(detalle_norm, sugerida, pct) for names whose top category reaches `min_pct` of their rows.

    Blank categories count in the total but are never suggested. Of equally
    frequent categories the first in text order is the top one.
    """
    counts = _categorised(ledger).groupBy("detalle_norm", "categoria").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    best = F.min(F.struct((-F.col("cnt")).alias("neg"), "categoria"))
    pct = -F.col("top.neg") * 100.0 / F.col("total")
    return (
        counts.groupBy("detalle_norm")
        .agg(best.alias("top"), F.sum("cnt").alias("total"))
        .select("detalle_norm", F.col("top.categoria").alias("sugerida"), pct.alias("pct"))
        .filter((F.col("pct") >= min_pct) & ~blank(F.col("sugerida")))
    )


def suggest_dominant(
    pending_rows: DataFrame, ledger: DataFrame, min_pct: float = 70.0
) -> DataFrame:
    """Pending rows whose name has a dominant category in the ledger: confidence 0.8."""
    return pending_rows.join(dominant_names(ledger, min_pct), "detalle_norm").select(
        "unique_key",
        "detalle",
        "detalle_norm",
        "sugerida",
        F.lit("Historial dominante").alias("fuente"),
        F.lit(0.8).alias("confianza"),
    )


def _groups(probes: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, g) of the questions and (name, g) of the history that answers them.

    A name with history is its own group. Another name asks the group of its
    first four characters, answered by every history name that contains them.
    """
    names = (
        probes.select("name", F.lit(True).alias("asks"), F.lit(False).alias("known"))
        .unionByName(history.select("name", F.lit(False).alias("asks"), F.lit(True).alias("known")))
        .groupBy("name")
        .agg(F.max("asks").alias("asks"), F.max("known").alias("known"))
    )
    own = names.filter("asks and known").select(
        "name", F.concat(F.lit("n"), F.col("name")).alias("g")
    )
    long_enough = F.length("name") >= _PREFIX
    by_prefix = names.filter(F.expr("asks and not known") & long_enough).select(
        "name", F.concat(F.lit("p"), F.substring("name", 1, _PREFIX)).alias("g")
    )
    starts = F.sequence(F.lit(1), F.length("name") - (_PREFIX - 1))
    grams = F.array_distinct(
        F.transform(starts, lambda i: F.substring(F.col("name"), i, F.lit(_PREFIX)))
    )
    containing = (
        names.filter(F.col("known") & long_enough)
        .select("name", F.explode(grams).alias("gram"))
        .select("name", F.concat(F.lit("p"), F.col("gram")).alias("g"))
        .join(by_prefix.select("g").distinct(), "g", "left_semi")
        .select("name", "g")
    )
    return own.unionByName(by_prefix), own.unionByName(containing)


def _in_band(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Count the history of each (g, categoria) between the bounds of each question.

    A count between bounds is the difference of two running counts. The running
    count is taken in two levels, over amount buckets and inside a bucket, so no
    window holds more than the distinct amounts of one bucket.
    """
    bound = F.explode(
        F.array(
            F.struct((F.col("low") - 1).alias("u"), F.lit(-1).alias("sign")),
            F.struct(F.col("high").alias("u"), F.lit(1).alias("sign")),
        )
    )
    asks = pairs.select("g", "categoria", "cents", "full_n", bound.alias("b")).select(
        "g", "categoria", F.col("b.u").alias("u"), F.lit(0).cast("bigint").alias("n"),
        "cents", "full_n", F.col("b.sign").alias("sign"),
    )
    history = members.select(
        "g", "categoria", (F.col("cents") * 100).alias("u"), "n",
        F.lit(None).cast("bigint").alias("cents"),
        F.lit(None).cast("bigint").alias("full_n"),
        F.lit(0).alias("sign"),
    )
    bucket = F.floor(F.col("u") / F.lit(_BUCKET)).cast("bigint")
    events = history.unionByName(asks).withColumn("bucket", bucket)

    group = ["g", "categoria"]
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = (
        events.groupBy(*group, "bucket")
        .agg(F.sum("n").alias("s"))
        .withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0)))
        .drop("s")
    )
    # History (sign 0) sorts before a question at the same amount: bounds are inclusive.
    inside = Window.partitionBy(*group, "bucket").orderBy("u", F.abs("sign")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = F.sum("n").over(inside)
    return (
        events.withColumn("run", running)
        .filter(F.col("sign") != 0)
        .join(base, [*group, "bucket"])
        .groupBy(*group, "cents")
        .agg(
            F.sum(F.col("sign") * (F.col("run") + F.col("base"))).alias("in_n"),
            F.max("full_n").alias("full_n"),
        )
    )


def similar_probes(
    probes: DataFrame,
    ledger: DataFrame,
    top_k: int = 3,
    rel_tol: float = 0.25,
    abs_tol: float = 1000.0,
) -> DataFrame:
    """(name, cents, alternativas) for distinct (name, cents) questions that find history.

    The counted history and the questions feed many branches, so both are written
    once: the ledger is then read a single time.
    """
    hist = stage(
        history_base(ledger).groupBy("name", "categoria", "cents").agg(F.count(F.lit(1)).alias("n"))
    )
    probes = stage(probes)
    asking, answering = _groups(probes, hist)
    members = (
        hist.join(answering, "name")
        .groupBy("g", "categoria", "cents")
        .agg(F.sum("n").alias("n"))
    )
    full = members.groupBy("g", "categoria").agg(F.sum("n").alias("full_n"))
    questions = probes.join(asking, "name")
    rel_percent = int(round(rel_tol * 100))
    band = F.greatest(
        F.col("cents") * F.lit(rel_percent), F.lit(int(round(abs_tol * 100)) * 100)
    )
    pairs = (
        questions.select("g", "cents")
        .distinct()
        .join(full, "g")
        .withColumns({"low": F.col("cents") * 100 - band, "high": F.col("cents") * 100 + band})
    )
    without_amount = pairs.filter(F.col("cents") == 0).select(
        "g", "categoria", "cents", F.lit(0).cast("bigint").alias("in_n"), "full_n"
    )
    counted = _in_band(pairs.filter(F.col("cents") > 0), members).unionByName(without_amount)

    use_band = F.col("in_total") > 0
    answers = (
        counted.groupBy("g", "cents")
        .agg(
            F.sum("in_n").alias("in_total"),
            F.collect_list(F.struct("categoria", "in_n", "full_n")).alias("per_category"),
        )
        .withColumn(
            "ranked",
            F.array_sort(
                F.filter(
                    F.transform(
                        "per_category",
                        lambda r: F.struct(
                            (-F.when(use_band, r["in_n"]).otherwise(r["full_n"])).alias("neg"),
                            r["categoria"].alias("categoria"),
                        ),
                    ),
                    lambda r: r["neg"] < 0,
                )
            ),
        )
        .withColumn("best", F.slice("ranked", 1, top_k))
        .withColumn("best_n", F.aggregate("best", F.lit(0).cast("bigint"), lambda s, r: s - r["neg"]))
        .select(
            "g",
            "cents",
            F.transform(
                "best",
                lambda r: F.struct(
                    r["categoria"].alias("categoria"),
                    (-r["neg"] / F.col("best_n")).alias("score"),
                ),
            ).alias("alternativas"),
        )
    )
    return questions.join(answers, ["g", "cents"]).select("name", "cents", "alternativas")


def suggest_similar(
    pending_rows: DataFrame,
    ledger: DataFrame,
    top_k: int = 3,
    rel_tol: float = 0.25,
    abs_tol: float = 1000.0,
) -> DataFrame:
    """Pending rows with the categories of history under a like name and amount."""
    rows = pending_rows.withColumns(
        {"name": compare_name(F.col("detalle_norm")), "cents": cents(F.col("monto"))}
    )
    probes = rows.filter(F.col("name") != "").select("name", "cents").distinct()
    found = similar_probes(probes, ledger, top_k, rel_tol, abs_tol)
    return (
        rows.join(found, ["name", "cents"])
        .withColumn("best", F.get("alternativas", F.lit(0)))
        .select(
            "unique_key",
            "detalle",
            "detalle_norm",
            F.col("best.categoria").alias("sugerida"),
            similar_label(F.col("best.score")).alias("fuente"),
            F.col("best.score").alias("confianza"),
            "alternativas",
        )
    )


def similar_label(score: Column) -> Column:
    return F.concat(F.lit("Nombres similares ("), F.format_number(score, 2), F.lit(")"))


def suggestions(view: DataFrame, ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """One suggestion per pending row: exact rule, dominant history, like names, or none.

    Only names the first two sources leave open go to the third.
    """
    rows = pending(view)
    names = rows.select("detalle_norm").distinct()
    exact = exact_names(names, rules).select(
        "detalle_norm", F.col("sugerida").alias("by_rule")
    )
    dominant = dominant_names(ledger).select(
        "detalle_norm", F.col("sugerida").alias("by_history")
    )
    decided = stage(
        names.join(exact, "detalle_norm", "left").join(dominant, "detalle_norm", "left")
    )
    rows = rows.join(decided, "detalle_norm", "left").withColumns(
        {"name": compare_name(F.col("detalle_norm")), "cents": cents(F.col("monto"))}
    )
    open_rows = F.col("by_rule").isNull() & F.col("by_history").isNull()
    probes = rows.filter(open_rows & (F.col("name") != "")).select("name", "cents").distinct()
    found = similar_probes(probes, ledger)
    none = F.array().cast(ALTERNATIVES)
    joined = rows.join(found, ["name", "cents"], "left").withColumn(
        "alternativas_sim", F.when(open_rows, F.coalesce("alternativas", none)).otherwise(none)
    )
    best = F.get("alternativas_sim", F.lit(0))
    by_rule, by_history = F.col("by_rule"), F.col("by_history")

    def pick(rule, history, like, nothing):
        return (
            F.when(by_rule.isNotNull(), rule)
            .when(by_history.isNotNull(), history)
            .when(best.isNotNull(), like)
            .otherwise(nothing)
        )

    return joined.select(
        "unique_key",
        "detalle",
        "detalle_norm",
        pick(by_rule, by_history, best["categoria"], F.lit(UNCATEGORISED)).alias("sugerida"),
        pick(
            F.lit("Mapa exacto"),
            F.lit("Historial dominante"),
            similar_label(best["score"]),
            F.lit("Sin sugerencia"),
        ).alias("fuente"),
        pick(F.lit(1.0), F.lit(0.8), best["score"], F.lit(0.0)).alias("confianza"),
        "alternativas_sim",
        "monto",
    )


def apply_decisions(
    ledger: DataFrame, rules: DataFrame, decisions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(ledger, rules) after accepted or manual categories; unknown keys and the base category are refused.

    Of several decisions on one row, or one name, the last by `seq` holds.
    """
    seq = F.col("seq") if "seq" in decisions.columns else F.lit(0)
    last = (
        decisions.filter(~blank(F.col("categoria")) & (F.col("categoria") != UNCATEGORISED))
        .withColumn("_seq", seq)
        .groupBy("unique_key")
        .agg(F.max(F.struct("_seq", "categoria")).alias("d"))
        .select("unique_key", F.col("d._seq").alias("seq"), F.col("d.categoria").alias("categoria"))
    )
    names = ledger.select("unique_key", "detalle_norm").join(last, "unique_key")
    newest_first = names.withColumn("_order", F.struct(-F.col("seq"), "unique_key"))
    return (
        apply_edits(ledger, last),
        learn_rules(rules, newest_first, order="_order"),
    )
