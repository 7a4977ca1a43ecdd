"""Secret scan: pattern candidates, and a random forest that removes false positives.

Candidates are long tokens with a digit, keys of a known shape, and values of any
length and form assigned to something named like a secret. Their features are column
expressions: length, transitions between character classes, dictionary coverage, the
path they come from and the words around them. The forest (Spark's own, on DataFrames) is
trained on a bounded, repeatable sample of labelled findings. No Python runs on
the executors; the text of documents without a candidate is never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monedero.llm.common import sampled, tune

# Names of secrets, alone or as a part of an identifier: DB_PASSWORD, client_secret, accessToken.
_NAMES = (
    r"(?:(?:^|(?<=[^A-Za-z0-9]))(?:auth(?:orization)?|bearer|pwd|passwd|access[_-]?key|private[_-]?key)"
    r"|token|secret|passw(?:or)?d|passwd|passphrase|api[_-]?key|(?<=[_a-z0-9-])(?:access|private)[_-]?key|credential)s?"
)
# What follows a name in its identifier; a count, type or place of a secret is none.
_REST = (
    r"(?![_-]?(?:count|types?|ur[il]|path|file|name|len|length|min|max|expir\w*|ttl|limit|policy|at|in)(?![A-Za-z0-9]))"
    r"(?:[_-][A-Za-z0-9_-]{0,32}|(?:key|id|value)(?![A-Za-z0-9]))?"
)
_ASSIGNED = rf"(?i:{_NAMES}{_REST})[\"'`\]]{{0,2}}[ \t]{{0,4}}(?:=>|:=|[=:])[ \t]{{0,4}}"
_SCHEME = r"(?:(?i:basic|bearer|token)[ \t]{1,2})?"
#: Keys that are known by their shape alone.
SHAPES = (
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}"
    r"|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_[A-Za-z0-9_]{16,}"
    r"|sk-(?=[A-Za-z_-]{0,40}[0-9])[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,20}PRIVATE KEY-----)(?![A-Za-z0-9])"
)
_LONG = r"\b(?=[A-Za-z_+/-]{0,256}[0-9])[A-Za-z0-9_+/-]{16,}={0,2}"
# The short look-behinds come first: they spare nearly all places the long one.
_VALUE = (
    rf"(?<=[\"'`])(?<=[=:>][ \t]{{0,4}}[\"'`])(?<={_ASSIGNED}[\"'`])[^\"'`\r\n]+(?=[\"'`])"
    rf"|(?<=[=:> \t])(?<=[=:>][ \t]{{0,4}}{_SCHEME})(?<={_ASSIGNED}{_SCHEME})(?!(?i:basic|bearer|token)[ \t])[^\s\"'`=:>]\S*?(?=[\"'`,;.)\]}}]*(?:\s|$))"
)
#: A key of a known shape, a value assigned to a secret's name, or a token of at least
#: 16 characters with a digit among its first 257.
CANDIDATE = f"{SHAPES}|{_VALUE}|{_LONG}"
MARK = "[SECRET]"
#: Findings the forest is fitted on, in expectation.
MAX_FINDINGS = 20_000
#: Size of the dictionary its feature `coverage` looks words up in.
DICTIONARY_WORDS = 500
TREES, DEPTH = 20, 6
_NAMED = rf"(?i:{_NAMES}{_REST})\W{{1,12}}{_SCHEME}$"
# Text that stands for a value: a placeholder, a word of a type or schema, a call or a reference.
_STAND_IN = (
    r"(?i)^(?:<.*|\$\{.*|\{\{.*|%\w+%|\*+|x{3,}|null|none|nil|true|false|undefined|str|string|text|required|optional|yes|no"
    r"|[a-z_][\w.]*[(\[].*|(?:os|process|env|self|this|config|settings|request)\..*|\$[a-z_]+)$"
)
_PLAIN_THINGS = "sha|hash|commit|checksum|digest|uuid|example|sample|dummy|card|phone|order|invoice|isbn|id"
_TEST_PATHS = "test|example|sample|mock|fixture|doc"
FEATURES = (
    "length", "changes", "digits", "upper", "distinct", "hex", "numeric", "coverage",
    "path_test", "named", "assigned", "quoted", "plain_thing", "words_before", "shaped",
)


def candidates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """doc_id, nth, value, before, after, path: every candidate with the text around it."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(path).cast("string").alias("path"))
    around = F.transform(
        F.split("text", CANDIDATE, -1), lambda g: F.struct(F.right(g, F.lit(60)).alias("b"), F.left(g, F.lit(30)).alias("a"))
    )
    values = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))

    def zip_up(x: Column) -> Column:
        n = F.size(x["values"])
        # A candidate that stands right before is part of the text before.
        earlier = F.slice(F.concat(F.array(F.lit("")), x["values"]), F.lit(1), n)
        before = F.zip_with(
            F.slice(x["around"], F.lit(1), n), earlier, lambda g, v: F.right(F.concat(F.right(v, F.lit(60)), g["b"]), F.lit(60))
        )
        context = F.zip_with(before, F.slice(x["around"], F.lit(2), n), lambda b, g: F.struct(b.alias("b"), g["a"].alias("a")))
        return F.zip_with(x["values"], context, lambda v, c: F.struct(v.alias("v"), c["b"].alias("b"), c["a"].alias("a")))

    zipped = F.element_at(F.transform(F.array(F.struct(around.alias("around"), values.alias("values"))), zip_up), 1)
    return (
        rows.where(F.col("text").rlike(CANDIDATE))
        .select("doc_id", "path", F.posexplode(zipped).alias("nth", "x"))
        .select("doc_id", "nth", F.col("x.v").alias("value"), F.col("x.b").alias("before"), F.col("x.a").alias("after"), "path")
    )


def _count(value: Column, classes: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{classes}]", "")).cast("double")


def features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """`found` with one number per name in FEATURES; nothing is null."""
    value, n = F.col("value"), F.length("value").cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")).cast("double")
    pieces = F.split(F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    known = F.filter(pieces, lambda p: F.array_contains(F.array(*map(F.lit, dictionary or [""])), p) & (p != ""))
    before = F.coalesce(F.col("before"), F.lit(""))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    columns = {
        "length": n,
        "changes": (runs - 1) / n,
        "digits": _count(value, "0-9") / n,
        "upper": _count(value, "A-Z") / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double") / n,
        "hex": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "numeric": flag(value.rlike("^[0-9_+/-]+$")),
        "coverage": F.length(F.array_join(known, "")).cast("double") / n,
        "path_test": flag(F.col("path").rlike(f"(?i){_TEST_PATHS}")),
        "named": flag(before.rlike(_NAMED)),
        "assigned": flag(before.rlike(r"[=:]\W{0,6}$")),
        "quoted": flag(before.rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "plain_thing": flag(before.rlike(rf"(?i)\b(?:{_PLAIN_THINGS})\b")),
        "words_before": F.size(F.split(F.trim(before), r"\s+")).cast("double"),
        "shaped": flag(value.rlike(SHAPES)),
    }
    return found.withColumns(columns)


def dictionary(docs: DataFrame, *, text: str = "text") -> list[str]:
    """The most frequent words of at least three letters in all documents."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), "[^a-z]+")).alias("word"))
    top = words.where(F.length("word") > 2).groupBy("word").count().orderBy(F.desc("count"), "word")
    return [r["word"] for r in top.limit(DICTIONARY_WORDS).collect()]


def weak_labels(found: DataFrame) -> DataFrame:
    """Findings labelled by rule where no reviewed labels exist.

    1: the token has the shape of a known key; or it is the value of something named like a
    secret and either a long token with at least eight distinct characters, or assigned, of
    at least four distinct characters, no stand-in, and quoted, set by a tight `=`, or mixed of
    letters and others. 0: all others.
    """
    value, before = F.col("value"), F.col("before")
    distinct = F.size(F.array_distinct(F.split("value", "")))
    quoted = before.rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")
    tight = before.rlike(r"[A-Za-z0-9_]=$") & ~value.rlike(rf"(?i){_NAMES}")
    mixed = value.rlike("[A-Za-z]") & value.rlike(r"[0-9]|[^A-Za-z0-9_.,-]|[a-z][A-Z]")
    bare = ~value.rlike(r"\s") | before.rlike("=[ \t]*[\"'`]$")
    short = before.rlike(rf"[=:>]\W{{0,6}}{_SCHEME}$") & (distinct >= 4) & ~value.rlike(_STAND_IN) & (quoted & bare | tight | mixed & bare)
    secret = value.rlike(SHAPES) | before.rlike(_NAMED) & (value.rlike(f"^(?:{_LONG})$") & (distinct >= 8) | short)
    return found.withColumn("label", F.coalesce(secret, F.lit(False)).cast("int"))


@dataclass
class Model:
    forest: RandomForestClassificationModel | None
    constant: float
    words: list[str]
    #: Whether the labels came from the rule; then what the rule calls a secret is one,
    #: however rare its form was among the findings the forest saw.
    by_rule: bool = False


def _vector() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features")


def fit(labelled: DataFrame, words: list[str], *, max_findings: int = MAX_FINDINGS, by_rule: bool = False) -> Model:
    """Train on labelled findings (`candidates` with an int `label`).

    Where only one label occurs there is nothing to learn, and every finding gets it;
    without findings, all are taken for secrets.
    """
    rows = labelled.where("label in (0, 1) and value is not null")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model(None, float(next(iter(counts), 1)), words, by_rule)
    rates = {k: min(1.0, max_findings / 2 / n) for k, n in counts.items()}
    rate = F.when(F.col("label") == 1, rates[1]).otherwise(rates[0])
    train = features(rows.where(sampled(rate, "doc_id", "nth", "value")), words)
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=1, cacheNodeIds=False
    ).fit(_vector().transform(train).select("_features", F.col("label").cast("double").alias("label")))
    return Model(forest, 0.0, words, by_rule)


def score(found: DataFrame, model: Model) -> DataFrame:
    """`found` with `score`, the forest's share of votes for a secret."""
    kept = [F.col(c) for c in found.columns]
    if model.forest is None:
        votes, voted = F.lit(model.constant), found
    else:
        votes, voted = vector_to_array("probability")[1], model.forest.transform(_vector().transform(features(found, model.words)))
    if model.by_rule:
        voted = weak_labels(voted)
        votes = F.greatest(votes, F.col("label").cast("double"))
    return voted.select(*kept, votes.alias("score"))


def train(docs: DataFrame) -> Model:
    """A model for `docs` trained on its own findings, labelled by rule."""
    return fit(weak_labels(candidates(docs)), dictionary(docs), by_rule=True)


def scan(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, nth, n_chars, digest, score, is_secret of every candidate.

    `digest` is the SHA-256 of the token, so results spread no secrets. Null and empty
    texts give no rows; repeated documents give repeated rows.
    """
    return score(candidates(docs), model).select(
        "doc_id",
        "nth",
        F.length("value").alias("n_chars"),
        F.sha2("value", 256).alias("digest"),
        "score",
        (F.col("score") >= threshold).alias("is_secret"),
    )


def _whole(value: Column) -> Column:
    """A pattern of the value where it is no part of a longer word."""
    quoted = F.regexp_replace(value, r"(\p{Punct})", r"\\$1")
    return F.concat(F.lit("(?<![A-Za-z0-9])"), quoted, F.lit("(?![A-Za-z0-9])"))


def redact(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """All documents, with confirmed secrets replaced by a mark.

    A text loses the secrets found in itself: findings are keyed by a digest of text and
    source, so doc_id may be null or repeat, and equal rows are treated once. Only rows with
    a candidate are joined to their findings.
    """
    having = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    source = F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    keyed = docs.where(having).withColumn("_redact_key", F.sha2(F.concat_ws("\0", source, "text"), 256))
    secrets = (
        score(candidates(keyed, key="_redact_key"), model)
        .where(F.col("score") >= threshold)
        .groupBy(F.col("doc_id").alias("_redact_key"))
        .agg(F.array_sort(F.collect_set(F.struct((-F.length("value")).alias("minus"), "value"))).alias("_secrets"))
    )
    joined = keyed.join(secrets, "_redact_key", "left")
    text = F.when(F.col("_secrets").isNull(), F.col("text")).otherwise(
        F.aggregate("_secrets", F.col("text"), lambda t, s: F.regexp_replace(t, _whole(s["value"]), F.lit(MARK)))
    )
    changed = joined.withColumn("text", text).select(*docs.columns)
    return docs.where(~having).union(changed)
