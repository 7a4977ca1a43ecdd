"""Toxicity classifier, regularised by counterfactual identity terms.

A text is the square roots of its term shares, where terms are hashed words and word
beginnings; so one insult weighs as much in a long text as its share says. On a
bounded, repeatable sample of labelled rows a logistic regression is fitted whose
loss also holds, for every training text that names a group, the squared change of
the score when its identity terms are swapped for others of the same kind. A word
that names a group then cannot carry the score, even if insults surround it in the
sample; what is said about the group still can.

Training is full-batch: in each round the tasks sum the gradient over the staged rows,
and the driver takes one adaptive step with soft thresholding. Scoring is one
sparse dot product per document, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monedero.llm.common import Scratch, batch, sampled, tune

BITS = 18
#: Labelled documents the model is fitted on, in expectation.
MAX_TRAIN_ROWS = 12_000
ROUNDS = 30
#: Step size, soft threshold, weight of a toxic row, weight of the score changes.
STEP, L1, TOXIC_WEIGHT, CHANGE_WEIGHT = 4.0, 1e-4, 2.0, 10.0
#: Word beginnings that are terms of their own.
BEGINNINGS = (4, 5, 6, 7)

# --- fixed values: terms that name groups, one kind and number per line --------------
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "wives", "husbands"),
    ("woman", "man", "girl", "boy", "wife", "husband"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("black", "white", "asian", "african", "european", "latino", "arab"),
    ("mexican", "german", "french", "spanish", "american", "chinese", "indian", "turkish", "polish"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual"),
    ("transgender", "cisgender", "nonbinary"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"),
    ("disabled", "blind", "deaf", "autistic", "healthy"),
    ("old", "young", "elderly", "teenage"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("ausländer", "flüchtlinge", "migranten", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
    ("étrangers", "réfugiés", "immigrés", "voisins"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
    ("extranjeros", "refugiados", "inmigrantes", "vecinos"),
)
# -------------------------------------------------------------------------------------
_WORD = re.compile(r"\w+")


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def word_counts(text: str | None) -> Counter:
    return Counter(m.group().lower() for m in _WORD.finditer(text or ""))


def terms_of(word: str, bits: int) -> list[int]:
    """The buckets of a word and of its beginnings."""
    mask = (1 << bits) - 1
    coded = [word, *("^" + word[:n] for n in BEGINNINGS if len(word) > n)]
    return [zlib.crc32(c.encode("utf-8", "surrogatepass")) & mask for c in coded]


def vector(counts: Counter, bits: int = BITS, terms: Callable[[str], Iterable[int]] | None = None) -> dict[int, float]:
    """Bucket to square root of the bucket's share of the words; `terms` may leave buckets out."""
    sums: dict[int, int] = {}
    for word, n in counts.items():
        for at in terms(word) if terms else terms_of(word, bits):
            sums[at] = sums.get(at, 0) + n
    whole = max(1, counts.total())
    return {at: (n / whole) ** 0.5 for at, n in sums.items()}


def swaps(counts: Counter, terms=IDENTITY_TERMS) -> Iterator[Counter]:
    """The word counts after every identity term moved on within its kind, by 1 step, 2 steps and so on.

    Each term so meets all others of its kind. A text that names no group has no swaps.
    """
    kinds = {w: (kind, i) for kind in terms for i, w in reversed(list(enumerate(kind)))}
    named = [w for w in counts if w in kinds]
    if not named:
        return
    for shift in range(1, max(len(kinds[w][0]) for w in named)):
        out = Counter(counts)
        for w in named:
            out[w] -= counts[w]
        for w in named:
            kind, i = kinds[w]
            out[kind[(i + shift) % len(kind)]] += counts[w]
        yield +out


def changes(counts: Counter, terms, bits: int) -> Iterator[dict[int, float]]:
    """What each swap changes in the text's vector."""
    own = vector(counts, bits)
    for other in swaps(counts, terms):
        new = vector(other, bits)
        moved = {at: new.get(at, 0.0) - own.get(at, 0.0) for at in own.keys() | new.keys()}
        yield {at: v for at, v in moved.items() if v}


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


_ROWS = pa.schema([("label", pa.int32()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])
#: Rows of this label are changes of a swap.
_SWAP = -1
#: Tasks of a training round; each returns one gradient.
TASKS = 8
#: Gradients are added as multiples of this, so their sum does not depend on its order.
_UNIT = 2.0**-44


def gradient(model: Model, rows: pa.RecordBatch, text_share: float, swap_share: float) -> np.ndarray:
    """The batch's part of the loss gradient by bucket, the bias last.

    A text counts `text_share`, a toxic one `TOXIC_WEIGHT` times that, a swap `swap_share`.
    """
    label = rows.column(0).to_numpy(zero_copy_only=False)
    at = rows.column(1).flatten().to_numpy(zero_copy_only=False)
    value = rows.column(2).flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(label)), rows.column(1).value_lengths().to_numpy(zero_copy_only=False))
    z = np.bincount(row, weights=value * model.weights[at], minlength=len(label))
    error = (sigmoid(z + model.bias) - label) * np.where(label == 1, TOXIC_WEIGHT, 1.0) * text_share
    swap = label == _SWAP
    pull = np.where(swap, z * swap_share, error)
    slope = np.bincount(at, weights=value * pull[row], minlength=len(model.weights))
    return np.append(slope, pull[~swap].sum())


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    terms=IDENTITY_TERMS,
    max_rows: int = MAX_TRAIN_ROWS,
    rounds: int = ROUNDS,
    change_weight: float = CHANGE_WEIGHT,
    bits: int = BITS,
) -> Model:
    """The model fitted on the labelled documents.

    `labels` holds 0 or 1 per key; rows with another or no label are left out, and of
    repeated keys the largest label counts. Null and empty texts train the bias.
    Without labelled rows all weights are 0 and every score is one half.
    """
    scratch = Scratch(docs.sparkSession)
    known = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
        .where(F.col("key").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("key")
        .agg(F.max("label").alias("label"))
    )
    rate = min(1.0, max_rows / max(1, known.count()))
    # The drawn keys are bounded by `max_rows`, so they travel to the texts.
    drawn = known.where(sampled(F.lit(rate), "key"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).join(F.broadcast(drawn), "key")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts = word_counts((t or b"").decode("utf-8", "replace"))
                for tag, v in ((y, vector(counts, bits)), *((_SWAP, c) for c in changes(counts, terms, bits))):
                    at = sorted(v)
                    out.append((tag, at, [v[a] for a in at]))
            if out:
                yield batch(_ROWS, *map(list, zip(*out, strict=True)))

    train = scratch.stage(rows.select("label", "text").mapInArrow(vectors, "label int, at array<int>, value array<double>"))
    swaps_of, texts_of = F.count_if(F.col("label") == _SWAP), F.count_if(F.col("label") != _SWAP)
    n_swaps, n_texts = train.agg(swaps_of, texts_of).first()
    model = Model(np.zeros(1 << bits), 0.0)
    seen = np.full((1 << bits) + 1, 1e-12)
    for _ in range(rounds if n_texts else 0):
        slope = _slope(train, model, 1.0 / n_texts, change_weight / max(1, n_swaps))
        seen += slope * slope
        rate = STEP / np.sqrt(seen)
        moved = model.weights - rate[:-1] * slope[:-1]
        model = Model(np.sign(moved) * np.maximum(0.0, np.abs(moved) - rate[:-1] * L1), float(model.bias - rate[-1] * slope[-1]))
    scratch.close()
    return model


def _slope(train: DataFrame, model: Model, text_share: float, swap_share: float) -> np.ndarray:
    """The gradient of the mean loss: `TASKS` arrays of the model's size reach the driver."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.weights) + 1)
        for b in batches:
            total += gradient(shared.value, b, text_share, swap_share)
        units = np.round(total / _UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([units.tobytes()], pa.binary())], ["g"])

    parts = train.coalesce(TASKS).mapInArrow(partial, "g binary").collect()
    shared.unpersist()
    return sum(np.frombuffer(p.g, np.int64) for p in parts) * _UNIT


class Scorer:
    """Scores texts by the buckets that have a weight."""

    def __init__(self, model: Model, bits: int = BITS):
        self.bias, self.weights, used = model.bias, model.weights.tolist(), (model.weights != 0).tobytes()
        self.bits, self.terms = bits, lru_cache(1 << 18)(lambda word: tuple(at for at in terms_of(word, bits) if used[at]))

    def __call__(self, text: str | None) -> float:
        v = vector(word_counts(text), self.bits, self.terms)
        return float(sigmoid(sum(self.weights[at] * x for at, x in sorted(v.items())) + self.bias))


def predict(docs: DataFrame, model: Model, *, text: str = "text", columns=("doc_id",), bits: int = BITS) -> DataFrame:
    """The given columns of every row with `score`, the probability of label 1.

    Equal texts score alike, whatever their keys; a null or empty text is scored by
    the bias alone.
    """
    spark = tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*columns, F.col(text).cast("binary").alias("_toxicity_text"))
    schema = rows.drop("_toxicity_text").schema.add("score", "double")
    width = len(rows.columns) - 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = Scorer(shared.value, bits)
        for b in batches:
            texts = ((t or b"").decode("utf-8", "replace") for t in b.column(width).to_pylist())
            prob = pa.array([score_of(t) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:width], prob], [*b.schema.names[:width], "score"])

    return rows.mapInArrow(score, schema)
