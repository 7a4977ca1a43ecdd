"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL.

Texts become sets of hashed word unigrams and bigrams. A bounded, repeatable
sample of labelled rows is turned into such sets once. Training then runs rounds:
every shard streams its rows through follow-the-regularised-leader updates from
the shared state, and the changes of the two accumulators are added up by bucket.
Scoring is one sparse dot product per document, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monedero.llm.common import Scratch, batch, sampled, tune

BITS = 18
#: Labelled documents the model is fitted on, in expectation.
MAX_TRAIN_ROWS = 12_000
SHARDS = 8
ROUNDS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.001, 0.01
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SLICE = 50_000


class Features:
    """Distinct buckets of a text's words and word pairs; bucket 0 is the bias."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (m.group() for m in _TOKEN.finditer(text or ""))
        self.seen[0] = True
        last = np.zeros(0, np.uint64)
        while part := list(islice(tokens, _SLICE)):
            crc = (zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) for w in part)
            h = np.concatenate([last, np.fromiter(crc, np.uint64, len(part))])
            self.seen[self._bucket(h[len(last) :])] = True
            self.seen[self._bucket(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(1))] = True
            last = h[-1:]
        at = np.flatnonzero(self.seen)
        self.seen[at] = False
        return at

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) & self.mask).astype(np.int64)


@dataclass
class State:
    """Accumulated gradients `z` and squared gradients `n` of the FTRL optimiser."""

    z: np.ndarray
    n: np.ndarray

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        step = (BETA + np.sqrt(self.n[at])) / ALPHA + L2
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / step)

    def learn(self, at: np.ndarray, label: int) -> None:
        value = 1.0 / np.sqrt(len(at))
        w = self.weights(at)
        g = (_sigmoid(w.sum() * value) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


_FEATURES = pa.schema(
    [("shard", pa.int32()), ("ord", pa.int64()), ("label", pa.int32()), ("at", pa.list_(pa.int32()))]
)
_CHANGE = pa.schema([("bucket", pa.int32()), ("z", pa.float64()), ("n", pa.float64())])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_rows: int = MAX_TRAIN_ROWS,
    rounds: int = ROUNDS,
    shards: int = SHARDS,
    bits: int = BITS,
) -> np.ndarray:
    """Weights fitted on the labelled documents.

    `labels` holds 0 or 1 per key; rows with another or no label are left out, and
    of repeated keys the largest label counts. Without labelled rows all weights
    are 0 and every score is one half.
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
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(drawn), "key")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features(bits)
        for b in batches:
            sets = [of(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(sets, pa.list_(pa.int32()))], schema=_FEATURES
            )

    ord_ = F.xxhash64(F.lit(11), "key")
    train = scratch.stage(
        rows.select(F.pmod(ord_, F.lit(shards)).cast("int").alias("shard"), ord_.alias("ord"), "label", "text")
        .mapInArrow(features, "shard int, ord long, label int, at array<int>")
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "ord", "label")
    )
    state = State(np.zeros(1 << bits), np.zeros(1 << bits))
    for _ in range(rounds):
        change = _one_round(train, state, shards)
        state.z[change["bucket"]] += change["z"]
        state.n[change["bucket"]] += change["n"]
    scratch.close()
    return state.weights()


def _one_round(train: DataFrame, state: State, shards: int):
    shared = train.sparkSession.sparkContext.broadcast(state)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        own = State(start.z.copy(), start.n.copy())
        for b in batches:
            flat = b.column(3).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(b.column(3).value_lengths().to_numpy(zero_copy_only=False))
            for at, y in zip(np.split(flat, ends[:-1]), b.column(2).to_pylist(), strict=True):
                own.learn(at, y)
        at = np.flatnonzero((own.z != start.z) | (own.n != start.n))
        yield batch(_CHANGE, at, (own.z - start.z)[at], (own.n - start.n)[at])

    # Floating sums differ in their last bits with the order of the parts; whole
    # multiples of 2^-40 do not.
    unit = float(1 << 40)
    out = (
        train.repartition(shards, "shard")
        .sortWithinPartitions("shard", "ord", "label")
        .mapInArrow(learn, "bucket int, z double, n double")
        .groupBy("bucket")
        .agg(*(F.sum(F.round(F.col(c) * unit).cast("decimal(38,0)")).alias(c) for c in ("z", "n")))
        .select("bucket", *((F.col(c).cast("double") / unit).alias(c) for c in ("z", "n")))
        .toPandas()
    )
    shared.unpersist()
    return {c: out[c].to_numpy() for c in out.columns}


def predict(
    docs: DataFrame, weights: np.ndarray, *, text: str = "text", columns=("doc_id",), bits: int = BITS
) -> DataFrame:
    """The given columns of every row with `score`, the probability of label 1.

    A null or empty text is scored by the bias alone.
    """
    spark = tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast(weights)
    rows = docs.select(*columns, F.col(text).alias("_quality_text"))
    schema = rows.drop("_quality_text").schema.add("score", "double")
    width = len(rows.columns) - 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, w = Features(bits), shared.value
        for b in batches:
            sets = [of(t) for t in b.column(width).to_pylist()]
            prob = [float(_sigmoid(w[at].sum() / np.sqrt(len(at)))) for at in sets]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:width], pa.array(prob, pa.float64())], [*b.schema.names[:width], "score"]
            )

    return rows.mapInArrow(score, schema)
