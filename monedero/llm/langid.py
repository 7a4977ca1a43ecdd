"""Language identification by multinomial naive Bayes over hashed character n-grams.

Fitting counts n-grams of a bounded, repeatable sample of labelled rows in every
task and adds the sparse counts up by (language, bucket). The matrix of log
probabilities is cut into blocks of languages. Scoring broadcasts a block and adds its
rows up per document with one sparse reduction per batch; with more than one block a
document carries its best language and the sum of its likelihoods from block to block.
Texts are read whole, in slices, and never shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monedero.llm.common import Scratch, batch, sampled

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BITS = 16
#: Labelled documents per language that the model is fitted on, in expectation.
MAX_DOCS_PER_LANG = 4000
#: Languages of one block of the matrix, which a task holds at a time.
LANG_BLOCK = 64
SMOOTHING = 0.5
_SLICE = 1 << 17
#: Numbers of the matrix that are gathered at once.
_FLUSH = 1 << 23
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool)
    return _letters


def ngram_buckets(text: str | None, orders=ORDERS, bits: int = BITS) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, slice by slice.

    Letters are lower-cased, and each run of other characters counts as one blank;
    a blank precedes and follows the text. Without a letter nothing is yielded.
    """
    table, widest = _letter_table(), max(orders)
    carry, seen = np.array([32], np.uint32), False
    text = text or ""
    for at in range(0, len(text), _SLICE):
        points = np.frombuffer(
            text[at : at + _SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32
        )
        letter = table[points]
        if not letter.any():
            if carry[-1] != 32:
                carry = np.append(carry, np.uint32(32))[-widest:]
            continue
        seen = True
        before = np.empty_like(letter)
        before[0], before[1:] = carry[-1] != 32, letter[:-1]
        points = np.where(letter, points, 32)[letter | before]
        yield _hashed(np.concatenate([carry, points]), len(carry), orders, bits)
        carry = np.concatenate([carry, points])[-(widest - 1) or -1 :]
    if seen and carry[-1] != 32:
        yield _hashed(np.append(carry, np.uint32(32)), len(carry), orders, bits)


def _hashed(points: np.ndarray, old: int, orders, bits: int) -> np.ndarray:
    """Buckets of the n-grams that end after the first `old` points."""
    points = points.astype(np.uint64)
    out = []
    for n in orders:
        first = max(0, old - n + 1)
        h = np.full(max(0, len(points) - n + 1 - first), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[first + k : first + k + len(h)]
            h ^= h >> np.uint64(29)
        out.append((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Block:
    """Some languages of a model, in code point order."""

    langs: list[str]
    prior: np.ndarray
    logp: np.ndarray  # buckets x languages


@dataclass
class Model:
    blocks: list[Block]
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS

    @property
    def langs(self) -> list[str]:
        return [x for b in self.blocks for x in b.langs]


def fit(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    max_docs_per_lang: int = MAX_DOCS_PER_LANG,
    lang_block: int | None = None,
    orders: tuple[int, ...] = ORDERS,
    bits: int = BITS,
) -> Model:
    """Fit on rows with a language and a text.

    Every language is learned, `lang_block` of them at a time. Without any labelled row
    the model has no language and predicts `und` everywhere.
    """
    scratch, wide = Scratch(docs.sparkSession), lang_block or LANG_BLOCK
    spark = scratch.spark
    rows = docs.select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return Model([], orders, bits)
    total = {r["lang"]: r["count"] for r in sizes}
    rates = spark.createDataFrame(
        [(k, i, min(1.0, max_docs_per_lang / total[k])) for i, k in enumerate(langs)],
        "lang string, lang_no int, rate double",
    )
    picked = rows.join(F.broadcast(rates), "lang").where(sampled(F.col("rate"), "key"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def drain() -> Iterator[pa.RecordBatch]:
            for no, own in sums.items():
                at = np.flatnonzero(own)
                yield batch(_COUNTS, np.full(len(at), no), at, own[at])
            sums.clear()

        for b in batches:
            for value, no in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if no not in sums and len(sums) >= wide:
                    yield from drain()
                own = sums.setdefault(no, np.zeros(1 << bits, np.int64))
                for found in ngram_buckets(value, orders, bits):
                    own += np.bincount(found, minlength=1 << bits)
        yield from drain()

    counted = (
        picked.select("text", "lang_no")
        .mapInArrow(count, "lang_no int, bucket int, n long")
        .groupBy("lang_no", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    if len(langs) > wide:
        counted = scratch.stage(counted)
    documents = float(sum(total.values()))
    blocks = []
    for first in range(0, len(langs), wide):
        own = langs[first : first + wide]
        found = counted.where(F.col("lang_no").between(first, first + len(own) - 1)).toPandas()
        counts = np.zeros((1 << bits, len(own)))
        counts[found["bucket"].to_numpy(), found["lang_no"].to_numpy() - first] = found["n"].to_numpy()
        logp = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * (1 << bits)))
        blocks.append(Block(own, np.log(np.array([total[k] for k in own], float) / documents), logp))
    scratch.close()
    return Model(blocks, orders, bits)


_COUNTS = pa.schema([("lang_no", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])


def predict(docs: DataFrame, model: Model, *, text: str = "text", columns=("doc_id",)) -> DataFrame:
    """The given columns of every row with `lang_pred` and its posterior `score`.

    A null text, a text without a letter and a model without languages give `und`
    with score 0; equal posteriors give the first language by code point.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        *columns,
        F.col(text).alias("_langid_text"),
        F.lit(UNKNOWN).alias("lang_pred"),
        F.lit(float("-inf")).alias("_best"),
        F.lit(float("-inf")).alias("_all"),
    )
    width = len(rows.columns) - 4
    for no, block in enumerate(model.blocks):
        shared = scratch.spark.sparkContext.broadcast(block)
        rows = rows.mapInArrow(_scorer(shared, width, model.orders, model.bits), rows.schema)
        if no + 1 < len(model.blocks):
            # Written, so that no task holds two blocks.
            rows = scratch.stage(rows)
    score = F.when(F.col("lang_pred") == UNKNOWN, 0.0).otherwise(F.exp(F.col("_best") - F.col("_all")))
    return rows.select(*[F.col(rows.columns[i]) for i in range(width)], "lang_pred", score.alias("score"))


def _scorer(shared, width: int, orders, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in batches:
            known, sums = _sums(b.column(width).to_pylist(), block, orders, bits)
            top = sums.max(axis=1)
            best, every = (b.column(width + i).to_numpy(zero_copy_only=False) for i in (2, 3))
            better = known & (top > best)
            own = np.array(block.langs, object)[sums.argmax(axis=1)]
            pred = np.where(better, own, b.column(width + 1).to_numpy(zero_copy_only=False))
            total = np.logaddexp(every, top + np.log(np.exp(sums - top[:, None]).sum(axis=1)))
            out = [
                pa.array(pred, pa.string()),
                pa.array(np.where(better, top, best), pa.float64()),
                pa.array(np.where(known, total, every), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[: width + 1], *out], b.schema.names)

    return run


def _sums(texts: list[str | None], block: Block, orders, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have a letter, and the log likelihood of every text in every language."""
    sums = np.tile(block.prior, (len(texts), 1))
    known = np.zeros(len(texts), bool)
    parts: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if parts:
            starts = np.cumsum([0, *map(len, parts[:-1])])
            np.add.at(sums, owners, np.add.reduceat(block.logp[np.concatenate(parts)], starts, axis=0))
            parts.clear()
            owners.clear()

    # What is gathered holds so many n-grams of so many languages.
    most = max(1, _FLUSH // len(block.langs))
    waiting = 0
    for i, value in enumerate(texts):
        for found in ngram_buckets(value, orders, bits):
            known[i] = True
            for at in range(0, len(found), most):
                piece = found[at : at + most]
                if waiting and waiting + len(piece) > most:
                    flush()
                    waiting = 0
                parts.append(piece)
                owners.append(i)
                waiting += len(piece)
    flush()
    return known, sums


def accepted(min_score: float = 0.5) -> Column:
    """Rows whose language was recognised."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)
