"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monedero.session import tune as _tune
from monedero.session import work_dir

_ARROW_CONF = {
    # Small Arrow batches keep a Python worker's memory bounded where texts are long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "128",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}

#: ASCII whitespace as the contracts define it: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings the operators rely on."""
    _tune(spark)
    for key, value in _ARROW_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


class Scratch:
    """Written intermediate tables in the shared folder, removed together.

    `stage` writes a frame once and returns it read back, so later steps neither
    recompute it nor depend on the executors that made it. `close` deletes every
    staged table but those passed to `keep`.
    """

    def __init__(self, spark: SparkSession):
        self.spark = tune(spark)
        self._paths: dict[int, str] = {}
        self._kept: list[DataFrame] = []

    def stage(self, df: DataFrame) -> DataFrame:
        path = work_dir(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        self._kept.append(out)
        return out

    def folder(self) -> str:
        """A new folder name; the caller owns what is written there."""
        return work_dir(self.spark)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self._paths.pop(id(df), None)
            if path:
                remove(self.spark, path)

    def close(self, *keep: DataFrame) -> None:
        for df in [x for x in self._kept if not any(x is k for k in keep)]:
            self.drop(df)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def fold(key: str, mod: int, which: int) -> Column:
    """Whether crc32 of the key's text falls in the held-out fold; a null key does not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % mod == which, F.lit(False))


def sampled(rate: Column | float, *keys: str, seed: int = 7) -> Column:
    """A repeatable draw: rows with equal keys are drawn alike."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    return draw < rate


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII whitespace, with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    if not text:
        return []
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + re.sub("'", "''", value) + "'"
