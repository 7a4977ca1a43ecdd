"""Session settings the operators rely on, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even where the split costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings; safe to call again and again."""
    for key, value in _RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Set runtime settings for a while, and back to what they were."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _shared_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder all executors share.

    `spark.checkpoint.dir` names it. Only in local mode, and only where it is
    unset, a fresh temporary folder is taken.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="monedero-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def work_dir(spark: SparkSession) -> str:
    """A new folder name inside the shared folder."""
    return f"{_shared_folder(spark)}/monedero-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table.

    Used where a result feeds several branches of a plan: the branches then read
    only the columns they need, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
