"""Repeated uploads as a stream: each micro-batch of new files is one upload."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from monedero.plans.jobs import run_upload
from monedero.schema import FILES
from monedero.sources import store

# The fixed columns of this source; only the path is ever read.
_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_FAILURE = (PySparkException, Py4JJavaError)
_REASON_CHARS = 500


def ingest_stream(
    spark: SparkSession,
    in_dir: str,
    root: str,
    checkpoint: str,
    date_format: str = "YYYY-MM-DD",
    max_files: int = 1000,
    once: bool = False,
) -> StreamingQuery:
    """Ingest every new file of `in_dir` into the store under `root`.

    The stream carries file names only, at most `max_files` per batch; the files
    are read by the upload job. The batch number is stored with the ledger
    version, so a batch replayed after a failure changes nothing. Late rows are
    inserted like any other: nothing is dropped for its date.

    The table `files` says of every file whether it was read, rejected for its columns,
    or unreadable. An unreadable file does not stop the others; it is set aside and tried
    again with each later batch.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(_FILES)
        .option("maxFilesPerTrigger", max_files)
        .load(in_dir)
        .select("path")
    )

    def upload(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if batch_id <= store.last_batch(session, root, checkpoint):
            return
        new = sorted(r.path for r in batch.select("path").distinct().collect())
        if new:
            upload_files(session, new, root, date_format, batch_id, checkpoint)

    writer = files.writeStream.foreachBatch(upload).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upload_files(
    spark: SparkSession, new: Sequence[str], root: str, date_format: str, batch_id: int, source: str
) -> None:
    """Upload the new files and those set aside earlier that can be read by now."""
    again, aside = readable(spark, set_aside(spark, root))
    try:
        run_upload(spark, [*again, *new], root, date_format, batch_id, source, unreadable=aside)
    except _FAILURE:
        good, bad = readable(spark, new)
        if not bad or (not good and len(new) > 1):
            raise  # It is not for a file of its own.
        if again or good:
            run_upload(spark, [*again, *good], root, date_format, batch_id, source, unreadable=aside | bad)
        else:
            rows = [(p, "unreadable", reason, batch_id) for p, reason in (aside | bad).items()]
            outcomes = spark.createDataFrame(rows, FILES)
            store.commit(spark, root, append={"files": outcomes}, batch_id=batch_id, source=source)


def set_aside(spark: SparkSession, root: str) -> list[str]:
    """The files whose newest outcome is that they could not be read."""
    (files,) = store.load_tables(spark, root, "files")
    newest = files.groupBy("path").agg(F.max_by("outcome", "batch_id").alias("outcome"))
    return sorted(r.path for r in newest.filter("outcome = 'unreadable'").select("path").collect())


def readable(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], dict[str, str]]:
    """(files that can be read to their end, reason for each of the others), by halving."""
    if not paths:
        return [], {}
    try:
        spark.read.text(list(paths)).agg(F.sum(F.length("value"))).collect()
        return list(paths), {}
    except _FAILURE as e:
        if len(paths) == 1:
            return [], {paths[0]: str(e)[:_REASON_CHARS]}
    half = len(paths) // 2
    (good, bad), (more, worse) = readable(spark, paths[:half]), readable(spark, paths[half:])
    return good + more, bad | worse
