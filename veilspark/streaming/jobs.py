"""Structured Streaming forms of the batch operators.

Detection is stateless per row, so a stream uses the same functions as a table.
What is added here is reading logs as streams, capping a batch, keyed state with
a watermark, and running a stream to a stored result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, scan
from ..operators.scan import first_rows
from ..policy import Policy

MAX_EVENTS_PER_BATCH = 50
FILES_PER_BATCH = 100


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder for checkpoints and results below the one that ``spark.checkpoint.dir`` names.

    Only a local session may do without that setting, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, folder: str, name: str, schema, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Parquet files of one name as a stream; a batch takes a bounded number of files."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def read_log(spark: SparkSession, folder: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Log files as a stream of lines in ``value``; rotation only adds files."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def scan_stream(documents: DataFrame, policy: Policy = Policy(), **options) -> DataFrame:
    """Findings of a stream of documents; stateless, so append mode and no watermark."""
    return scan.scan(documents, policy, **options)


def tail_blocked(lines: DataFrame, column: str = "value", since: Column | None = None) -> DataFrame:
    """Blocked entries of a log stream, from a time on; unreadable lines are skipped."""
    rows = audit.entries(audit.parse_lines(lines, column)).where(F.col("event").eqNullSafe(audit.BLOCKED))
    return rows if since is None else rows.where(F.col("time") >= since)


def audit_counts(label: str = "tool", window: str = "1 hour") -> tuple[Callable, Callable]:
    """Entries per time window and label: a count of each batch, and their sum over the batches.

    No state is kept, so rows may come as late as they like, and the last window is there as well.
    """
    def count(batch: DataFrame) -> DataFrame:
        known = batch.where(F.col(label).isNotNull() & F.col("time").isNotNull())
        return known.groupBy(F.window("time", window).alias("w"), label).agg(F.count(F.lit(1)).alias("n")).select(
            F.col("w.start").alias("window_start"), label, "n")

    return count, lambda stored: stored.groupBy("window_start", label).agg(F.sum("n").alias("n"))


def cap_newest(by: str, order: str, limit: int = MAX_EVENTS_PER_BATCH) -> tuple[Callable, Callable]:
    """The newest rows of each project, of a batch and then of all batches."""
    cap = lambda rows: first_rows(rows, [by], [F.desc(order)], limit)
    return cap, cap


def once(keys: list[str]) -> tuple[Callable, Callable]:
    """One row for each key, in a batch and then over all batches, however far apart they come."""
    first = lambda rows: rows.dropDuplicates(keys)
    return first, first


def run_to_folder(stream: DataFrame, *, steps: tuple[Callable, Callable] | None = None) -> DataFrame:
    """Process what is there, store it as Parquet and return it as a table.

    ``steps`` are what is done to a batch before it is stored, and to all that was stored when it is read, so the
    result does not depend on how the input was split.

    Results go to the shared folder, not through the driver. A batch writes into
    a folder of its own, so a repeated batch replaces its first attempt.
    """
    spark = stream.sparkSession
    base = shared_folder(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if steps is None:
        query = writer.format("parquet").option("path", f"{base}/out").outputMode("append").start()
        schema = stream.schema
    else:
        schema = steps[0](spark.createDataFrame([], stream.schema)).schema

        def store(batch: DataFrame, number: int) -> None:
            steps[0](batch).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

        query = writer.foreachBatch(store).start()
    query.awaitTermination()
    stored = spark.read.schema(schema).parquet(f"{base}/out").select(*schema.names)
    return stored if steps is None else steps[1](stored)
