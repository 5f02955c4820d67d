"""Pieces shared by the operators of this subpackage.

Every operator reads the two columns it is told of and returns columns of its own, so other columns of the input
may have any name. A stage that must return its input's columns carries the row as one struct.
"""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "row"
#: Of compressed files; in memory a table of numbers takes a few times as much.
BROADCAST_BYTES = 4 << 20
SLICE = 256
BATCH_ROWS = 512
#: What operators keep in a worker process between their tasks: how to drop it, by operator.
HELD: dict[str, Callable[[], None]] = {}
#: A task holds a row group in memory while it writes one.
ROW_GROUP = 16 << 20


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns of interest as ``doc_id`` and ``text``; a null text is empty."""
    return docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same with the whole row beside it, for stages that return the columns of their input."""
    return docs.select(
        docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"), F.struct("*").alias(ROW)
    )


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below the folder that all executors share.

    The folder is the one that ``spark.checkpoint.dir`` names. Only a local session, as in tests, may do without.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "veilspark-shared")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and no executor's loss undoes it."""
    path = shared_folder(df.sparkSession, what)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def released(*frames: DataFrame) -> None:
    """Delete what ``kept`` wrote for frames that no later job reads."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.kept_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a frame's size, to decide on a broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def joinable(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table for a join: broadcast if its files are small, else left to a shuffle, which AQE splits where it is skewed."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def slices(batches, rows: int = SLICE, owner: str = ""):
    """Parts of Arrow batches, so that what a task makes of one stays small beside it.

    A worker lives on for tasks of other stages and queries: what another operator than ``owner`` keeps in it is dropped.
    """
    if others := [name for name in HELD if name != owner]:
        for name in others:
            HELD.pop(name)()
        gc.collect()
        returned()
    for batch in batches:
        yield from (batch.slice(low, rows) for low in range(0, len(batch), rows))
    returned()


def returned() -> None:
    """What a worker's batches and their texts took goes back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Let batches of Arrow and of the Parquet reader hold few rows, for the session: texts are long.

    An Arrow batch lies in memory on both sides, and the reader holds one of each column on the heap. The operators don't
    call this, as it is the session's setting; registered queries and each stage of the pipeline do.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))
