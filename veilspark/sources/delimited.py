"""Records of delimited files, one big file in many tasks.

A line break inside quotes belongs to its field, so where a record begins depends on all quotes before it. Files are read
as lines, in splits of any size. A pass over each split counts quotes and notes, for both cases of what lies before it,
the parity before each line and the line at which the record began. One row a split tells its own parity; the parities of
the splits before decide which case holds. Records of one line stay where they were read; only lines of longer ones are
brought together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import csv_fields, delimiter_for

#: A stray quote would make the rest of a file one record; a longer record is reported instead of gathered.
MAX_RECORD_CHARS = 1 << 24
SPLIT = ("file", "block")
LINES = "file string, block long, value string, seq long, before int, after int, start0 long, start1 long"


def _walk(batches):
    """Lines of a task's splits with their place, the parity of quotes before and after, and both starts."""
    key, seq, parity, starts = None, 0, 0, [-1, -1]
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch["file"].to_pylist(), batch["block"].to_numpy()
        cuts = [0, *(k for k in range(1, batch.num_rows) if block[k] != block[k - 1] or file[k] != file[k - 1]), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if (file[low], block[low]) != key:
                key, seq, parity, starts = (file[low], block[low]), 0, 0, [-1, -1]
            part = batch.slice(low, high - low)
            after = (parity + np.cumsum(pc.count_substring(part["value"], '"').to_numpy())) % 2
            before = np.concatenate([[parity], after[:-1]])
            places = np.arange(seq, seq + high - low)
            begun = [np.maximum(np.maximum.accumulate(np.where(before == p, places, -1)), starts[p]) for p in (0, 1)]
            numbers = [pa.array(x, k) for x, k in ((places, pa.int64()), (before, pa.int32()), (after, pa.int32()), (begun[0], pa.int64()), (begun[1], pa.int64()))]
            yield pa.RecordBatch.from_arrays([part["file"], part["block"], part["value"], *numbers],
                                             ["file", "block", "value", "seq", "before", "after", "start0", "start1"])
            seq, parity, starts = int(places[-1]) + 1, int(after[-1]), [int(b[-1]) for b in begun]


def read_records(spark: SparkSession, path: str, *, sep: str | None = None) -> DataFrame:
    """file, block and seq (where the record begins, in order), fields and too_long of each record.

    Records may differ in width. Blank lines between records are skipped. A record of more than ``MAX_RECORD_CHARS`` has
    null fields and ``too_long``.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = raw.mapInArrow(_walk, LINES)
    splits = lines.groupBy(*SPLIT).agg(
        F.max_by("after", "seq").alias("parity"), F.max("start0").alias("last0"), F.max("start1").alias("last1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = splits.withColumn("turn", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
    last = F.when(F.col("turn") == 0, F.col("last0")).otherwise(F.col("last1"))
    known = known.withColumn("own", F.when(last >= 0, F.struct(F.col("block").alias("block"), last.alias("seq"))))
    known = known.select(*SPLIT, "turn", F.last("own", ignorenulls=True).over(earlier).alias("carried"))
    started = F.when(F.col("turn") == 0, F.col("start0")).otherwise(F.col("start1"))
    begun = F.when(started >= 0, F.struct(F.col("block").alias("block"), started.alias("seq"))).otherwise(F.col("carried"))
    placed = lines.join(known, [*SPLIT]).select(
        *SPLIT, "seq", "value", begun.alias("record"), ((F.col("before") + F.col("turn")) % 2 + (F.col("after") + F.col("turn")) % 2).alias("inside"))
    single = placed.where("inside = 0").select("file", "record", F.col("value").alias("text"), F.lit(False).alias("too_long"))
    broken = placed.where("inside > 0")
    long = broken.groupBy("file", "record").agg(F.sum(F.length("value") + 1).alias("n")).where(F.col("n") > MAX_RECORD_CHARS)
    parts = F.array_sort(F.collect_list(F.struct("block", "seq", "value")))
    joined = broken.join(long, ["file", "record"], "left_anti").groupBy("file", "record").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("text"))
    every = single.unionByName(joined.withColumn("too_long", F.lit(False))).unionByName(
        long.select("file", "record", F.lit(None).cast("string").alias("text"), F.lit(True).alias("too_long")))
    text = F.regexp_replace("text", r"\r\z", "")
    fields = csv_fields(text, sep or delimiter_for(path))
    return every.where(F.col("too_long") | (text != "")).select("file", "record.block", "record.seq", fields.alias("fields"), "too_long")
