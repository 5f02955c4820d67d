"""Places in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

ROW_BITS = 33


def ranked(df: DataFrame, order: list[Column], what: str) -> DataFrame:
    """The rows with ``position``, from 1, in the given order; rows that tie are placed in any order.

    Rows are dealt by ranges of the order and sorted in each; a row's place is its place in its range plus the rows of
    the ranges before. The driver sees one count a range.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    held = kept(dealt.withColumns({
        "part": F.shiftright("place", ROW_BITS), "place": F.col("place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    }), what)
    before, total = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in held.groupBy("part").agg(F.count("*").alias("n")).collect()):
        before.append((part, total))
        total += n
    known = df.sparkSession.createDataFrame(before, "part long, before long")
    return held.join(F.broadcast(known), "part").withColumn("position", F.expr("before + place + 1")).drop("part", "place", "before")
