"""Sessions for local use; a cluster brings its own."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int | None = None, app: str = "veilspark") -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows evenly over tasks for costly per-row work.

    The splits of a file say nothing of its rows: a row group goes to one of
    them as a whole and the others are empty. So the rows are dealt whatever
    the number of splits; tasks grow in number with the input.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming else df.repartition(2 * max(cores, df.rdd.getNumPartitions()))
