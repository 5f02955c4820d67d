"""History blobs: scan each distinct content once, under its first allowed name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as path_fn
from ..policy import Policy


def allowed(blobs: DataFrame, policy: Policy) -> DataFrame:
    return blobs.where(path_fn.path_allowed(F.col("path"), policy.include, policy.exclude))


def first_paths(blobs: DataFrame, policy: Policy) -> DataFrame:
    """One row per blob: the earliest allowed commit and path.

    The path filter comes first, so a blob is named by an allowed path. An
    aggregation with a map-side combine keeps a blob that occurs in very many
    commits from collecting in one task.
    """
    rest = [c for c in blobs.columns if c != "oid"]
    first = F.min_by(F.struct(*rest), F.struct("seq", "path")).alias("f")
    return allowed(blobs, policy).groupBy("oid").agg(first).select("oid", *(F.col(f"f.{c}").alias(c) for c in rest))


def label(commit: str, path: str):
    return F.concat_ws(":", F.col(commit).cast("string"), F.col(path))


def preview(blobs: DataFrame, policy: Policy) -> DataFrame:
    """Counts of what a history scan would read."""
    ok = path_fn.path_allowed(F.col("path"), policy.include, policy.exclude)
    return blobs.agg(
        F.count_distinct("commit_no").alias("candidate_commits"), F.count(F.lit(1)).alias("candidate_paths"),
        F.count_distinct("oid").alias("unique_blobs"), F.count_distinct(F.when(ok, F.col("oid"))).alias("filtered_blobs"),
    )


def preview_labels(blobs: DataFrame, policy: Policy, n: int = 10) -> DataFrame:
    return first_paths(blobs, policy).orderBy("seq", "path").limit(n).select(label("commit_no", "path").alias("label"))
