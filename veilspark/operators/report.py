"""Summaries and report formats over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as path_fn
from ..policy import SEVERITIES, severity_rank
from . import scan
from .detect import severity_rank as rank_of

REPORT_VERSION = 1
FINDING = (
    "rule_id", "severity", "kind", "file", "line", "column", "message", "redacted_value", "value_hash", "confidence",
    "context_before", "context_after",
)


def rank_name(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(s) for s in SEVERITIES)), rank + 1)


def at_least(found: DataFrame, severity: str) -> DataFrame:
    return found.where(rank_of(F.col("severity")) >= severity_rank(severity))


def by_severity(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def max_severity(found: DataFrame) -> DataFrame:
    top = F.max(rank_of(F.col("severity")))
    return found.agg(rank_name(top).alias("max_severity"))


def should_fail(found: DataFrame, threshold: str) -> DataFrame:
    return found.agg(
        F.coalesce(F.bool_or(rank_of(F.col("severity")) >= severity_rank(threshold)), F.lit(False)).alias("should_fail")
    )


def summary(found: DataFrame) -> DataFrame:
    """Total and per-severity counts as one row with a map."""
    per = by_severity(found)
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("by_severity"),
    )


def finding_object(found: DataFrame, include_value_hash: bool = False) -> Column:
    """A finding as it stands in a report; context that is empty stays out."""
    hidden = [] if include_value_hash else ["value_hash"]
    filled = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c) if c.startswith("context_") else F.col(c)
    return F.struct(*(filled(c) for c in FINDING if c in found.columns and c not in hidden))


def report_rows(found: DataFrame, include_value_hash: bool = False) -> DataFrame:
    """Each finding as one JSON object, ready for ``write.text`` or ``write.json``."""
    finding = F.to_json(finding_object(found, include_value_hash)).alias("finding")
    return found.select(*(c for c in found.columns if c not in FINDING), finding)


def report_head(rows: DataFrame, threshold: str = "high") -> DataFrame:
    """What a report says beside its findings, as one row: summary, threshold and counters of ``scan_rows`` output."""
    severity_rank(threshold)
    per = rows.groupBy("severity").agg(
        F.sum(F.size("found")).cast("long").alias("n"), F.sum("suppressed").cast("long").alias("suppressed"),
        F.sum("deduplicated").cast("long").alias("deduplicated"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    by_severity = F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("severity", "n"))))
    return per.agg(
        F.lit(REPORT_VERSION).alias("version"),
        F.struct(total("n").alias("total"), F.map_from_entries(by_severity).alias("by_severity")).alias("summary"),
        F.lit(threshold).alias("exit_threshold"), total("suppressed").alias("suppressed"), total("deduplicated").alias("deduplicated"),
    )


def write_report(rows: DataFrame, path: str, include_value_hash: bool = False, mode: str = "overwrite", *,
                 threshold: str = "high", carry: tuple[str, ...] = ()) -> None:
    """A report of ``scan_rows`` output as lines of JSON: one of its head, then one of each finding with ``carry`` beside it.

    The rows are read twice, so a costly scan is better written first.
    """
    found = scan.findings(rows)
    head = report_head(rows, threshold)
    lines = found.select(F.to_json(F.struct(finding_object(found, include_value_hash).alias("finding"), *carry)).alias("value"))
    head = head.select(F.to_json(F.struct(F.struct(*head.columns).alias("report"))).alias("value"))
    head.unionByName(lines).write.mode(mode).text(path)


def read_report(spark: SparkSession, path: str, carry: str = "") -> tuple[DataFrame, DataFrame]:
    """The head of a written report, and its findings as ``report_rows`` has them; ``carry`` is the schema of what is beside."""
    lines = spark.read.text(path)
    is_head = F.col("value").startswith('{"report":')
    head = lines.where(is_head).select(F.get_json_object("value", "$.report").alias("report"))
    beside = [F.from_json("value", carry).alias("c")] if carry else []
    found = lines.where(~is_head).select(*beside, F.get_json_object("value", "$.finding").alias("finding"))
    return head, found.select(*(["c.*"] if carry else []), "finding")


# -- SARIF 2.1.0 ---------------------------------------------------------------


def sarif_level(severity: Column) -> Column:
    return (
        F.when(severity.isin("critical", "high"), "error")
        .when(severity.isin("low", "info"), "note")
        .otherwise("warning")
    )


def sarif_severity(severity: Column) -> Column:
    return (
        F.when(severity == "critical", "9.0").when(severity == "high", "8.0").when(severity == "low", "2.0")
        .when(severity == "info", "0.0").otherwise("5.0")
    )


def sarif_precision(confidence: Column) -> Column:
    c = confidence.cast("float")
    return F.when(c >= F.lit(0.85).cast("float"), "high").when(c >= F.lit(0.6).cast("float"), "medium").otherwise("low")


def rule_first(found: DataFrame, order=("file", "line", "column")) -> DataFrame:
    """First finding of every rule: the rule list of a report."""
    rest = [c for c in ("severity", "kind", "message", "confidence") if c in found.columns]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return found.groupBy("rule_id").agg(first.alias("r")).select("rule_id", *(F.col(f"r.{c}").alias(c) for c in rest))


def sarif_rules(found: DataFrame) -> DataFrame:
    first = rule_first(found)
    return first.select("rule_id", F.to_json(F.struct(
        F.col("rule_id").alias("id"), F.col("rule_id").alias("name"),
        F.struct(F.col("message").alias("text")).alias("shortDescription"),
        F.struct(
            F.col("kind"), sarif_severity(F.col("severity")).alias("security-severity"),
            sarif_precision(F.col("confidence")).alias("precision"),
            F.array(F.lit("security"), F.col("kind")).alias("tags"),
        ).alias("properties"),
    )).alias("rule"))


def sarif_results(found: DataFrame, include_value_hash: bool = False) -> DataFrame:
    extra = [F.col("value_hash").alias("valueHash")] if include_value_hash else []
    location = F.struct(F.struct(
        F.struct(F.col("file").alias("uri")).alias("artifactLocation"),
        F.struct(
            F.greatest("line", F.lit(1)).alias("startLine"), F.greatest("column", F.lit(1)).alias("startColumn")
        ).alias("region"),
    ).alias("physicalLocation"))
    return found.select("*", F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"), F.array(location).alias("locations"),
        F.struct("severity", "kind", "confidence", F.col("redacted_value").alias("redactedValue"), *extra)
        .alias("properties"),
    )).alias("result"))


# -- allowlist suggestions -----------------------------------------------------


def allowlist_candidates(found: DataFrame) -> DataFrame:
    return found.where(
        (F.col("severity") != "info") & (F.col("kind") != "ignore")
        & ~F.col("rule_id").startswith("scan.") & ~F.col("rule_id").startswith("policy.")
    )


def allowlist_suggestions(found: DataFrame, value_hash: bool = False, reason: str | None = None,
                          expires: str | None = None) -> DataFrame:
    """Distinct entries that would accept the findings, in text order."""
    rows = allowlist_candidates(found).select(
        "rule_id", path_fn.glob_escape(F.col("file")).alias("path"), *(["value_hash"] if value_hash else [])
    ).distinct()
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    parts = [F.lit("[[allowlist]]")]
    for name in rows.columns:
        parts.append(F.concat(F.lit(f"{name} = "), quote(F.col(name))))
    parts.append(F.concat(F.lit("reason = "), quote(F.lit(reason or "TODO: explain why this finding is safe"))))
    if expires:
        parts.append(F.concat(F.lit("expires = "), quote(F.lit(expires))))
    return rows.withColumn("entry", F.concat(F.concat_ws("\n", *parts), F.lit("\n"))).orderBy("entry")
