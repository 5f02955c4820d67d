"""The scan: detection, suppression, duplicates and findings.

``scan_rows`` keeps one row per document and rule; everything up to here is a
narrow map. ``findings`` explodes it. Duplicates of a document and rule lie in
one array, so removing them needs no shuffle either; ``dedup`` does the same for
finding rows that come from somewhere else.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..policy import Policy
from . import detect, suppress

REDACTED = "[REDACTED]"


def scan_rows(
    df: DataFrame,
    policy: Policy = Policy(),
    *,
    text: str = "text",
    path: str = "path",
    carry: list[str] | None = None,
    rules=None,
    inline: str = "honored",
    trusted: str | None = None,
    today: date | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """Documents to (document, rule) rows with kept matches and counters.

    ``inline`` is ``honored``, ``ignored`` or ``trusted``; in the last case the
    column named by ``trusted`` holds the stored text whose markers count.
    """
    ignores = None
    if carry is None:
        carry = [c for c in df.columns if c != text]
    if policy.apply_suppressions and inline != "ignored":
        stored = None
        if inline == "trusted":
            df = df.withColumn("__trusted", F.coalesce(F.col(trusted), F.lit("")))
            stored = F.col("__trusted")
        ignores = suppress.inline_directives(F.col("__text"), policy.ignore_keyword, stored)
        if stored is not None:
            carry = [*carry, "__trusted"]
    rows = detect.hits(
        df, policy, text=text, path=path, carry=carry, rules=rules, ignores=ignores, keep_text=keep_text
    )

    def kept(m: Column) -> Column:
        gone = F.lit(False)
        if ignores is not None:
            gone = gone | suppress.ignored(F.col("__ignores"), m["line"], F.col("rule_id"))
        if policy.apply_suppressions and policy.allowlist:
            gone = gone | suppress.allowlisted(
                F.col("file"), F.col("rule_id"), m["value_hash"], policy.allowlist, today
            )
        return ~gone

    out = [c for c in rows.columns if c not in ("matches", "__ignores", "__trusted")]
    state = arrays.let(
        F.col("matches"),
        lambda ms: arrays.let(
            F.filter(ms, kept),
            lambda ks: F.struct(
                arrays.first_by(ks, lambda m: m["value_hash"], lambda m: m["start"]).alias("found"),
                F.size(ms).alias("n_matches"),
                F.size(ks).alias("n_kept"),
            ),
        ),
    )
    return rows.select(*out, state.alias("__s")).select(
        *out, F.col("__s.found").alias("found"), F.col("__s.n_matches").alias("n_matches"),
        (F.col("__s.n_matches") - F.col("__s.n_kept")).alias("suppressed"),
        (F.col("__s.n_kept") - F.size("__s.found")).alias("deduplicated"),
    )


def findings(rows: DataFrame, *, raw: bool = False) -> DataFrame:
    """One row per finding. The matched text itself stays out unless ``raw``."""
    drop = {"found", "n_matches", "suppressed", "deduplicated", "number"}
    keep = [c for c in rows.columns if c not in drop]
    exploded = rows.select(*keep, F.explode_outer("found").alias("m")).where(F.col("m").isNotNull())
    return exploded.select(
        *keep, F.col("m.line").alias("line"), F.col("m.column").alias("column"),
        F.lit(REDACTED).alias("redacted_value"), F.col("m.value_hash").alias("value_hash"),
        F.col("m.start").alias("start"), *([F.col("m.value").alias("value")] if raw else []),
    )


def scan(df: DataFrame, policy: Policy = Policy(), **options) -> DataFrame:
    """Documents in, findings out."""
    return findings(scan_rows(df, policy, **options))


def dedup(found: DataFrame, keys=("doc_id",), order=("line", "column")) -> DataFrame:
    """First finding per document, rule and value hash of a table of findings.

    A hash aggregation: equal findings meet in the map-side combine, so one very
    frequent value does not end up in one task.
    """
    by = [*keys, "rule_id", "value_hash"]
    rest = [c for c in found.columns if c not in by]
    first = F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("__first")
    return found.groupBy(*by).agg(first, F.count(F.lit(1)).alias("occurrences")).select(
        *by, *(F.col(f"__first.{c}").alias(c) for c in rest), "occurrences"
    )


def totals(rows: DataFrame) -> DataFrame:
    """Counters of a scan over ``scan_rows`` output."""
    return rows.agg(
        F.coalesce(F.sum(F.size("found")), F.lit(0)).cast("long").alias("findings"),
        F.coalesce(F.sum("suppressed"), F.lit(0)).cast("long").alias("suppressed"),
        F.coalesce(F.sum("deduplicated"), F.lit(0)).cast("long").alias("deduplicated"),
    )


def stream_dedup(found: DataFrame, watermark: str, time: str = "ts", keys=("doc_id",)) -> DataFrame:
    """Streaming form of ``dedup`` with bounded state."""
    return found.withWatermark(time, watermark).dropDuplicatesWithinWatermark([*keys, "rule_id", "value_hash"])


def first_rows(df: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    """First ``n`` rows per group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
