"""Analytics over audit logs: newline-delimited JSON of scan and guard events.

Entries are schema-on-read, so a line becomes a variant and typed columns are
taken from it. Lines that do not parse or are over-long are counted, not lost.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..policy import SEVERITIES
from .detect import severity_rank
from .report import rank_name

# --- fixed values ------------------------------------------------------------
MAX_LINE_BYTES = 64 * 1024
BLOCKED = "blocked"
REASON_THRESHOLD = "finding_threshold"
REASON_GUARD = "action_guard"
PUSH_ACTION = "secrets.push"
MAX_FIELD_BYTES = 200

STRING_FIELDS = (
    "ts", "event", "tool", "hook", "reason", "action", "action_category", "display_path", "max_severity",
)
COUNT_FIELDS = ("finding_count", "suppressed_total", "deduplicated_total")
LIST_FIELDS = ("rule_ids", "kinds")


def _field(entry: Column, name: str) -> Column:
    return F.try_variant_get(entry, f"$.{name}", "variant")


def text_field(entry: Column, name: str) -> Column:
    """A field's value when it is a JSON string, else null."""
    return F.when(
        F.schema_of_variant(_field(entry, name)) == "STRING", F.try_variant_get(entry, f"$.{name}", "string")
    )


def count_field(entry: Column, name: str) -> Column:
    return F.when(
        F.schema_of_variant(_field(entry, name)) == "BIGINT", F.try_variant_get(entry, f"$.{name}", "bigint")
    )


def list_field(entry: Column, name: str) -> Column:
    """String elements of an array field; other elements are skipped."""
    values = F.try_variant_get(entry, f"$.{name}", "array<variant>")
    return F.transform(
        F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"),
        lambda v: F.try_variant_get(v, "$", "string"),
    )


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log lines to typed entries; ``parse_error`` marks lines that are not entries."""
    line = F.col(column)
    keep = [c for c in lines.columns if c != column]
    entry = F.when(F.octet_length(line) <= MAX_LINE_BYTES, F.try_parse_json(line))
    parsed = lines.where(F.trim(line) != "").select(*keep, entry.alias("entry"))
    e = F.col("entry")
    return parsed.select(
        *keep,
        e.isNull().alias("parse_error"),
        *(text_field(e, n).alias(n) for n in STRING_FIELDS),
        *(count_field(e, n).alias(n) for n in COUNT_FIELDS),
        *(list_field(e, n).alias(n) for n in LIST_FIELDS),
        (_field(e, "tool").isNotNull() & _field(e, "hook").isNotNull()).alias("is_hook"),
        timestamp(text_field(e, "ts")).alias("time"),
    )


def timestamp(ts: Column) -> Column:
    """RFC 3339 time, null when it is not one."""
    shaped = ts.rlike(r"\A\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)\z")
    return F.when(shaped, F.try_to_timestamp(F.upper(ts)))


def entries(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("parse_error")).drop("parse_error")


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if("parse_error").alias("parse_errors"), F.count_if(~F.col("parse_error")).alias("entries"))


def since_cutoff(spec: str, now: datetime | None = None) -> datetime:
    """``7d``, ``24h``, ``30m`` or ``2w`` before now."""
    found = re.fullmatch(r"([0-9]+)([A-Za-z]+)", spec.strip())
    if not found or int(found[1]) <= 0:
        raise ValueError(f"since must look like 7d, 24h or 30m, not {spec!r}")
    units = {
        "minutes": ("m", "min", "mins"), "hours": ("h", "hr", "hrs"), "days": ("d", "day", "days"),
        "weeks": ("w", "wk", "week", "weeks"),
    }
    for unit, names in units.items():
        if found[2].lower() in names:
            return (now or datetime.now(UTC)) - timedelta(**{unit: int(found[1])})
    raise ValueError(f"unsupported unit in {spec!r} (use m, h, d or w)")


def matches_filters(tool: str | None = None, reason: str | None = None) -> Column:
    test = F.lit(True)
    if tool is not None:
        test = test & F.col("tool").eqNullSafe(tool)
    if reason == BLOCKED:
        test = test & F.col("event").eqNullSafe(BLOCKED)
    elif reason is not None:
        test = test & F.col("reason").eqNullSafe(reason)
    return test


def filtered(log: DataFrame, *, tool: str | None = None, reason: str | None = None,
             cutoff: datetime | str | None = None) -> DataFrame:
    """Entries by tool, reason and age; entries without a valid time drop out of an age filter."""
    out = log.where(matches_filters(tool, reason))
    if cutoff is not None:
        out = out.where(F.col("time") >= F.lit(cutoff).cast("timestamp"))
    return out


def skipped_by_time(log: DataFrame, *, tool: str | None = None, reason: str | None = None) -> DataFrame:
    """How many entries an age filter cannot place in time."""
    return log.where(matches_filters(tool, reason)).agg(F.count_if(F.col("time").isNull()).alias("skipped"))


def _class() -> Column:
    """Blocked first, then pushes, then hook audits; each entry counts once."""
    return (
        F.when(F.col("event").eqNullSafe(BLOCKED), "blocked")
        .when(F.col("action").eqNullSafe(PUSH_ACTION), "push")
        .when(F.col("is_hook"), "hook")
    )


def summary(log: DataFrame) -> DataFrame:
    known = F.lower(F.trim("max_severity")).isin(*SEVERITIES)
    rank = F.max(F.when(known, severity_rank(F.lower(F.trim("max_severity")))))
    kind = _class()
    return log.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(kind == "blocked").alias("blocked_events"),
        F.count_if(kind == "hook").alias("hook_audit_events"),
        F.count_if(kind == "push").alias("secrets_push_events"),
        rank_name(rank).alias("max_severity"),
    )


def count_rows(log: DataFrame, label: Column) -> DataFrame:
    """Counts per label, most frequent first, ties by label."""
    return (
        log.select(label.alias("label")).where(F.col("label").isNotNull())
        .groupBy("label").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "label")
    )


def by_rule(log: DataFrame) -> DataFrame:
    return count_rows(log.select(F.explode("rule_ids").alias("rule_id")), F.col("rule_id"))


def by_field(log: DataFrame, field: str) -> DataFrame:
    return count_rows(log, F.col(field))


def recent(log: DataFrame, limit: int = 10, hide_paths: bool = False) -> DataFrame:
    """Newest entries. ``limit`` of a sort is a top-k in every partition first."""
    reason = F.coalesce(
        "reason", F.when(F.col("action") == PUSH_ACTION, PUSH_ACTION), F.when(F.col("is_hook"), "hook_audit")
    )
    path = F.lit(None).cast("string") if hide_paths else F.col("display_path")
    empty_null = lambda c: F.when(F.size(c) > 0, F.col(c))
    return (
        log.where(_class().isNotNull())
        .select(
            F.coalesce("ts", F.lit("-")).alias("ts"), "event", "tool", "hook", reason.alias("reason"),
            "max_severity", "action_category", path.alias("display_path"), "finding_count",
            empty_null("rule_ids").alias("rule_ids"), empty_null("kinds").alias("kinds"),
            "suppressed_total", "deduplicated_total",
        )
        .orderBy(F.desc("ts"), "tool", "hook", "reason", "display_path").limit(limit)
    )


# -- rows for the log -----------------------------------------------------------


def blocked_events(found: DataFrame, threshold_rank: int, by: list[str]) -> DataFrame:
    """One entry per event from its findings: what reached the threshold."""
    blocking = found.where(severity_rank(F.col("severity")) >= threshold_rank)
    return blocking.groupBy(*by).agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.sort_array(F.collect_set("rule_id")).alias("rule_ids"),
        F.sort_array(F.collect_set("kind")).alias("kinds"),
        rank_name(F.max(severity_rank(F.col("severity")))).alias("max_severity"),
    )


def entry_json(events: DataFrame, *, tool: str, hook: str, reason: str, time: Column | None = None) -> DataFrame:
    """Metadata-only log lines; matched values never appear."""
    fixed = [
        F.lit(BLOCKED).alias("event"), F.lit(tool).alias("tool"), F.lit(hook).alias("hook"),
        F.lit(reason).alias("reason"),
    ]
    stamp = [] if time is None else [time.alias("ts")]
    names = [c for c in ("display_path", "finding_count", "suppressed_total", "deduplicated_total", "max_severity",
                         "rule_ids", "kinds", "action_category") if c in events.columns]
    keep = [c for c in events.columns if c not in names]
    return events.select(*keep, F.to_json(F.struct(*stamp, *fixed, *names)).alias("value"))


def append_entries(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path)


def narrow(log: DataFrame, keep: list[str]) -> DataFrame:
    """The few short fields a notification may show; long values are dropped."""
    short = lambda n: F.when(F.octet_length(n) <= MAX_FIELD_BYTES, F.col(n)).alias(n)
    return log.where(F.col("event").eqNullSafe(BLOCKED)).select(
        *keep, *(short(n) for n in ("tool", "reason", "action_category"))
    )
