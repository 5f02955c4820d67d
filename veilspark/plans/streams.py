"""Queries that run as streams over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from ..operators.detect import severity_rank
from ..rules.table import builtin
from ..streaming import jobs
from . import audit as audit_plans
from .audit import ENTRIES, LOG
from .kit import REGISTRY, for_oracle, table, value_hash_sql


def _events(spark, sf_dir):
    return jobs.read_table(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)


def _lines(spark, sf_dir):
    _events(spark, sf_dir).createOrReplaceTempView("veil_events_stream")
    return spark.sql(LOG.replace("{events}", "veil_events_stream"))


MESSAGES = "SELECT event_id, user_id, cast(ts AS timestamp) AS ts, 'event.txt' AS path, concat('from user', cast(user_id as string), '@mail.test ', props, ' to 10.0.0.', cast(user_id % 250 as string)) AS text FROM {events}"
RULES = [r for r in builtin() if r.rule_id in ("pii.email", "pii.ipv4")]


def _messages(spark, sf_dir):
    _events(spark, sf_dir).createOrReplaceTempView("veil_events_stream")
    return spark.sql(MESSAGES.replace("{events}", "veil_events_stream"))


@REGISTRY.add("str_scan_events", f"""WITH m AS ({for_oracle(MESSAGES)}),
v AS (SELECT event_id, 'pii.email' AS rule_id, 'block' AS decision, concat('user', user_id, '@mail.test') AS value FROM m
UNION ALL SELECT event_id, 'pii.ipv4', 'allow', concat('10.0.0.', user_id % 250) FROM m)
SELECT event_id, rule_id, decision, CASE rule_id WHEN 'pii.email' THEN {value_hash_sql('pii.email', 'value')} ELSE {value_hash_sql('pii.ipv4', 'value')} END AS value_hash FROM v""")
def str_scan_events(spark, sf_dir):
    found = jobs.scan_stream(_messages(spark, sf_dir), carry=["event_id"], rules=RULES)
    decided = found.select(
        "event_id", "rule_id", F.when(severity_rank(F.col("severity")) >= 2, "block").otherwise("allow").alias("decision"),
        "value_hash")
    return jobs.run_to_folder(decided)


@REGISTRY.add("str_tail_blocked", f"WITH {ENTRIES} SELECT event_id, tool, reason FROM entries WHERE event = 'blocked' AND at_time >= TIMESTAMPTZ '{audit_plans.CUTOFF}'")
def str_tail_blocked(spark, sf_dir):
    rows = jobs.tail_blocked(_lines(spark, sf_dir), "line", F.lit(audit_plans.CUTOFF).cast("timestamp"))
    return jobs.run_to_folder(rows.select("event_id", "tool", "reason"))


@REGISTRY.add("str_narrow_fields", f"WITH {ENTRIES} SELECT event_id, tool, reason, action_category FROM entries WHERE event = 'blocked'")
def str_narrow_fields(spark, sf_dir):
    rows = audit.entries(audit.parse_lines(_lines(spark, sf_dir), "line"))
    return jobs.run_to_folder(audit.narrow(rows, ["event_id"]))


@REGISTRY.add("str_bad_lines", f"WITH {ENTRIES} SELECT event_id FROM entries")
def str_bad_lines(spark, sf_dir):
    rows = audit.entries(audit.parse_lines(_lines(spark, sf_dir), "line"))
    return jobs.run_to_folder(rows.select("event_id"))


@REGISTRY.add("str_cap_newest", f"""WITH {ENTRIES} SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
FROM entries WHERE event = 'blocked') WHERE rn <= 50""")
def str_cap_newest(spark, sf_dir):
    rows = jobs.tail_blocked(_lines(spark, sf_dir), "line").select("user_id", "event_id")
    return jobs.run_to_folder(rows, steps=jobs.cap_newest("user_id", "event_id"))


@REGISTRY.add("str_retention", "SELECT count(*) AS n FROM events")
def str_retention(spark, sf_dir):
    """A backlog is read in bounded batches; nothing is lost between them."""
    bounded = jobs.read_table(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema, 1)
    return jobs.run_to_folder(bounded.select("event_id")).agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.add("str_audit_counts", f"""WITH {ENTRIES}
SELECT cast(date_trunc('hour', at_time) AS VARCHAR) AS window_start, tool, count(*) AS n FROM entries WHERE tool IS NOT NULL AND at_time IS NOT NULL GROUP BY ALL""")
def str_audit_counts(spark, sf_dir):
    rows = audit.entries(audit.parse_lines(_lines(spark, sf_dir), "line"))
    counts = jobs.run_to_folder(rows.select("tool", "time"), steps=jobs.audit_counts())
    return counts.select(F.concat(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), F.lit("+00")).alias("window_start"), "tool", "n")


@REGISTRY.add("str_dedup", f"""WITH m AS (SELECT DISTINCT user_id FROM ({for_oracle(MESSAGES)}))
SELECT user_id, 'pii.email' AS rule_id, {value_hash_sql('pii.email', "concat('user', user_id, '@mail.test')")} AS value_hash FROM m
UNION ALL SELECT user_id, 'pii.ipv4', {value_hash_sql('pii.ipv4', "concat('10.0.0.', user_id % 250)")} FROM m""")
def str_dedup(spark, sf_dir):
    found = jobs.scan_stream(_messages(spark, sf_dir), carry=["user_id"], rules=RULES)
    keys = ["user_id", "rule_id", "value_hash"]
    return jobs.run_to_folder(found.select(*keys), steps=jobs.once(keys))
