"""Queries over audit logs derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from .kit import REGISTRY, derived, for_oracle

# event_type decides what kind of entry an event becomes; every field is text in the JSON line
LOG = """
SELECT event_id, user_id, CASE
  WHEN value > 99 THEN concat('{"ts": "', cast(event_id as string))
  WHEN event_type = 'error' THEN concat('{"ts":"', replace(substr(cast(ts as string), 1, 19), ' ', 'T'), 'Z","event":"blocked","tool":"cursor","hook":"pre","reason":"finding_threshold","display_path":"src/u', cast(user_id as string), '.py","finding_count":', cast(user_id % 7 as string), ',"max_severity":"', CASE WHEN value > 50 THEN 'critical' WHEN value > 10 THEN 'high' ELSE 'odd' END, '","rule_ids":["pii.email",', cast(user_id as string), CASE WHEN value > 20 THEN ',"secret.jwt"' ELSE '' END, '],"kinds":["pii"]}')
  WHEN event_type = 'click' THEN concat('{"ts":"', replace(substr(cast(ts as string), 1, 19), ' ', 'T'), 'Z","event":"blocked","tool":"claude-code","hook":"pre","reason":"action_guard","action_category":"', CASE WHEN user_id % 2 = 0 THEN 'destructive_delete' ELSE 'secret_read' END, '"}')
  WHEN event_type = 'view' THEN concat('{"ts":"', replace(substr(cast(ts as string), 1, 19), ' ', 'T'), 'Z","tool":"codex","hook":"post","display_path":"doc.md","finding_count":0,"max_severity":null}')
  WHEN event_type = 'signup' THEN concat('{"ts":"bad ', cast(user_id as string), '","action":"secrets.push","tool":5}')
  ELSE concat('{"note":"x', cast(user_id as string), '","ts":"', replace(substr(cast(ts as string), 1, 19), ' ', 'T'), '+09:00","max_severity":"low"}')
END AS line FROM {events}
"""
CUTOFF = "2024-01-10T00:00:00Z"


def log_lines(spark, sf_dir):
    return derived(spark, sf_dir, LOG)


def parsed(spark, sf_dir):
    return audit.parse_lines(log_lines(spark, sf_dir), "line")


def log(spark, sf_dir):
    return audit.entries(parsed(spark, sf_dir))


def _text(name: str) -> str:
    return f"CASE WHEN json_type(line, '$.{name}') = 'VARCHAR' THEN json_extract_string(line, '$.{name}') END AS {name}"


RANK = "list_position(['info','low','medium','high','critical'], {})"
ENTRIES = f"""
raw AS ({for_oracle(LOG)}),
good AS (SELECT event_id, user_id, CASE WHEN json_valid(line) THEN line END AS line FROM raw),
entries AS (
  SELECT event_id, user_id, {', '.join(_text(n) for n in audit.STRING_FIELDS)},
    cast(json_extract_string(line, '$.finding_count') AS BIGINT) AS finding_count,
    list_filter([CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') END
                 for x in cast(json_extract(line, '$.rule_ids') AS JSON[])], lambda x: x IS NOT NULL) AS rule_ids,
    list_filter([CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') END
                 for x in cast(json_extract(line, '$.kinds') AS JSON[])], lambda x: x IS NOT NULL) AS kinds,
    json_extract(line, '$.tool') IS NOT NULL AND json_extract(line, '$.hook') IS NOT NULL AS is_hook,
    try_cast(CASE WHEN regexp_matches(json_extract_string(line, '$.ts'), '^[0-9]{{4}}-.*T') THEN json_extract_string(line, '$.ts') END AS TIMESTAMPTZ) AS at_time
  FROM good WHERE line IS NOT NULL)"""
CLASS = "CASE WHEN event = 'blocked' THEN 'blocked' WHEN action = 'secrets.push' THEN 'push' WHEN is_hook THEN 'hook' END"


@REGISTRY.add("src_audit_log", f"WITH {ENTRIES} SELECT (SELECT count(*) FROM raw WHERE NOT json_valid(line)) AS parse_errors, count(*) AS entries FROM entries")
def src_audit_log(spark, sf_dir):
    return audit.parse_errors(parsed(spark, sf_dir))


@REGISTRY.add("flt_audit", f"""WITH {ENTRIES}
SELECT event_id, tool, reason, false AS undated FROM entries WHERE event = 'blocked' AND at_time >= TIMESTAMPTZ '{CUTOFF}'
UNION ALL SELECT event_id, tool, reason, true FROM entries WHERE at_time IS NULL""")
def flt_audit(spark, sf_dir):
    rows = log(spark, sf_dir)
    dated = audit.filtered(rows, reason="blocked", cutoff=CUTOFF)
    undated = rows.where(F.col("time").isNull())
    pick = lambda d, flag: d.select("event_id", "tool", "reason", F.lit(flag).alias("undated"))
    return pick(dated, False).unionByName(pick(undated, True))


@REGISTRY.add("agg_audit_summary", f"""WITH {ENTRIES} SELECT count(*) AS total_entries,
count(*) FILTER ({CLASS} = 'blocked') AS blocked_events, count(*) FILTER ({CLASS} = 'hook') AS hook_audit_events,
count(*) FILTER ({CLASS} = 'push') AS secrets_push_events,
['info','low','medium','high','critical'][max({RANK.format('max_severity')})] AS max_severity FROM entries""")
def agg_audit_summary(spark, sf_dir):
    return audit.summary(log(spark, sf_dir))


@REGISTRY.add("agg_audit_by_rule", f"""WITH {ENTRIES} SELECT label, count(*) AS "count" FROM (SELECT unnest(rule_ids) AS label FROM entries) GROUP BY label""")
def agg_audit_by_rule(spark, sf_dir):
    return audit.by_rule(log(spark, sf_dir))


for _key, _field in (("tool", "tool"), ("reason", "reason"), ("category", "action_category")):
    REGISTRY.put(
        f"agg_audit_by_{_key}",
        lambda spark, sf_dir, f=_field: audit.by_field(log(spark, sf_dir), f),
        f'WITH {ENTRIES} SELECT {_field} AS label, count(*) AS "count" FROM entries WHERE {_field} IS NOT NULL GROUP BY {_field}',
    )


@REGISTRY.add("srt_count_rows", f"""WITH {ENTRIES} SELECT display_path AS label, count(*) AS "count" FROM entries
WHERE display_path IS NOT NULL GROUP BY display_path ORDER BY 2 DESC, 1""")
def srt_count_rows(spark, sf_dir):
    return audit.by_field(log(spark, sf_dir), "display_path")


@REGISTRY.add("srt_recent", f"""WITH {ENTRIES} SELECT coalesce(ts, '-') AS ts, tool, hook,
coalesce(reason, CASE WHEN action = 'secrets.push' THEN action END, CASE WHEN is_hook THEN 'hook_audit' END) AS reason,
display_path FROM entries WHERE {CLASS} IS NOT NULL
ORDER BY coalesce(ts, '-') DESC, tool, hook, coalesce(reason, CASE WHEN action = 'secrets.push' THEN action END, CASE WHEN is_hook THEN 'hook_audit' END), display_path LIMIT 10""")
def srt_recent(spark, sf_dir):
    return audit.recent(log(spark, sf_dir), 10).select("ts", "tool", "hook", "reason", "display_path")


@REGISTRY.add("win_top_events", f"""WITH {ENTRIES} SELECT user_id, event_id, tool FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM entries WHERE event = 'blocked') WHERE rn <= 50""")
def win_top_events(spark, sf_dir):
    from ..operators.scan import first_rows

    blocked = log(spark, sf_dir).where(F.col("event") == audit.BLOCKED)
    return first_rows(blocked, ["user_id"], [F.desc("event_id")], 50).select("user_id", "event_id", "tool")
