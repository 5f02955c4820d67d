"""Queries for whole scans, suppression, joins, summaries and report sinks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import paths as path_fn
from ..operators import audit, detect, report, scan, suppress
from ..policy import AllowEntry, Policy
from ..rules.table import builtin
from ..streaming.jobs import shared_folder
from . import detection
from .kit import (
    LINE_SQL, PLAIN_DOCUMENTS, REGISTRY, derived, for_oracle, located_sql, planted, table, value_hash_sql,
)
from .samples import Pool

_p = Pool("doc_id", "f")
MAIL = f"concat('user', {_p.digits(5)}, '@mail.example.test')"
LINE = (
    f"concat('mail ', {MAIL}, ' again ', {MAIL}, chr(10), 'key AKIA', upper({_p.take(16)}), "
    "CASE lang WHEN 'en' THEN ' # scan-ignore' WHEN 'fr' THEN ' // scan-ignore pii.email' ELSE '' END, chr(10), "
    "'# scan-ignore-next-line pii.ipv4', chr(10), 'host 10.1.2.', cast(doc_id % 200 as string), chr(10), "
    "'host 10.1.2.', cast(doc_id % 200 as string), chr(10), 'SSN ', "
    f"{_p.digits(3)}, '-', {_p.digits(2)}, '-', {_p.digits(4)})"
)
SRC = planted(LINE)
RULE_IDS = ("secret.aws_access_key", "pii.email", "pii.ipv4", "pii.en.ssn")
RULES = [r for r in builtin() if r.rule_id in RULE_IDS]
SEVERITY = {r.rule_id: r.severity for r in RULES}
ALLOW = (
    AllowEntry("pii.email", "src1/*", None, "test data", None),
    AllowEntry("pii.en.ssn", "**/*", None, None, "2020-01-01"),
    AllowEntry("pii.ipv4", "**/*.md", hashing.value_hash_py("pii.ipv4", "10.1.2.7"), None, "2999-12-31"),
    AllowEntry(None, "src{2,3}/**", hashing.value_hash_py("pii.ipv4", "10.1.2.9"), None, None),
)
TODAY = date(2026, 1, 1)
POLICY = Policy(allowlist=ALLOW)
PLAIN_POLICY = Policy()


def rows(spark, sf_dir, policy=PLAIN_POLICY, **kw):
    return scan.scan_rows(derived(spark, sf_dir, SRC), policy, carry=["doc_id"], rules=RULES, today=TODAY, **kw)


def found(spark, sf_dir, policy=PLAIN_POLICY, **kw):
    return scan.findings(rows(spark, sf_dir, policy, **kw))


# -- oracle pieces --------------------------------------------------------------
def matches_sql() -> str:
    """CTE ``matches``: every valid match of the four rules with line and hash."""
    parts = []
    ctes = []
    for i, rule in enumerate(RULES):
        chain = located_sql("SELECT * FROM docs", rule.re2)
        for name in ("src", "each_hit", "hit", "found"):
            chain = chain.replace(f"{name} AS", f"{name}{i} AS").replace(f"FROM {name}\n", f"FROM {name}{i}\n")
        chain = chain.replace("FROM src WHERE", f"FROM src{i} WHERE").replace("FROM hit WHERE", f"FROM hit{i} WHERE")
        chain = chain.replace("FROM each_hit)", f"FROM each_hit{i})")
        ctes.append(chain)
        parts.append(
            f"SELECT doc_id, path AS file, '{rule.rule_id}' AS rule_id, '{rule.severity}' AS severity, "
            f"'{rule.kind}' AS kind, {rule.confidence} AS confidence, '{rule.message}' AS message, start, value, "
            f'{LINE_SQL} AS line, {detection.COLUMN_SQL} AS "column", '
            f"{value_hash_sql(rule.rule_id, 'value')} AS value_hash FROM found{i} "
            f"WHERE {detection.CHECK_SQL.get(rule.rule_id, 'true')}"
        )
    return f"docs AS ({for_oracle(SRC)}), {', '.join(ctes)}, matches AS ({' UNION ALL '.join(parts)})"


DIRECTIVES = """
text_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM docs),
directives AS (
  SELECT doc_id, n + 1 AS line, nullif(regexp_extract(l, '^ *#+ *scan-ignore(?:-next-line)? *([^ ]*)', 1), '') AS rule FROM text_lines
    WHERE regexp_matches(l, '^ *# *scan-ignore')
  UNION ALL
  SELECT doc_id, n AS line, nullif(regexp_extract(l, '(?:#|//) *scan-ignore *([^ ]*)$', 1), '') AS rule FROM text_lines
    WHERE regexp_matches(l, '[^ ].*(?:#|//) *scan-ignore') AND NOT regexp_matches(l, '^ *# *scan-ignore'))"""
INLINE_OK = (
    "NOT EXISTS (SELECT 1 FROM directives d WHERE d.doc_id = m.doc_id AND d.line = m.line "
    "AND (d.rule IS NULL OR d.rule = m.rule_id))"
)
ALLOWED = f"""((m.rule_id = 'pii.email' AND m.file LIKE 'src1/%')
  OR (m.rule_id = 'pii.ipv4' AND m.file LIKE '%.md' AND m.value_hash = '{ALLOW[2].value_hash}')
  OR (regexp_matches(m.file, '^src(2|3)/') AND m.value_hash = '{ALLOW[3].value_hash}'))"""
BASE = f"WITH {matches_sql()}, {DIRECTIVES}"
KEPT = f"kept AS (SELECT * FROM matches m WHERE {INLINE_OK})"
FIRST = "first_found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id, value_hash ORDER BY start) AS rn FROM kept) WHERE rn = 1)"
FOUND = f"{BASE}, {KEPT}, {FIRST}"
RANK = "list_position(['info','low','medium','high','critical'], severity) - 1"

# -- full scan ------------------------------------------------------------------


def _all_rules_oracle() -> str:
    """Counts per rule over the documents as they are, every rule included."""
    parts = [
        f"SELECT '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, doc_id, value_hash FROM "
        f"({detection.rule_oracle(r, PLAIN_DOCUMENTS)})"
        for r in builtin() if r.source in ("tuned", "ai")
    ]
    parts.append(
        f"SELECT rule_id, 'high' AS severity, doc_id, value_hash FROM ({detection.provider_oracle(PLAIN_DOCUMENTS)})"
    )
    union = "\nUNION ALL\n".join(parts)
    return (
        "SELECT rule_id, severity, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM "
        f"(SELECT DISTINCT rule_id, severity, doc_id, value_hash FROM ({union})) GROUP BY rule_id, severity"
    )


@REGISTRY.add("scan_summary", _all_rules_oracle())
def scan_summary(spark, sf_dir):
    """Flagship: scan every document with every rule and count findings."""
    docs = derived(spark, sf_dir, PLAIN_DOCUMENTS)
    hits = scan.scan_rows(docs, PLAIN_POLICY, carry=["doc_id"])
    # a document and a rule make one row, so documents are counted without a distinct
    return (
        hits.groupBy("rule_id", "severity")
        .agg(
            F.sum(F.size("found")).cast("long").alias("findings"),
            F.sum(F.when(F.size("found") > 0, 1).otherwise(0)).cast("long").alias("documents"),
        )
        .where("findings > 0")
    )


@REGISTRY.add("src_documents", f"""{FOUND} SELECT doc_id, file, rule_id, line, "column", value_hash FROM first_found""")
def src_documents(spark, sf_dir):
    return found(spark, sf_dir).select("doc_id", "file", "rule_id", "line", "column", "value_hash")


# -- suppression ----------------------------------------------------------------
MARKERS = (
    "concat('a = 1  # scan-ignore', chr(10), '  # scan-ignore pii.email extra', chr(10), '// scan-ignore-next-line', chr(10), "
    "'x(); // scan-ignore-next-line rule.', cast(doc_id as string), chr(10), '<!-- scan-ignore pii.ipv4 -->', chr(10), "
    "'<p>t</p> <!-- scan-ignore -->', chr(10), '# scan-ignored not a marker', chr(10), 'text # about scan-ignore', chr(10), "
    "'y # note # scan-ignore r2')"
)
# the planted lines start after the document's own lines
_BASE_LINE = "length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1"
_EXPECTED = ((1, "CAST(NULL AS VARCHAR)"), (3, "'pii.email'"), (4, "CAST(NULL AS VARCHAR)"),
             (5, "concat('rule.', cast(doc_id as string))"), (6, "'pii.ipv4'"), (6, "CAST(NULL AS VARCHAR)"), (9, "'r2'"))


@REGISTRY.add("sup_inline_parse", " UNION ALL ".join(
    f"SELECT doc_id, cast({_BASE_LINE} + {n} AS INT) AS line, {rule} AS rule FROM documents" for n, rule in _EXPECTED))
def sup_inline_parse(spark, sf_dir):
    docs = derived(spark, sf_dir, planted(MARKERS))
    parsed = docs.select("doc_id", F.explode(suppress.inline_directives(F.col("text"), "scan-ignore")).alias("d"))
    return parsed.select("doc_id", "d.line", "d.rule")


@REGISTRY.add("join_inline_ignores", f"{BASE}, {KEPT} SELECT doc_id, rule_id, line, count(*) AS n FROM kept GROUP BY ALL")
def join_inline_ignores(spark, sf_dir):
    docs = derived(spark, sf_dir, SRC)
    hits = detect.hits(docs, carry=["doc_id"], rules=RULES,
                       ignores=suppress.inline_directives(F.col("__text"), "scan-ignore"))
    each = hits.select("doc_id", "rule_id", "__ignores", F.explode_outer("matches").alias("m")).where("m IS NOT NULL")
    kept = each.where(~suppress.ignored(F.col("__ignores"), F.col("m.line"), F.col("rule_id")))
    return kept.groupBy("doc_id", "rule_id", F.col("m.line").alias("line")).agg(F.count(F.lit(1)).alias("n"))


_STORED = "concat(coalesce(text, ''), chr(10), 'a # scan-ignore', chr(10), '# scan-ignore-next-line r1')"
_EDITED = (
    f"concat({_STORED}, chr(10), 'new # scan-ignore', chr(10), '-a # scan-ignore', chr(10), '# scan-ignore-next-line r1', "
    "chr(10), 'z')"
)
_TRUST = f"SELECT doc_id, {_EDITED} AS text, {_STORED} AS stored FROM {{documents}}"


@REGISTRY.add("join_trusted_markers", f"""SELECT doc_id, cast({_BASE_LINE} + k AS INT) AS line, CASE WHEN k IN (3, 6) THEN 'r1' END AS rule
FROM documents, (VALUES (1), (3), (4), (6)) t(k)""")
def join_trusted_markers(spark, sf_dir):
    docs = derived(spark, sf_dir, _TRUST)
    kept = suppress.inline_directives(F.col("text"), "scan-ignore", F.col("stored"))
    return docs.select("doc_id", F.explode(kept).alias("d")).select("doc_id", "d.line", "d.rule")


@REGISTRY.add("sup_inline_modes", f"""{BASE}, {KEPT}
SELECT 'honored' AS mode, count(*) AS kept FROM kept UNION ALL SELECT 'ignored', count(*) FROM matches""")
def sup_inline_modes(spark, sf_dir):
    def count(mode):
        hits = rows(spark, sf_dir, inline=mode)
        return hits.agg(F.sum(F.col("n_matches") - F.col("suppressed")).alias("kept")).select(
            F.lit(mode).alias("mode"), "kept"
        )

    return count("honored").unionByName(count("ignored"))


@REGISTRY.add("sup_allowlist", f"""WITH {matches_sql()} SELECT doc_id, rule_id, line, value_hash FROM matches m WHERE NOT {ALLOWED}""")
def sup_allowlist(spark, sf_dir):
    hits = detect.hits(derived(spark, sf_dir, SRC), carry=["doc_id"], rules=RULES)
    each = hits.select("doc_id", "file", "rule_id", F.explode_outer("matches").alias("m")).where("m IS NOT NULL")
    ok = ~suppress.allowlisted(F.col("file"), F.col("rule_id"), F.col("m.value_hash"), ALLOW, TODAY)
    return each.where(ok).select("doc_id", "rule_id", "m.line", "m.value_hash")


@REGISTRY.add("join_allowlist", f"""WITH {matches_sql()} SELECT doc_id, rule_id, line, value_hash FROM matches m WHERE NOT {ALLOWED}""")
def join_allowlist(spark, sf_dir):
    each = detect.matches(derived(spark, sf_dir, SRC), carry=["doc_id"], rules=RULES)
    allow = suppress.allowlist_table(spark, ALLOW, TODAY)
    return suppress.allowlist_join(each, allow).select("doc_id", "rule_id", "line", "value_hash")


ORDERED = f"{BASE}, {KEPT}, passed AS (SELECT * FROM kept m WHERE NOT {ALLOWED})"


@REGISTRY.add("sup_order", f"""{ORDERED} SELECT m.rule_id, count(*) AS matches,
count(*) - (SELECT count(*) FROM passed p WHERE p.rule_id = m.rule_id) AS suppressed,
(SELECT count(*) - count(DISTINCT (doc_id, value_hash)) FROM passed p WHERE p.rule_id = m.rule_id) AS deduplicated
FROM matches m GROUP BY m.rule_id""")
def sup_order(spark, sf_dir):
    return rows(spark, sf_dir, POLICY).groupBy("rule_id").agg(
        F.sum("n_matches").alias("matches"), F.sum("suppressed").alias("suppressed"),
        F.sum("deduplicated").alias("deduplicated"),
    )


_ALLOW_TABLE = """SELECT p_partkey AS entry, CASE WHEN p_size % 3 = 0 THEN p_name END AS rule_id,
CASE WHEN p_size % 2 = 0 THEN '**/*' ELSE concat(p_brand, '/**') END AS path,
CASE WHEN p_size % 5 = 0 THEN 'sha256-hmac:00' END AS value_hash,
CASE WHEN p_size < 10 THEN '2020-02-30' WHEN p_size < 20 THEN '2020-02-28' WHEN p_size < 30 THEN '2999-01-01' END AS expires,
p_type AS kind FROM {part}"""


@REGISTRY.add("det_policy_warnings", f"""WITH a AS ({for_oracle(_ALLOW_TABLE)}),
e AS (SELECT *, expires IS NOT NULL AND coalesce(try_strptime(expires, '%Y-%m-%d') < TIMESTAMP '2026-01-01', true) AS expired FROM a)
SELECT entry, 'policy.allowlist_expired' AS rule_id, 'low' AS severity, 'ignore' AS kind FROM e WHERE expired
UNION ALL SELECT entry, 'policy.allowlist_unknown_key', 'low', 'ignore' FROM e WHERE kind = 'ECONOMY'
UNION ALL SELECT entry, 'policy.allowlist_matches_everything', 'low', 'ignore' FROM e
WHERE path = '**/*' AND rule_id IS NULL AND value_hash IS NULL AND NOT expired""")
def det_policy_warnings(spark, sf_dir):
    allow = derived(spark, sf_dir, _ALLOW_TABLE).withColumn(
        "unknown", F.when(F.col("kind") == "ECONOMY", F.array(F.lit("owner")))
    )
    return suppress.policy_warning_table(allow, F.lit(TODAY))


# -- summaries ------------------------------------------------------------------
@REGISTRY.add("agg_by_severity", f"{FOUND} SELECT severity, count(*) AS n FROM first_found GROUP BY severity")
def agg_by_severity(spark, sf_dir):
    return report.by_severity(found(spark, sf_dir))


@REGISTRY.add("agg_max_severity", f"{FOUND} SELECT ['info','low','medium','high','critical'][max({RANK}) + 1] AS max_severity FROM first_found")
def agg_max_severity(spark, sf_dir):
    return report.max_severity(found(spark, sf_dir))


@REGISTRY.add("agg_should_fail", f"{FOUND} SELECT bool_or({RANK} >= 3) AS should_fail FROM first_found")
def agg_should_fail(spark, sf_dir):
    return report.should_fail(found(spark, sf_dir), "high")


@REGISTRY.add("agg_scan_totals", f"""{FOUND} SELECT (SELECT count(*) FROM first_found) AS findings,
(SELECT count(*) FROM matches) - (SELECT count(*) FROM kept) AS suppressed,
(SELECT count(*) FROM kept) - (SELECT count(*) FROM first_found) AS deduplicated""")
def agg_scan_totals(spark, sf_dir):
    return scan.totals(rows(spark, sf_dir))


@REGISTRY.add("agg_dedup", f"""WITH {matches_sql()} SELECT doc_id, rule_id, value_hash, min(line) AS line, count(*) AS occurrences
FROM matches GROUP BY doc_id, rule_id, value_hash""")
def agg_dedup(spark, sf_dir):
    each = detect.matches(derived(spark, sf_dir, SRC), carry=["doc_id"], rules=RULES)
    return scan.dedup(each.select("doc_id", "rule_id", "value_hash", "line", "column")).select(
        "doc_id", "rule_id", "value_hash", "line", "occurrences"
    )


@REGISTRY.add("agg_rule_first", f"""{FOUND} SELECT rule_id, any_value(severity) AS severity, any_value(kind) AS kind,
any_value(message) AS message FROM first_found GROUP BY rule_id""")
def agg_rule_first(spark, sf_dir):
    return report.rule_first(found(spark, sf_dir)).select("rule_id", "severity", "kind", "message")


@REGISTRY.add("agg_blocked_event", f"""{FOUND} SELECT doc_id, count(*) AS finding_count, list_sort(list_distinct(list(rule_id))) AS rule_ids,
list_sort(list_distinct(list(kind))) AS kinds, ['info','low','medium','high','critical'][max({RANK}) + 1] AS max_severity
FROM first_found WHERE {RANK} >= 2 GROUP BY doc_id""")
def agg_blocked_event(spark, sf_dir):
    return audit.blocked_events(found(spark, sf_dir), 2, ["doc_id"])


@REGISTRY.add("flt_min_severity", f"{FOUND} SELECT doc_id, rule_id, line FROM first_found WHERE {RANK} >= 2")
def flt_min_severity(spark, sf_dir):
    return report.at_least(found(spark, sf_dir), "medium").select("doc_id", "rule_id", "line")


@REGISTRY.add("srt_config_findings", f"{FOUND} SELECT severity, file, rule_id, message FROM first_found ORDER BY {RANK} DESC, file, rule_id, message")
def srt_config_findings(spark, sf_dir):
    rank = detect.severity_rank(F.col("severity"))
    return found(spark, sf_dir).orderBy(rank.desc(), "file", "rule_id", "message").select(
        "severity", "file", "rule_id", "message"
    )


@REGISTRY.add("set_union_generators", f"WITH {matches_sql()} SELECT rule_id, count(*) AS n FROM matches GROUP BY rule_id")
def set_union_generators(spark, sf_dir):
    """The per-rule form: one generator per rule, united by name."""
    docs = derived(spark, sf_dir, SRC)
    parts = [detect.matches(docs, carry=["doc_id"], rules=[r]).select("doc_id", "rule_id") for r in RULES]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


# -- sinks ----------------------------------------------------------------------
@REGISTRY.add("sink_report", f"""{FOUND} SELECT doc_id, concat('{{"rule_id":"', rule_id, '","severity":"', severity, '","kind":"', kind, '","file":"', file,
'","line":', line, ',"column":', "column", ',"message":"', message, '","redacted_value":"[REDACTED]","confidence":', cast(confidence AS DOUBLE), '}}') AS finding FROM first_found""")
def sink_report(spark, sf_dir):
    """The whole report, head and findings, is written; what is returned are the findings as they are read back."""
    folder = shared_folder(spark)
    scanned = rows(spark, sf_dir)
    scanned.write.parquet(f"{folder}/rows")
    report.write_report(spark.read.schema(scanned.schema).parquet(f"{folder}/rows"), f"{folder}/report", carry=("doc_id",))
    _, findings = report.read_report(spark, f"{folder}/report", "doc_id long")
    return findings


@REGISTRY.add("sink_sarif", f"""{FOUND} SELECT doc_id, concat('{{"ruleId":"', rule_id, '","level":"', CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END,
'","message":{{"text":"', message, '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"', file, '"}},"region":{{"startLine":', line, ',"startColumn":', "column",
'}}}}}}],"properties":{{"severity":"', severity, '","kind":"', kind, '","confidence":', cast(confidence AS DOUBLE), ',"redactedValue":"[REDACTED]"}}}}') AS result FROM first_found""")
def sink_sarif(spark, sf_dir):
    return report.sarif_results(found(spark, sf_dir)).select("doc_id", "result")


_SUGGEST = f"""{FOUND} SELECT DISTINCT rule_id, path, concat('[[allowlist]]', chr(10), 'rule_id = "', rule_id, '"', chr(10), 'path = "', path, '"', chr(10),
'reason = "reviewed"', chr(10)) AS entry FROM (SELECT *, concat(replace(replace(file, '[', '[[]'), '*', '[*]')) AS path FROM first_found)"""


@REGISTRY.add("sink_allowlist_suggest", _SUGGEST)
def sink_allowlist_suggest(spark, sf_dir):
    return report.allowlist_suggestions(found(spark, sf_dir), reason="reviewed")


@REGISTRY.add("set_distinct_suggestions", f"{FOUND} SELECT count(*) AS n FROM (SELECT DISTINCT rule_id, file, value_hash FROM first_found)")
def set_distinct_suggestions(spark, sf_dir):
    return report.allowlist_suggestions(found(spark, sf_dir), value_hash=True).agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.add("sink_audit_append", f"""{FOUND} SELECT doc_id, concat('{{"event":"blocked","tool":"codex","hook":"pre","reason":"finding_threshold","finding_count":', count(*),
',"max_severity":"', ['info','low','medium','high','critical'][max({RANK}) + 1], '","rule_ids":["', array_to_string(list_sort(list_distinct(list(rule_id))), '","'), '"],"kinds":["', array_to_string(list_sort(list_distinct(list(kind))), '","'), '"]}}') AS value
FROM first_found WHERE {RANK} >= 2 GROUP BY doc_id""")
def sink_audit_append(spark, sf_dir):
    events = audit.blocked_events(found(spark, sf_dir), 2, ["doc_id"])
    return audit.entry_json(events, tool="codex", hook="pre", reason=audit.REASON_THRESHOLD)


# -- sources over tables ----------------------------------------------------------
_BLOBS = """SELECT doc_id AS commit_no, doc_id AS seq, md5(text) AS oid, concat(source, '/', md5(text), CASE lang WHEN 'es' THEN '.png' ELSE '.txt' END) AS path,
length(text) AS size FROM {documents}"""


@REGISTRY.add("src_history_blobs", f"""SELECT oid, commit_no, path FROM (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY seq) AS rn
FROM ({for_oracle(_BLOBS)}) WHERE path NOT LIKE '%.png') WHERE rn = 1""")
def src_history_blobs(spark, sf_dir):
    from ..sources.history import first_paths

    return first_paths(derived(spark, sf_dir, _BLOBS), PLAIN_POLICY).select("oid", "commit_no", "path")


@REGISTRY.add("src_history_preview", f"""SELECT count(DISTINCT commit_no) AS candidate_commits, count(*) AS candidate_paths, count(DISTINCT oid) AS unique_blobs,
count(DISTINCT CASE WHEN path NOT LIKE '%.png' THEN oid END) AS filtered_blobs FROM ({for_oracle(_BLOBS)})""")
def src_history_preview(spark, sf_dir):
    from ..sources.history import preview

    return preview(derived(spark, sf_dir, _BLOBS), PLAIN_POLICY)


_CHANGED = "SELECT DISTINCT concat(source, '/', cast(doc_id as string), CASE lang WHEN 'en' THEN '.py' ELSE '.txt' END) AS path FROM {documents} WHERE n_chars > 1000"
for _key in ("src_changed_only", "join_changed"):
    REGISTRY.put(
        _key,
        lambda spark, sf_dir: derived(spark, sf_dir, PLAIN_DOCUMENTS).join(
            derived(spark, sf_dir, _CHANGED), "path", "left_semi").select("doc_id", "path"),
        f"SELECT doc_id, path FROM ({for_oracle(PLAIN_DOCUMENTS)}) WHERE path IN ({for_oracle(_CHANGED)})",
    )


_TRACKED = "SELECT doc_id AS identity, concat({p}, source, '/', cast(doc_id as string)) AS path FROM {documents} WHERE {w}"


@REGISTRY.add("src_tracked_union", """SELECT doc_id AS identity, concat(CASE WHEN lang = 'de' THEN 'index/' ELSE 'tree/' END, source, '/', cast(doc_id as string)) AS path
FROM documents WHERE lang IN ('en', 'fr', 'de')""")
def src_tracked_union(spark, sf_dir):
    from ..sources.files import with_tracked

    walked = derived(spark, sf_dir, _TRACKED.replace("{p}", "'tree/'").replace("{w}", "lang IN ('en', 'fr')"))
    tracked = derived(spark, sf_dir, _TRACKED.replace("{p}", "'index/'").replace("{w}", "lang IN ('fr', 'de')"))
    return with_tracked(walked, tracked)


# -- path and rule filters --------------------------------------------------------
_PATHS = """SELECT p_partkey AS id, concat(replace(p_name, ' ', '/'), '/', CASE p_size % 8 WHEN 0 THEN 'Dockerfile' WHEN 1 THEN 'app.PY' WHEN 2 THEN '.env.local'
WHEN 3 THEN '.env.example' WHEN 4 THEN 'logo.svg' WHEN 5 THEN 'dist/x.js' WHEN 6 THEN 'prod.env' ELSE 'makefile.inc' END) AS path FROM {part}"""
GLOBS_IN, GLOBS_OUT = ("**/*.{PY,js,env}", "red/**", "**/[.]env*"), ("**/*.svg", "**/dist/**")


@REGISTRY.add("flt_path_globs", f"""SELECT id, path FROM ({for_oracle(_PATHS)}) WHERE NOT (path LIKE '%.svg' OR path LIKE 'dist/%' OR path LIKE '%/dist/%')
AND (regexp_matches(path, '[.](PY|js|env)$') OR path LIKE 'red/%' OR regexp_matches(path, '(^|/)[.]env[^/]*$') OR regexp_matches(path, '(^|/)[.]env'))""")
def flt_path_globs(spark, sf_dir):
    return derived(spark, sf_dir, _PATHS).where(path_fn.path_allowed(F.col("path"), GLOBS_IN, GLOBS_OUT))


@REGISTRY.add("fn_glob_match", f"SELECT id, regexp_matches(path, '^(.*/)?[^/]*e.*[.]?.*env.*$') OR path LIKE '%ring%' AS hit FROM ({for_oracle(_PATHS)})")
def fn_glob_match(spark, sf_dir):
    test = path_fn.any_glob(F.col("path"), ["**/*e*env*", "*ring*"])
    return derived(spark, sf_dir, _PATHS).select("id", test.alias("hit"))


@REGISTRY.add("fn_glob_escape", "SELECT p_partkey AS id, concat(p_name, '[*]', '[?]', '[[]x]', '[{]', '[}]') AS path FROM part")
def fn_glob_escape(spark, sf_dir):
    raw = F.concat("p_name", F.lit("*?[x]{}"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), path_fn.glob_escape(raw).alias("path"))


@REGISTRY.add("flt_env_path", f"SELECT id, path FROM ({for_oracle(_PATHS)}) WHERE {detection.ENV_PATH_SQL}")
def flt_env_path(spark, sf_dir):
    return derived(spark, sf_dir, _PATHS).where(path_fn.is_env_path(F.col("path")))


@REGISTRY.add("prj_code_path", f"""SELECT id, regexp_matches(lower(path), '/(dockerfile|makefile[.][^/]*)$') OR regexp_matches(lower(path), '[.](py|js)$') AS is_code
FROM ({for_oracle(_PATHS)})""")
def prj_code_path(spark, sf_dir):
    return derived(spark, sf_dir, _PATHS).select("id", path_fn.is_code_path(F.col("path")).alias("is_code"))


@REGISTRY.add("prj_safe_label", "SELECT p_partkey AS id, concat('a?', p_name, '??') AS label, concat('a', chr(92), 'u{9}', p_name, '​', chr(92), 'u{1b}') AS escaped FROM part")
def prj_safe_label(spark, sf_dir):
    raw = F.concat(F.lit("a\t"), "p_name", F.lit("​\x1b"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), path_fn.safe_label(raw).alias("label"), path_fn.escape_control(raw).alias("escaped")
    )


_BOTH = planted("concat('ssn 123-45-', lpad(cast(doc_id % 9000 + 1000 as string), 4, '0'), chr(10), '氏名: 山田 太郎')")
_GATED = {"pii.en.ssn": "en", "pii.ja.name": "ja"}


@REGISTRY.add("flt_rule_gate", " UNION ALL ".join(
    f"SELECT '{'+'.join(langs)}' AS languages, '{rule}' AS rule_id, count(*) AS n FROM documents"
    for langs in (("en",), ("ja",), ("en", "ja")) for rule, lang in _GATED.items() if lang in langs))
def flt_rule_gate(spark, sf_dir):
    """The detector under policies of one and of both languages."""
    from ..rules.table import rules_for

    def found(langs):
        gated = [r for r in rules_for(Policy(pii_languages=langs)) if r.rule_id in _GATED]
        each = detect.matches(derived(spark, sf_dir, _BOTH), carry=["doc_id"], rules=gated)
        return each.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("+".join(langs)).alias("languages"), "rule_id", "n")

    return found(("en",)).unionByName(found(("ja",))).unionByName(found(("en", "ja")))


_PROVIDER_DOCS = detection.provider_source(spark=False)


def _candidate_oracle() -> str:
    rows = ", ".join(
        f"('{r.rule_id}', {detection.samples.quote(k)})" for r in detection.PROVIDERS for k in r.literals
    )
    return f"""WITH src AS (SELECT doc_id, lower(text) AS low FROM ({for_oracle(_PROVIDER_DOCS)})),
kw(rule_id, keyword) AS (VALUES {rows})
SELECT rule_id, count(DISTINCT doc_id) AS documents FROM src JOIN kw ON contains(low, keyword) GROUP BY rule_id"""


for _key in ("flt_keywords", "join_rule_candidates"):
    def _candidates(spark, sf_dir):
        from ..operators.candidates import rule_candidates

        docs = derived(spark, sf_dir, detection.provider_source(spark=True))
        pairs = rule_candidates(docs, detection.PROVIDERS)
        return pairs.groupBy("rule_id").agg(F.count(F.lit(1)).alias("documents"))

    REGISTRY.put(_key, _candidates, _candidate_oracle())


_TERRAFORM = planted(
    "concat('password = ', chr(34), lower(substr(md5(cast(doc_id as string)), 1, 12)), chr(34))",
    "concat(source, '/', cast(doc_id as string), CASE doc_id % 5 WHEN 0 THEN '.tf' WHEN 1 THEN '.HCL' WHEN 2 THEN '.py' WHEN 3 THEN '.tf.txt' ELSE '/tf' END)")


@REGISTRY.add("flt_rule_path", """SELECT doc_id, cast(2 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS INT) AS line
FROM documents WHERE doc_id % 5 IN (0, 1)""")
def flt_rule_path(spark, sf_dir):
    """A rule that applies to two kinds of files only."""
    rule = [r for r in builtin() if r.rule_id == "secret.gitleaks.hashicorp-tf-password"]
    return detect.matches(derived(spark, sf_dir, _TERRAFORM), carry=["doc_id"], rules=rule).select("doc_id", "line")


_KEYS = "SELECT doc_id, concat('AKIA', CASE WHEN doc_id % 3 = 0 THEN 'AAAAAAAAAEXAMPLE' WHEN doc_id % 3 = 1 THEN 'BBBBBBBBBBBBBBBB' ELSE upper(translate(substr(md5(cast(doc_id as string)), 1, 16), '0189', 'wxyz')) END) AS value FROM {documents}"


@REGISTRY.add("flt_entropy", f"SELECT doc_id, value FROM ({for_oracle(_KEYS)}) WHERE list_entropy(string_split(value, '')) + 1e-6 >= 3.0")
def flt_entropy(spark, sf_dir):
    return derived(spark, sf_dir, _KEYS).where(detect.enough_entropy(F.col("value"), F.lit(3.0)))


@REGISTRY.add("flt_rule_allowlist", f"SELECT doc_id, value FROM ({for_oracle(_KEYS)}) WHERE NOT regexp_matches(value, '.+EXAMPLE$')")
def flt_rule_allowlist(spark, sf_dir):
    aws = [r for r in builtin() if r.rule_id == "secret.gitleaks.aws-access-token"]
    value = F.col("value")
    hit = detect.rule_allows(aws, F.lit(aws[0].rule_id), value, value, F.lit("x"))
    return derived(spark, sf_dir, _KEYS).where(~hit)


@REGISTRY.add("flt_max_size", "SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) > 4000 THEN 'scan.file_too_large' END AS notice FROM documents")
def flt_max_size(spark, sf_dir):
    from ..sources.files import size_notice

    docs = table(spark, sf_dir, "documents")
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", size_notice(size, 4000).alias("notice"))
