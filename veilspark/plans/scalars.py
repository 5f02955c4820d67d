"""Queries for scalar functions used by the detectors and reports."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from ..functions import hashing, sql
from ..functions import validators as v
from ..operators import audit, detect, report
from ..rules.table import builtin
from . import detection as det
from .kit import COLUMN_SQL, LINE_SQL, PLAIN_DOCUMENTS, REGISTRY, derived, for_oracle, located_sql, value_hash_sql
from .pseudonymization import KEY, token_sql
from .samples import Pool

_p = Pool("doc_id", "v")
VALUES = f"""SELECT doc_id AS id, CASE doc_id % 12
WHEN 0 THEN concat('4111 1111 1111 ', {_p.digits(4)}) WHEN 1 THEN concat('user', {_p.digits(4)}, '@mail.test') WHEN 2 THEN concat('logo@', cast(doc_id % 5 as string), 'x.png')
WHEN 3 THEN concat('sk-ANT-', {_p.take(20)}) WHEN 4 THEN concat('api_key = ', chr(34), {_p.take(20)}, chr(34)) WHEN 5 THEN concat('secret-key: ', upper({_p.take(18)}))
WHEN 6 THEN concat('token=abcdefgh', {_p.take(4)}) WHEN 7 THEN 'API_KEY=your-value-goes-here' WHEN 8 THEN concat('090-', {_p.digits(4)}, '-', {_p.digits(4)})
WHEN 9 THEN concat('export X_TOKEN=', {_p.take(12)}) WHEN 10 THEN concat('東京都港区芝', {_p.digits(1)}, '-', {_p.digits(1)}) ELSE concat('key: ', {_p.take(8)}, '-X_', {_p.digits(6)}) END AS value
FROM {{documents}}"""
SRC = f"WITH v AS ({for_oracle(VALUES)})"
ASSIGNED = det.ASSIGNED


def values(spark, sf_dir):
    return derived(spark, sf_dir, VALUES)


def _scalar(key: str, fn, sql: str) -> None:
    REGISTRY.put(
        key, lambda spark, sf_dir: values(spark, sf_dir).select("id", fn(F.col("value")).alias("result")),
        f"{SRC} SELECT id, {sql} AS result FROM v",
    )


_scalar("fn_entropy", lambda c: F.round(v.entropy(c), 6), "round(list_entropy(string_split(value, '')), 6)")
_scalar("fn_luhn", v.luhn, det.sql_luhn())
_scalar("fn_email_valid", v.email_ok, det.CHECK_SQL["pii.email"])
_scalar("fn_openai_valid", v.openai_ok, det.CHECK_SQL["secret.openai_api_key"])
_scalar("fn_value_after_assign", v.value_after_assign, ASSIGNED)
_scalar("fn_token_value_valid", v.token_value_ok, det.sql_token_ok("value"))
_scalar("fn_char_classes", v.char_classes, det.sql_classes("value"))
_scalar("fn_hex_like", lambda c: v.hex_like(v.value_after_assign(c)), f"regexp_matches({ASSIGNED}, '^[0-9A-Fa-f]*$')")
_scalar("fn_ascii_sequence", v.ascii_sequence, f"regexp_matches(regexp_replace(value, '[^0-9A-Za-z]', '', 'g'), '{v._runs(8)}')")
_scalar("fn_generic_key_valid", v.generic_key_ok, det.sql_generic())
_scalar("fn_env_assign_valid", v.env_assign_ok, f"contains(value, '=') AND {det.sql_env()}")
_scalar("fn_ja_postal_valid", v.ja_postal_ok, "regexp_matches(value, '[1-9]')")
_scalar("fn_ja_address_valid", v.ja_address_ok, det.CHECK_SQL["pii.ja.address"])
_scalar("fn_value_hash", lambda c: hashing.value_hash("pii.email", c), value_hash_sql("pii.email", "value"))
_scalar("fn_ja_phone_valid", lambda c: F.when(c.rlike(r"\A[0-9]+-[0-9]+-[0-9]+\z"), v.ja_phone_ok(c)),
        "CASE WHEN regexp_matches(value, '^[0-9]+-[0-9]+-[0-9]+$') THEN " + det.sql_ja_phone().split("AND NOT regexp_matches(coalesce")[0] + ") END")

_EMBED = "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN '12-' WHEN 1 THEN 'x' WHEN 2 THEN '7' ELSE '' END AS l, CASE doc_id % 3 WHEN 0 THEN '-9' WHEN 1 THEN ' 1' ELSE '-x' END AS r FROM {documents}"


@REGISTRY.add("fn_ja_phone_embedded", f"SELECT id, regexp_matches(l, '[0-9]-?$') OR regexp_matches(r, '^-?[0-9]') AS result FROM ({for_oracle(_EMBED)})")
def fn_ja_phone_embedded(spark, sf_dir):
    return derived(spark, sf_dir, _EMBED).select("id", v.ja_phone_embedded(F.col("l"), F.col("r")).alias("result"))


_NAMES = """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'SSH_KEY_PATH' WHEN 1 THEN 'NEXT_PUBLIC_API_KEY' WHEN 2 THEN 'VITE_SECRET_KEY' WHEN 3 THEN 'api_token_ttl'
WHEN 4 THEN 'DB_PORT' WHEN 5 THEN concat('public_', o_orderstatus) WHEN 6 THEN 'MY_DIR' ELSE o_orderpriority END AS name FROM {orders}"""


@REGISTRY.add("fn_env_key_public", f"SELECT id, {det.sql_public('name')} AS result FROM ({for_oracle(_NAMES)})")
def fn_env_key_public(spark, sf_dir):
    return derived(spark, sf_dir, _NAMES).select("id", v.env_key_public(F.col("name")).alias("result"))


@REGISTRY.add("fn_env_numeric_meta", f"SELECT id, regexp_matches(upper(name), '(_EXPIRY|_EXPIRES|_EXPIRATION|_TTL|_PORT|_TIMEOUT|_TIMESTAMP|_VERSION)$') AS result FROM ({for_oracle(_NAMES)})")
def fn_env_numeric_meta(spark, sf_dir):
    return derived(spark, sf_dir, _NAMES).select("id", v.env_numeric_meta(F.col("name")).alias("result"))


@REGISTRY.add("fn_identifier_prefix", "SELECT doc_id, regexp_extract(concat(coalesce(text, ''), ' x-NEXT_', lang), '[0-9A-Za-z_]*$') AS prefix FROM documents")
def fn_identifier_prefix(spark, sf_dir):
    rows = derived(spark, sf_dir, "SELECT doc_id, concat(coalesce(text, ''), ' x-NEXT_', lang) AS head FROM {documents}")
    return rows.select("doc_id", v.identifier_prefix(F.col("head")).alias("prefix"))


_WORD = [r for r in builtin() if r.rule_id == "pii.ipv4"]
_MULTI = PLAIN_DOCUMENTS.replace("coalesce(text, '') AS text", "concat('10.0.0.1', chr(10), coalesce(text, ''), chr(10), 'é 10.0.0.2 10.0.0.3', chr(13), chr(10), '10.0.0.4') AS text")


@REGISTRY.add("fn_line_col", f"""WITH {located_sql(for_oracle(_MULTI), _WORD[0].re2)} SELECT doc_id, start, {LINE_SQL} AS line, {COLUMN_SQL} AS "column" FROM found""")
def fn_line_col(spark, sf_dir):
    return detect.matches(derived(spark, sf_dir, _MULTI), carry=["doc_id"], rules=_WORD).select("doc_id", "start", "line", "column")


_SEV = "SELECT event_id AS id, ['critical','high','medium','low','info','odd'][1 + event_id % 6] AS severity, value / 100 AS confidence FROM events"
_SEV_SPARK = "SELECT event_id AS id, element_at(array('critical','high','medium','low','info','odd'), cast(1 + event_id % 6 AS INT)) AS severity, value / 100 AS confidence FROM {events}"
for _key, _fn, _sql in (
    ("fn_sarif_level", lambda: report.sarif_level(F.col("severity")), "CASE WHEN severity IN ('critical','high') THEN 'error' WHEN severity IN ('low','info') THEN 'note' ELSE 'warning' END"),
    ("fn_sarif_severity", lambda: report.sarif_severity(F.col("severity")), "CASE severity WHEN 'critical' THEN '9.0' WHEN 'high' THEN '8.0' WHEN 'low' THEN '2.0' WHEN 'info' THEN '0.0' ELSE '5.0' END"),
    ("fn_sarif_precision", lambda: report.sarif_precision(F.col("confidence")), "CASE WHEN cast(confidence AS FLOAT) >= cast(0.85 AS FLOAT) THEN 'high' WHEN cast(confidence AS FLOAT) >= cast(0.6 AS FLOAT) THEN 'medium' ELSE 'low' END"),
):
    REGISTRY.put(_key, lambda spark, sf_dir, f=_fn: derived(spark, sf_dir, _SEV_SPARK).select("id", f().alias("result")),
                 f"SELECT id, {_sql} AS result FROM ({_SEV})")


@REGISTRY.add("fn_since", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'")
def fn_since(spark, sf_dir):
    cutoff = audit.since_cutoff("2w", datetime(2024, 1, 24, tzinfo=UTC))
    rows = derived(spark, sf_dir, "SELECT ts FROM {events}")
    return rows.where(F.col("ts") >= F.lit(cutoff.strftime("%Y-%m-%d %H:%M:%S")).cast(rows.schema["ts"].dataType)).agg(
        F.count(F.lit(1)).alias("n"))


@REGISTRY.add("fn_sql_functions", f"""{SRC} SELECT id, {det.sql_luhn()} AS luhn, round(list_entropy(string_split(value, '')), 6) AS entropy,
{value_hash_sql('pii.email', 'value')} AS value_hash, {token_sql('email', 'value')} AS token FROM v""")
def fn_sql_functions(spark, sf_dir):
    sql.register(spark, KEY)
    return values(spark, sf_dir).selectExpr(
        "id", "luhn(value) AS luhn", "round(entropy(value), 6) AS entropy", "value_hash('pii.email', value) AS value_hash", "token('email', value) AS token")
