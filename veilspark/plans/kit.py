"""Shared pieces of the registered queries: inputs, oracle SQL and the registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.hashing import HASH_PREFIX, hmac_pads
from ..session import spread
from .samples import quote

Query = Callable[[SparkSession, str], DataFrame]

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@dataclass
class Registry:
    queries: dict[str, Query]
    oracles: dict[str, str]

    def add(self, key: str, sql: str | None = None):
        def register(fn: Query) -> Query:
            self.put(key, fn, sql)
            return fn

        return register

    def put(self, key: str, fn: Query, sql: str | None) -> None:
        if key in self.queries:
            raise ValueError(f"query {key} registered twice")
        self.queries[key] = fn
        if sql is not None:
            self.oracles[key] = sql.strip()


REGISTRY = Registry({}, {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run shared SQL over the given tables; ``{table}`` names a table."""
    costly = any("{" + t + "}" in sql for t in ("documents", "orders", "events", "part", "customer", "lineitem"))
    for t in TABLES:
        sql = sql.replace("{" + t + "}", f"parquet.`{sf_dir}/{t}.parquet`")
    out = spark.sql(sql)
    return spread(out) if costly else out


def for_oracle(sql: str) -> str:
    """The same derivation for the oracle, where tables are views."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


DOC_PATH = (
    "concat(source, '/', cast(doc_id as string), CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.md' "
    "WHEN 'de' THEN '/.env' ELSE '.yaml' END)"
)


def planted(line: str, path: str = DOC_PATH, where: str = "") -> str:
    """Documents with one planted line at the end of their whole text."""
    return (
        f"SELECT doc_id, {path} AS path, concat(coalesce(text, ''), chr(10), {line}, chr(10)) AS text "
        f"FROM {{documents}} {where}"
    )


PLAIN_DOCUMENTS = f"SELECT doc_id, {DOC_PATH} AS path, coalesce(text, '') AS text FROM {{documents}}"


def hmac_sql(key: bytes, value: str) -> str:
    inner, outer = hmac_pads(key)
    return (
        f"sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || encode({value}))))"
    )


def value_hash_sql(rule_id: str, value: str) -> str:
    return f"'{HASH_PREFIX}' || {hmac_sql(rule_id.encode(), value)}"


def re2(pattern: str) -> str:
    return quote(pattern)


def located_sql(src: str, pattern: str, where: str = "true", extra: str = "") -> str:
    """CTE chain ``src, hit, each_hit, found`` with one row per match and its position."""
    p = re2(pattern)
    return f"""
src AS ({src}),
hit AS (SELECT doc_id, path, text{extra}, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g
        FROM src WHERE {where}),
each_hit AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hit WHERE len(m) > 0),
found AS (SELECT doc_id, path, text{extra}, m[i] AS value, g[i] AS gap, m[i-1] || g[i] AS before_text,
                 g[i+1] || coalesce(m[i+1], '') AS after_text,
                 cast(list_sum([length(x) for x in g[1:i]])
                      + coalesce(list_sum([length(x) for x in m[1:i-1]]), 0) AS BIGINT) AS start
          FROM each_hit)"""


LINE_SQL = "cast(1 + length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) AS INT)"
COLUMN_SQL = "cast(length(string_split(substr(text, 1, start), chr(10))[-1]) + 1 AS INT)"
ENV_PATH_SQL = (
    "((split_part(path, '/', -1) LIKE '.env%' OR path LIKE '%.env') AND path NOT LIKE '%.env.example' "
    "AND path NOT LIKE '%.env.sample')"
)
