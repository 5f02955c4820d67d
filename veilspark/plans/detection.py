"""Queries for the detectors: one per tuned rule, one for all provider rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import validators as v
from ..operators import detect
from ..policy import CustomRule, Policy
from ..rules import dialect, providers, tuned
from ..rules.table import Rule, builtin, rules_for
from . import samples
from .kit import (
    COLUMN_SQL, ENV_PATH_SQL, LINE_SQL, PLAIN_DOCUMENTS, REGISTRY, derived, for_oracle, located_sql, planted, re2,
    value_hash_sql,
)

OUT = ["doc_id", "rule_id", "start", "line", "column", "value_hash"]

# -- oracle forms of the checks ------------------------------------------------
DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
ASSIGNED = "trim(trim(regexp_replace(value, '^(?s:.*)[=:]', ''), chr(32) || chr(9) || chr(10)), chr(34) || chr(39))"
MARKERS = "|".join(v.PLACEHOLDERS)


def sql_luhn(value: str = DIGITS) -> str:
    return (
        f"(length({value}) BETWEEN 13 AND 19 AND list_sum([CASE WHEN (length({value}) - k) % 2 = 1 "
        f"THEN (2 * cast(substr({value}, k, 1) AS INT)) % 10 + (2 * cast(substr({value}, k, 1) AS INT)) // 10 "
        f"ELSE cast(substr({value}, k, 1) AS INT) END for k in range(1, length({value}) + 1)]) % 10 = 0)"
    )


def sql_token_ok(value: str) -> str:
    return (
        f"(NOT regexp_matches(lower({value}), '{MARKERS}') AND len(list_distinct(string_split({value}, ''))) >= 8)"
    )


def sql_public(key: str) -> str:
    return (
        f"(regexp_matches(upper({key}), '(?:{'|'.join(v.LOCATION_SUFFIXES)})$') OR "
        f"(regexp_matches(upper({key}), '^(?:{'|'.join(v.PUBLIC_PREFIXES)})') AND "
        f"NOT regexp_matches(upper({key}), '{'|'.join(v.SECRET_WORDS)}')))"
    )


def sql_classes(value: str) -> str:
    return " + ".join(
        f"cast(regexp_matches({value}, '{c}') AS INT)" for c in ("[a-z]", "[A-Z]", "[0-9]", "[_-]")
    )


def sql_generic(value: str = ASSIGNED) -> str:
    is_hex = f"regexp_matches({value}, '^[0-9A-Fa-f]*$')"
    run = f"regexp_matches(regexp_replace({value}, '[^0-9A-Za-z]', '', 'g'), '{v._runs(8)}')"
    return (
        f"({sql_token_ok(value)} AND NOT (({sql_classes(value)}) <= 1 AND (NOT {is_hex} OR length({value}) < 32)) "
        f"AND NOT ({run} AND NOT {is_hex}))"
    )


def sql_ja_phone() -> str:
    sizes = "concat(length(split_part(value, '-', 1)), '-', length(split_part(value, '-', 2)), '-', length(split_part(value, '-', 3)))"
    tens = " OR ".join(f"{DIGITS} LIKE '{p}%'" for p in v.TEN_DIGIT_SERVICES)
    return f"""(length({DIGITS}) IN (10, 11, 14) AND CASE
        WHEN {tens} THEN {sizes} IN ('4-3-3', '4-2-4')
        WHEN {DIGITS} LIKE '0800%' THEN {sizes} = '4-3-4'
        WHEN {DIGITS} LIKE '0200%' THEN {sizes} = '3-6-5'
        WHEN {DIGITS} LIKE '0204%' THEN {sizes} = '4-3-4'
        WHEN {DIGITS} LIKE '020%' THEN {sizes} = '3-3-5'
        ELSE true END
      AND NOT regexp_matches(value, '^[^-]*-0*-0*$')
      AND NOT regexp_matches(coalesce(before_text, gap), '[0-9]-?$') AND NOT regexp_matches(after_text, '^-?[0-9]'))"""


def sql_env(value: str = "value") -> str:
    key = "regexp_extract(split_part(value, '=', 1), '([^[:space:]]+)[[:space:]]*$', 1)"
    val = "trim(trim(regexp_replace(value, '^[^=]*=', ''), chr(32) || chr(9)), chr(34) || chr(39))"
    return f"""(NOT {sql_public(key)} AND NOT (strlen({val}) < 8
        OR regexp_matches({val}, {re2(chr(94) + r'(?:encrypted:|\$|<|%\(|\{\{)')}) OR contains(lower({val}), 'xxxx')
        OR lower({val}) IN ({', '.join(repr(x) for x in v.NON_SECRETS)}))
      AND NOT (regexp_matches({val}, '^[0-9]*$') AND regexp_matches(upper({key}), '(?:{'|'.join(v.METADATA_SUFFIXES)})$'))
      AND {sql_token_ok(val)})"""


IDENT = "regexp_extract(gap, '[0-9A-Za-z_]*$') || regexp_extract(value, '^[0-9A-Za-z_]*')"
_N = v.ADDRESS_NUMERALS
CHECK_SQL = {
    "pii.email": f"NOT regexp_matches(value, {re2('@[23]x' + chr(92) + '.(?i:' + '|'.join(v.IMAGE_AND_MEDIA) + ')$')})",
    "pii.credit_card": sql_luhn(),
    "pii.ja.phone": sql_ja_phone(),
    "pii.ja.postal_code": "regexp_matches(value, '[1-9]')",
    "pii.ja.address": (
        f"(regexp_matches(value, '^[^{_N}]+[{_N}]') AND "
        f"NOT regexp_matches(value, '^[^{_N}]*[{v.ADDRESS_PARTICLES}][{_N}]') AND "
        f"NOT regexp_matches(value, '^[^{_N}]*[0-9]{{4}}[{v.ADDRESS_HYPHENS}]'))"
    ),
    "secret.openai_api_key": "lower(substr(value, 1, 7)) <> 'sk-ant-'",
    "secret.generic_api_key": f"({sql_generic()} AND NOT {sql_public('(' + IDENT + ')')})",
    **{r: sql_token_ok(ASSIGNED) for r in (
        "secret.twilio_auth_token", "secret.vercel_token", "secret.cloudflare_api_token",
        "secret.notion_integration_token")},
    "env.sensitive_assignment": sql_env(),
    "ai_context.embedded_bom": "start > 0",
}


def rule_oracle(rule: Rule, src: str) -> str:
    where = ENV_PATH_SQL if rule.env_paths else "true"
    return f"""WITH {located_sql(for_oracle(src), rule.re2, where)}
SELECT doc_id, '{rule.rule_id}' AS rule_id, start, {LINE_SQL} AS line, {COLUMN_SQL} AS "column",
       {value_hash_sql(rule.rule_id, 'value')} AS value_hash
FROM found WHERE {CHECK_SQL.get(rule.rule_id, 'true')}"""


def _register_rule(key: str, rule: Rule, src: str) -> None:
    def run(spark, sf_dir):
        return detect.matches(derived(spark, sf_dir, src), carry=["doc_id"], rules=[rule]).select(*OUT)

    REGISTRY.put(key, run, rule_oracle(rule, src))


def _tuned_source(rule: Rule) -> str:
    made = samples.tuned_samples()
    pattern = next(r.pattern for r in tuned.RULES if r.rule_id == rule.rule_id)
    return planted(made.get(rule.rule_id) or samples.sample(pattern, "doc_id", rule.key))


for _rule in builtin():
    if _rule.source == "tuned":
        _register_rule("det_" + _rule.key, _rule, _tuned_source(_rule))
    elif _rule.source == "ai":
        _register_rule("det_" + _rule.key, _rule, planted(samples.quote(samples.AI_SAMPLES[_rule.key])))


# -- provider rules -------------------------------------------------------------

PROVIDERS = [r for r in builtin() if r.source == "provider"]
_SHAPES = {providers.PREFIX + p.name: p.pattern for p in providers.build()}
# text the pattern alone does not lead to
_SPECIAL_SAMPLES = {
    "curl-auth-header": "concat('curl -s -H ', chr(34), 'Authorization: Bearer ', md5(cast(doc_id as string)), chr(34), ' x')",
    "curl-auth-user": "concat('curl -s -u ', chr(34), 'user', cast(doc_id as string), ':', md5(cast(doc_id as string)), chr(34), ' x')",
    "kubernetes-secret-yaml": "concat('kind: Secret', chr(10), 'data:', chr(10), '  key: ', md5(cast(doc_id as string)))",
    "aws-access-token": "concat('AKIA', upper(translate(substr(md5(cast(doc_id as string)), 1, 16), '0189', 'wxyz')), ' ')",
    "sonar-api-token": "concat('sonar.token=', md5(cast(doc_id as string)), substr(md5(concat('b', cast(doc_id as string))), 1, 8), ' ')",
    "private-key": "concat('-----BEGIN RSA PRIVATE KEY-----', chr(10), md5(cast(doc_id as string)), md5(concat('b', cast(doc_id as string))), chr(10), '-----END RSA PRIVATE KEY-----')",
    "nuget-config-password": "concat('<add key=', chr(34), 'Password', chr(34), ' value=', chr(34), md5(cast(doc_id as string)), chr(34), ' />')",
}
_EXTENSION = {"freemius-secret-key": ".php", "hashicorp-tf-password": ".tf", "kubernetes-secret-yaml": ".yaml",
              "nuget-config-password": "/nuget.config"}


def provider_source(spark: bool) -> str:
    """Every document gets one line made for one provider rule, in turn.

    The choice is large; inside a lambda Spark interprets it instead of
    generating a method beyond the JVM's size limit.
    """
    lines, paths = [], []
    for i, rule in enumerate(PROVIDERS):
        name = rule.rule_id.removeprefix(providers.PREFIX)
        line = _SPECIAL_SAMPLES.get(name) or samples.sample(_SHAPES[rule.rule_id], "doc_id", f"p{i}")
        if rule.rule_id in (providers.PREFIX + "airtable-personnal-access-token",):
            line = f"concat('airtable ', {line})"
        lines.append(f"WHEN {i} THEN {line}")
        if name in _EXTENSION:
            paths.append(f"WHEN {i} THEN '{_EXTENSION[name]}'")
    n = len(PROVIDERS)
    line = f"CASE doc_id % {n} {' '.join(lines)} ELSE '' END"
    line = f"transform(array(1), x -> {line})[0]" if spark else line
    path = f"concat(source, '/', cast(doc_id as string), CASE doc_id % {n} {' '.join(paths)} ELSE '.txt' END)"
    return planted(line, path)


def sql_allow(rule: Rule) -> str:
    tests = []
    for allow in rule.allow:
        one = []
        if allow.regexes:
            one.append("(" + " OR ".join(f"regexp_matches(value, {re2(dialect.to_re2(r))})" for r in allow.regexes) + ")")
        if allow.paths:
            one.append("(" + " OR ".join(f"regexp_matches(path, {re2(dialect.to_re2(r))})" for r in allow.paths) + ")")
        tests.append((" AND " if allow.condition == "and" else " OR ").join(one))
    return " OR ".join(f"({t})" for t in tests) or "false"


def provider_oracle(src: str) -> str:
    parts = []
    for rule in PROVIDERS:
        p = re2(rule.re2)
        tests = [" OR ".join(f"contains(low, {samples.quote(k)})" for k in rule.literals)]
        pattern = next(x for x in providers.build() if providers.PREFIX + x.name == rule.rule_id)
        if pattern.path:
            tests.append(f"regexp_matches(path, {re2(dialect.to_re2(pattern.path))})")
        where = " AND ".join(f"({t})" for t in tests)
        value = "whole" if rule.secret_group is None else f"regexp_extract(whole, {p}, {rule.secret_group})"
        keep = [f"NOT ({sql_allow(rule)})"]
        if rule.entropy is not None:
            keep.append(f"list_entropy(string_split(value, '')) + 1e-6 >= {rule.entropy}")
        parts.append(
            f"SELECT doc_id, '{rule.rule_id}' AS rule_id, value_hash FROM (SELECT doc_id, path, {value} AS value, "
            f"{value_hash_sql(rule.rule_id, value)} AS value_hash FROM (SELECT doc_id, path, "
            f"unnest(regexp_extract_all(text, {p})) AS whole FROM src WHERE {where})) WHERE {' AND '.join(keep)}"
        )
    return f"WITH src AS (SELECT *, lower(text) AS low FROM ({for_oracle(src)}))\n" + "\nUNION ALL\n".join(parts)


_PROVIDER_SRC = provider_source(spark=True)


@REGISTRY.add("det_provider_rules", provider_oracle(provider_source(spark=False)))
def det_provider_rules(spark, sf_dir):
    docs = derived(spark, sf_dir, _PROVIDER_SRC)
    return detect.matches(docs, carry=["doc_id"], rules=PROVIDERS).select("doc_id", "rule_id", "value_hash")


# -- custom rules ---------------------------------------------------------------

CUSTOM = Policy(custom_rules=(
    CustomRule("acme.token", r'token\s*=\s*"[0-9a-f]{40}"', "critical", "secret", "Access token in text"),
    CustomRule("acme.term", "error", "low", "internal", case_insensitive=True),
    CustomRule("acme.off", "the", "low", "secret", enabled=False),
), internal_terms=True)
CUSTOM_RULES = [r for r in rules_for(CUSTOM) if r.source == "custom"]


def _custom_oracle() -> str:
    parts = []
    for name, pattern, severity in (("acme.token", r'token\s*=\s*"[0-9a-f]{40}"', "critical"), ("acme.term", "(?i)error", "low")):
        parts.append(f"""SELECT doc_id, '{name}' AS rule_id, '{severity}' AS severity, {value_hash_sql(name, 'value')} AS value_hash
FROM (SELECT doc_id, unnest(regexp_extract_all(text, {re2(pattern)})) AS value FROM src)""")
    return f"WITH src AS ({for_oracle(PLAIN_DOCUMENTS)})\n" + "\nUNION ALL\n".join(parts)


@REGISTRY.add("det_custom_rules", _custom_oracle())
def det_custom_rules(spark, sf_dir):
    docs = derived(spark, sf_dir, PLAIN_DOCUMENTS)
    return detect.matches(docs, CUSTOM, carry=["doc_id"], rules=CUSTOM_RULES).select(
        "doc_id", "rule_id", "severity", "value_hash"
    )
