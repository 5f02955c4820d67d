"""Suppression: inline comments and allowlists.

Inline directives are parsed per document and travel with the row. Allowlist
entries are configuration: they become expressions when they come from a policy,
or a join when they come from a table.
"""

from __future__ import annotations

import re
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as path_fn
from ..functions.arrays import let
from ..functions.validators import SPACE
from ..policy import AllowEntry
from .patterns import any_regex, few, glob_anchor, matches

DIRECTIVE = "struct<line:int,rule:string>"
EVERY_PATH = ("**", "**/*", "*", "**/**")


def _directive(line: Column, number: Column, keyword: str) -> Column:
    """Directive on one line (right-trimmed), null when there is none."""
    k, s = re.escape(keyword), SPACE
    alone = rf"\A{s}*(?:#|//){s}*{k}(-next-line)?(?:{s}+(\S+).*)?\z"
    alone_html = rf"\A{s}*<!--{s}*{k}(-next-line)?(?:{s}+(\S+?)?(?:{s}.*)?)?-->\z"
    hash_tail = rf"\A.*\S.*#{s}*{k}(-next-line)?(?:{s}+([^#\s]+)[^#]*)?\z"
    slash_tail = rf"\A.*\S.*//{s}*{k}(-next-line)?(?:{s}+((?:(?!//)\S)+)(?:(?!//).)*)?\z"
    html_tail = rf"\A.*\S.*<!--{s}*{k}(-next-line)?(?:{s}+(\S+?)?(?:{s}(?:(?!<!--).)*)?)?-->\z"

    def made(pattern: str, target: Column) -> Column:
        rule = F.regexp_extract(line, pattern, 2)
        return F.struct(target.cast("int").alias("line"), F.when(rule != "", rule).alias("rule"))

    def tail(pattern: str) -> Column:
        return made(pattern, F.when(F.regexp_extract(line, pattern, 1) != "", number + 1).otherwise(number))

    return (
        F.when(~F.contains(line, F.lit(keyword)), F.lit(None))
        .when(line.rlike(alone), made(alone, number + 1))
        .when(line.rlike(alone_html), made(alone_html, number + 1))
        .when(line.rlike(hash_tail), tail(hash_tail))
        .when(line.rlike(slash_tail), tail(slash_tail))
        .when(line.rlike(html_tail), tail(html_tail))
    )


def text_lines(text: Column, keyword: str | None = None) -> Column:
    """Lines of a text, white space at their ends removed; with a keyword only from the lines that hold it."""
    bare = lambda x: F.regexp_replace(x, rf"{SPACE}+\z", "")
    return F.transform(F.split(text, "\n", -1), bare if keyword is None else (
        lambda x: F.when(F.contains(x, F.lit(keyword)), bare(x)).otherwise(x)
    ))


def inline_directives(text: Column, keyword: str, trusted: Column | None = None) -> Column:
    """Array of ``(line, rule)``; a null rule stands for every rule.

    With ``trusted`` a marker counts only when its line is also a line of that
    text, possibly behind the one-character prefix of a patch.
    """

    def parse(lines: Column) -> Column:
        found = F.transform(lines, lambda x, i: _directive(x, i + 1, keyword))
        if trusted is not None:
            known = text_lines(F.regexp_replace(trusted, r"\A\x{FEFF}", ""))

            def accepted(kept: Column) -> Column:
                return F.transform(
                    found,
                    lambda d, i: F.when(
                        F.array_contains(kept, F.get(lines, i))
                        | (F.get(lines, i).rlike(r"\A[ -]")
                           & F.array_contains(kept, F.substring(F.get(lines, i), 2, 2**31 - 1))),
                        d,
                    ),
                )

            return F.filter(let(known, accepted), lambda d: d.isNotNull())
        return F.filter(found, lambda d: d.isNotNull())

    empty = F.array().cast(f"array<{DIRECTIVE}>")
    return F.when(F.contains(text, F.lit(keyword)), let(text_lines(text, keyword), parse)).otherwise(empty)


def ignored(directives: Column, line: Column, rule_id: Column) -> Column:
    return F.exists(directives, lambda d: (d["line"] == line) & (d["rule"].isNull() | (d["rule"] == rule_id)))


# -- allowlists ---------------------------------------------------------------


def _in_force(entries, today: date | None) -> list[AllowEntry]:
    return [e for e in entries if not e.expired(today)]


def allowlisted(path: Column, rule_id: Column, value_hash: Column, entries, today: date | None = None) -> Column:
    """Whether a policy's allowlist accepts a finding, as one expression.

    Entries with the same rule filter share one combined path pattern, and hash
    entries share one set lookup, so the size of the list hardly matters.
    """
    by_rule: dict[str | None, list[str]] = {}
    by_hash: dict[tuple[str | None, str], set[str]] = {}
    for e in _in_force(entries, today):
        if e.value_hash is None:
            by_rule.setdefault(e.rule_id, []).append(e.path)
        else:
            by_hash.setdefault((e.rule_id, e.path), set()).add(e.value_hash.strip().lower())
    out = F.lit(False)
    for rule, globs in by_rule.items():
        test = F.lit(True) if set(globs) & set(EVERY_PATH) else path_fn.any_glob(path, globs)
        out = out | (test if rule is None else (rule_id == rule) & test)
    for (rule, glob), hashes in by_hash.items():
        test = value_hash.isin(*sorted(hashes))
        if glob not in EVERY_PATH:
            test = test & path_fn.any_glob(path, [glob])
        out = out | (test if rule is None else (rule_id == rule) & test)
    return out


ALLOW_SCHEMA = "rule_id string, path_re string, anchor string, value_hash string"


def allowlist_table(spark, entries, today: date | None = None) -> DataFrame:
    """Entries in force as a table for ``allowlist_join``."""
    rows = [
        (e.rule_id, path_fn.glob_to_regex(e.path), glob_anchor(e.path), e.value_hash.strip().lower() if e.value_hash else None)
        for e in _in_force(entries, today)
    ]
    return spark.createDataFrame(rows, ALLOW_SCHEMA)


def allowlist_join(findings: DataFrame, allow: DataFrame, *, kept: bool = True) -> DataFrame:
    """Findings that an allowlist table does not accept (or, inverted, does).

    Entries with a hash join on it. Entries without are matched with the different paths of the findings, by the
    index of ``patterns``, and findings join the accepted paths and rules. Both kinds may be many.
    """
    by_hash = allow.where("value_hash IS NOT NULL")
    by_path = allow.where("value_hash IS NULL").select("rule_id", "path_re", "anchor").distinct()
    f, h = findings.alias("f"), by_hash.alias("h")
    on_hash = (
        (F.lower("f.value_hash") == F.col("h.value_hash"))
        & (F.col("h.rule_id").isNull() | (F.col("h.rule_id") == F.col("f.rule_id")))
        & F.expr("f.file RLIKE h.path_re")
    )
    rest = f.join(h, on_hash, "left_anti").select(*findings.columns)
    short = few(by_path)
    if short is not None:
        by_rule = {r["rule_id"]: [x["path_re"] for x in short if x["rule_id"] == r["rule_id"]] for r in short}
        covered = any_regex(F.col("file"), by_rule.pop(None, []))
        for rule, regexes in by_rule.items():
            covered = covered | (F.col("rule_id").eqNullSafe(rule) & any_regex(F.col("file"), regexes))
        parts = [rest.where(covered)]
        left = rest.where(~covered)
    else:
        found = matches(findings.select(F.col("file").alias("text")), by_path, pattern="path_re", anchor="anchor")
        accepted = found.join(by_path, "path_re").select(F.col("text").alias("file"), "rule_id").distinct()
        any_rule = accepted.where("rule_id IS NULL").select("file")
        others = rest.join(any_rule, "file", "left_anti")
        parts = [rest.join(any_rule, "file", "left_semi"), others.join(accepted, ["file", "rule_id"], "left_semi")]
        left = others.join(accepted, ["file", "rule_id"], "left_anti")
    if kept:
        return left.select(*findings.columns)
    # disjoint parts, so no finding is reported twice
    return reduce(DataFrame.unionByName, [p.select(*findings.columns) for p in parts], f.join(h, on_hash, "left_semi").select(*findings.columns))


def policy_warnings(entries, today: date | None = None, file: str = "policy.toml") -> list[tuple]:
    """Findings about allowlist entries that do not do what they say."""
    out = []
    for number, e in enumerate(entries, 1):
        for key in e.unknown:
            out.append(("policy.allowlist_unknown_key", number, f"allowlist entry {number} has an unknown key `{key}`"))
        if e.path in EVERY_PATH and not e.expired(today) and e.rule_id is None and e.value_hash is None:
            out.append((
                "policy.allowlist_matches_everything", number,
                f"allowlist entry {number} (path={e.path}) suppresses every finding in every file",
            ))
        if e.expired(today):
            why = "is past its date" if e.expiry_date() else "has a date that is not YYYY-MM-DD"
            out.append(("policy.allowlist_expired", number, f"allowlist entry {number} {why} and no longer applies"))
    return [(rule, "low", "ignore", file, 1, 1, message) for rule, _n, message in out]


def policy_warning_table(allow: DataFrame, today: Column | None = None) -> DataFrame:
    """The same warnings for an allowlist held as a table.

    Input columns: ``entry`` (number), ``rule_id``, ``path``, ``value_hash``,
    ``expires``, ``unknown`` (array of key names).
    """
    today = F.current_date() if today is None else today
    until = F.try_to_date(F.trim("expires"), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.expr(
        "CAST(try_to_timestamp(trim(expires), 'yyyy-MM-dd') AS DATE)"
    )
    expired = F.col("expires").isNotNull() & (until.isNull() | (until < today))
    everything = (
        F.col("path").isin(*EVERY_PATH) & ~expired & F.col("rule_id").isNull() & F.col("value_hash").isNull()
    )
    rules = F.concat(
        F.transform(F.coalesce("unknown", F.array().cast("array<string>")),
                    lambda _k: F.lit("policy.allowlist_unknown_key")),
        F.when(everything, F.array(F.lit("policy.allowlist_matches_everything")))
        .otherwise(F.array().cast("array<string>")),
        F.when(expired, F.array(F.lit("policy.allowlist_expired"))).otherwise(F.array().cast("array<string>")),
    )
    return allow.select("entry", F.explode(rules).alias("rule_id")).select(
        "entry", "rule_id", F.lit("low").alias("severity"), F.lit("ignore").alias("kind"),
    )
