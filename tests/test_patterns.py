"""The index of patterns against a test of every pair."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions.paths import glob_to_regex
from veilspark.operators import guard, patterns, suppress

RNG = random.Random(5)
FOLDERS = ["src", "docs", "a", "config.d", "tests[1]", "x y"]
PATHS = ["/".join(RNG.choices(FOLDERS, k=RNG.randint(0, 3)) + [RNG.choice(["main.py", "key.pem", ".env", "b.txt", "README.md", ""])]) for _ in range(120)]
GLOBS = [
    "**/*.pem", "src/**", "docs/**/README.md", "*", "**", "?", "", "a*d", "{src,docs}/*.py", "**/tests\\[1]/**", "[sd]*", "config.d/*.txt", "**/x y/*",
    "src/a/*", ".env", "**/.env", "src**/main.py", "*main*", "{a,b}.txt", "a/**/b.txt", "**/",
]


def brute(texts, regexes):
    # Java's form of the end of input is \\z
    tests = [(r, re.compile(r.replace(r"\z", r"\Z"))) for r in regexes]
    return {(t, r) for t in texts if t is not None for r, test in tests if test.search(t)}


def test_anchors_are_in_every_match():
    for glob in GLOBS:
        anchor, test = patterns.glob_anchor(glob), re.compile(glob_to_regex(glob).replace(r"\z", r"\Z"))
        assert all(anchor in p for p in PATHS if test.search(p)), glob
    assert patterns.glob_anchor("**/secret/*.key") == "secret/" and patterns.glob_anchor("a/**/bcd.txt") == "bcd.txt"


def test_matches_equal_every_pair(spark):
    table = spark.createDataFrame([(glob_to_regex(g), patterns.glob_anchor(g)) for g in GLOBS] * 2, "re string, anchor string")
    texts = spark.createDataFrame([(p,) for p in [*PATHS, None, PATHS[0]]], "text string")
    got = [tuple(r) for r in patterns.matches(texts, table, pattern="re", anchor="anchor").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(set(PATHS), {glob_to_regex(g) for g in GLOBS})
    assert patterns.matches(texts, table.limit(0), pattern="re", anchor="anchor").count() == 0


@pytest.mark.parametrize("limit", [0, 1000])
def test_joins_by_index_and_by_expression(spark, monkeypatch, limit):
    monkeypatch.setattr(patterns, "FEW", limit)
    actions = ["Bash(ls -la)", "Bash(curl https://x.test)", "Read(src/.env)", "Bash(sudo reboot)", "Write(a\\b)", "", None]
    listed = ["Bash(ls *)", "Bash(curl*)", "Read(*.env)", "Write(a/b)", "bash(SUDO:*)", None]
    frame = spark.createDataFrame([(k, a) for k, a in enumerate(actions)], "k int, action string")
    table = spark.createDataFrame([(p,) for p in listed], "pattern string")
    covered = {r["k"] for r in guard.join_policy(frame, table).collect()}
    assert covered == {0, 1, 2, 3, 4}
    assert {r["k"] for r in guard.join_policy(frame, table, kept=False).collect()} == {5, 6}
    rows = [(k, f"r{k % 3}" if k % 5 else None, p, f"h{k % 7}") for k, p in enumerate(PATHS)]
    findings = spark.createDataFrame(rows, "k int, rule_id string, file string, value_hash string")
    entries = [("r0", "**/*.pem", None), (None, "docs/**", None), ("r1", "*", "h3"), (None, "**/.env", "H2".lower()), ("r2", "src/**", None), ("r2", "src/**", None)]
    allow = spark.createDataFrame([(r, glob_to_regex(g), patterns.glob_anchor(g), h) for r, g, h in entries], suppress.ALLOW_SCHEMA)
    ok = {
        k for k, rule, file, h in rows for r, g, eh in entries
        if (r is None or r == rule) and re.search(glob_to_regex(g).replace(r"\z", r"\Z"), file) and (eh is None or eh == h)
    }
    assert sorted(r["k"] for r in suppress.allowlist_join(findings, allow, kept=False).collect()) == sorted(ok)
    left = suppress.allowlist_join(findings, allow)
    assert left.columns == findings.columns and sorted(r["k"] for r in left.collect()) == sorted(set(range(len(rows))) - ok)


def test_a_million_patterns_need_no_nested_loop(spark, capsys):
    table = spark.range(1_000_000).select(F.concat(F.lit("Bash(tool"), "id", F.lit(" *)")).alias("pattern"))
    actions = spark.range(200).select(F.concat(F.lit("Bash(tool"), F.col("id") * 10_007, F.lit(" run)")).alias("action"), "id")
    joined = guard.join_policy(actions, table)
    joined.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(r["id"] for r in joined.collect()) == [k for k in range(200) if k * 10_007 < 1_000_000]
