"""The rule catalogue and its translation; no Spark job needed."""

import re

import duckdb
import pytest

from veilspark.plans import samples
from veilspark.policy import AllowEntry, CustomRule, Policy
from veilspark.rules import dialect, keywords, providers, tuned
from veilspark.rules.table import builtin, rules_for


def as_python(java: str) -> str:
    """Java pattern to Python, for ASCII checks."""
    plain = java.replace("(?d)", "").replace(r"\x{80}-\x{10FFFF}", "").replace(r"\x{85}\p{Z}", "").replace(r"\z", r"\Z")
    return re.sub(r"\(\?iu\)", "", plain)


def test_catalogue_size_and_order():
    rules = builtin()
    assert sum(r.source == "provider" for r in rules) == 217
    assert sum(r.source == "tuned" for r in rules) == 48
    assert sum(r.source == "ai" for r in rules) == 7
    names = [r.rule_id for r in rules if r.source == "provider"]
    assert names == sorted(names) and len(set(names)) == 217
    assert sum(r.entropy is not None for r in rules) == 126
    assert sum(r.path_java is not None for r in rules) == 4


def test_every_pattern_compiles_in_re2():
    con = duckdb.connect()
    for rule in builtin():
        con.execute("SELECT regexp_matches('x', ?)", [rule.re2])


def _sample_text(pattern: str) -> str:
    con = duckdb.connect()
    return con.execute(f"SELECT {samples.sample(pattern, '7')}").fetchone()[0]


@pytest.mark.parametrize("gate", ["run", "label"])
def test_gate_holds_for_the_shortest_matches(gate):
    """A rule behind a gate must not match text the gate rejects."""
    shapes = {providers.PREFIX + p.name: p.pattern for p in providers.build()}
    shapes |= {t.rule_id: t.pattern for t in tuned.RULES}
    made = samples.tuned_samples("7")
    test = re.compile(as_python(keywords.GATES[gate]))
    con = duckdb.connect()
    for rule in (r for r in builtin() if r.gate == gate):
        if rule.rule_id in made:
            text = con.execute(f"SELECT {made[rule.rule_id]}").fetchone()[0]
        else:
            text = _sample_text(shapes[rule.rule_id])
        assert test.search(text), (rule.rule_id, text)


def test_keyword_pass_reports_every_keyword():
    words = sorted({w for r in builtin() for w in r.literals})
    found = re.compile(keywords.pass_pattern(words))
    for word in words:
        hits = {m.group(1) for m in found.finditer(f"xx {word} yy")}
        assert hits & set(keywords.words_implying(word, words)), word


def test_boundaries_in_both_dialects():
    java, re2 = dialect.to_java("⌊AKIA[0-9]{2}⌋"), dialect.to_re2("⌊AKIA[0-9]{2}⌋")
    assert java.startswith("(?d)(?=[A])") and re2 == r"\bAKIA[0-9]{2}\b"


def test_rule_gate_by_language_and_kind():
    ids = {r.rule_id for r in rules_for(Policy(pii_languages=("en",), secrets=False))}
    assert "pii.en.ssn" in ids and "pii.email" in ids
    assert not any(i.startswith(("pii.ja.", "secret.")) for i in ids)


def test_custom_rules_are_checked_and_gated():
    rule = CustomRule("t", "abc", kind="internal")
    assert Policy(custom_rules=(rule,)).active_custom_rules() == []
    assert len(Policy(custom_rules=(rule,), internal_terms=True).active_custom_rules()) == 1
    for bad in (CustomRule("", "x"), CustomRule("a", " "), CustomRule("a", "x*", kind="secret"), CustomRule("a", "x", "loud", "secret")):
        with pytest.raises(ValueError):
            Policy(custom_rules=(bad,), internal_terms=True).active_custom_rules()


def test_allowlist_rows_need_a_selector():
    with pytest.raises(ValueError):
        Policy.from_dict({"allowlist": [{"reason": "x"}]})
    assert AllowEntry(expires="soon").expired() and not AllowEntry(expires="2999-01-01").expired()


@pytest.mark.parametrize("rule_id, text", [
    ("pii.email", "a" * (1 << 20) + " a@b.co"), ("pii.email", "x" * (1 << 20) + "@"), ("env.sensitive_assignment", "\n" * (1 << 20) + "="),
    ("pii.plaintext_map", "x" * (1 << 20) + "@ email_" + "a" * 16),
])
def test_long_runs_take_linear_time(spark, rule_id, text):
    import time

    pattern = next(r.java for r in builtin() if r.rule_id == rule_id)
    df = spark.createDataFrame([(text, pattern)], "t string, p string")
    began = time.time()
    df.selectExpr("size(regexp_extract_all(t, p, 0))").collect()
    assert time.time() - began < 15


def test_run_starts_keep_the_matches(spark):
    texts = ["a@b.co%x@d.ef", "..a@b.c.dd1234@x.yy a@b", "\n \nAPI_TOKEN=x\n\n\n  SECRET_A = 'b'\n", "aa@@bb@cc.dd", "xa@b.com_c@d.org"]
    plain = {"pii.email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"}
    plain["env.sensitive_assignment"] = dialect.to_java(next(t.pattern for t in tuned.RULES if t.rule_id == "env.sensitive_assignment"))
    for rule in (r for r in builtin() if r.rule_id in plain):
        df = spark.createDataFrame([(t, rule.java, plain[rule.rule_id]) for t in texts], "t string, p string, q string")
        assert df.where("NOT regexp_extract_all(t, p, 0) <=> regexp_extract_all(t, q, 0) OR NOT split(t, p) <=> split(t, q)").count() == 0
