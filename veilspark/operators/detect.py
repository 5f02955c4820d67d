"""Detection: documents in, matches out, with no shuffle.

Each document row is tested by every enabled rule inside one array expression.
A rule's regex runs only after its cheap tests (keywords, path, shape) passed.
``explode_outer`` then turns the few rules that hit into rows; because it is the
outer form, Catalyst does not copy the regex work into an inferred filter. All
later steps (positions, checks, hashes, suppression, duplicates) run on the
array of matches of one document and one rule, so a scan is a narrow map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, hashing, validators
from ..functions import paths as path_fn
from ..functions.arrays import let
from ..policy import SEVERITIES, Policy
from ..rules import dialect, keywords, providers, tuned
from ..rules.table import Rule, rules_for

BOM = "\ufeff"
# characters whose simple case folding leaves ASCII: long s and the Kelvin sign
FOLDS_TO_ASCII = ("\u017f", "\u212a")
# characters whose lower-case form is ASCII although they are not
LOWERS_TO_ASCII = ("\u212a", "\u0130")

_TEXT, _LOWER, _PATH = "__text", "__lower", "__path"
_ODD, _WIDE, _ENV, _CODE = "__odd_case", "__non_ascii", "__env_path", "__code_path"
_IGNORES, _FOUND, _GATE, _WHOLE = "__ignores", "__found", "__gate_", "__whole"
# stands around every match of a marked text; texts that hold it themselves are kept beside their hits
MARK = "\x02"
# so many keywords are looked for one by one, without gates and the shared pass
FEW_WORDS = 24

MATCH_TYPE = "array<struct<value:string,value_hash:string,start:bigint,line:int,column:int>>"


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cheap_test(rule: Rule, words: list[str]) -> list[str]:
    """SQL conditions a document must meet before the rule's regex runs.

    ``words`` are the keywords the shared pass looks for. Without a pass the
    keywords of a rule say enough, and its gate is spared.
    """
    tests = []
    if rule.env_paths:
        tests.append(_ENV)
    if rule.path_java:
        tests.append(f"{_PATH} RLIKE {sql_text(rule.path_java)}")
    if rule.non_ascii:
        tests.append(_WIDE)
    if rule.gate and not (rule.literals and _spared(rule.gate, words)):
        tests.append(f"{_GATE}{rule.gate}")
    if rule.literals:
        either = []
        for word in rule.literals:
            if words and keywords.in_pass(word, rule.gate):
                either += [f"array_contains({_FOUND}, {sql_text(w)})" for w in keywords.words_implying(word, words)]
            else:
                either.append(f"contains({_LOWER}, {sql_text(word)})")
        if rule.folds_case and rule.source != "provider":
            either.append(_ODD)
        tests.append("(" + " OR ".join(either) + ")")
    if rule.shape:
        tests.append(f"{_TEXT} RLIKE {sql_text(rule.shape)}")
    return tests


def rule_fields(number: int, rule: Rule) -> list[str]:
    inner, outer = hashing.hmac_pads(rule.rule_id.encode())
    severity, message = sql_text(rule.severity), sql_text(rule.message)
    if rule.rule_id == "ai_context.bidi_control":
        severity = f"IF({_CODE}, {sql_text(tuned.CODE_SEVERITY)}, {severity})"
        message = f"IF({_CODE}, {sql_text(tuned.CODE_MESSAGE)}, {message})"
    return [
        f"'number', {number}", f"'rule_id', {sql_text(rule.rule_id)}", f"'source', {sql_text(rule.source)}",
        f"'severity', {severity}", f"'kind', {sql_text(rule.kind)}", f"'message', {message}",
        f"'confidence', CAST({rule.confidence} AS FLOAT)", f"'pattern', {sql_text(rule.java)}",
        f"'inner', X'{inner.hex()}'", f"'outer', X'{outer.hex()}'",
        "'entropy', CAST({} AS DOUBLE)".format("NULL" if rule.entropy is None else rule.entropy),
    ]


def _spared(gate: str, words: list[str]) -> bool:
    return not words and gate in ("run", "label")


def marked_sql(rule: Rule) -> str:
    """The text with marks around the rule's matches; of a text that holds marks itself, only whether it matches.

    A rule that stays within a line and needs a sign looks at the lines with that sign alone.
    """
    pattern, around = sql_text(rule.java), sql_text(f"{MARK}$0{MARK}")
    whole = f"regexp_replace({_TEXT}, {pattern}, {around})"
    if rule.by_line:
        sign = " OR ".join(f"contains(l, {sql_text(w)})" for w in rule.literals)
        lines = f"transform(split({_TEXT}, '\\n', -1), l -> IF({sign}, regexp_replace(l, {pattern}, {around}), l))"
        whole = f"array_join({lines}, '\\n')"
    return f"IF({_WHOLE} IS NULL, {whole}, IF({_TEXT} RLIKE {pattern}, {sql_text(MARK)}, ''))"


def _rule_branch(number: int, rule: Rule, words: list[str]) -> str:
    body = f"named_struct({', '.join([*rule_fields(number, rule), f'{chr(39)}marked{chr(39)}, {marked_sql(rule)}'])})"
    tests = cheap_test(rule, words)
    return f"CASE WHEN {' AND '.join(tests)} THEN {body} END" if tests else body


def _needs_word(rule: Rule) -> bool:
    """The rule cannot match unless the keyword pass reported something."""
    return bool(rule.literals) and all(keywords.in_pass(w, rule.gate) for w in rule.literals) and (
        not rule.folds_case or rule.source == "provider"
    )


def pass_words(rules: list[Rule]) -> list[str]:
    """Keywords of the shared pass; none if they are few enough to be looked for one by one."""
    words = sorted({w for r in rules for w in r.literals if keywords.in_pass(w, r.gate)})
    return words if len(words) > FEW_WORDS else []


def branches_sql(rules: list[Rule]) -> str:
    """Array of the rules that hit; rules bound to keywords are skipped as a group."""
    words = pass_words(rules)
    bound = [_rule_branch(i, r, words) for i, r in enumerate(rules) if words and _needs_word(r)]
    free = [_rule_branch(i, r, words) for i, r in enumerate(rules) if not (words and _needs_word(r))]
    hit = f"contains(h.marked, {sql_text(MARK)})"
    parts = []
    if free:
        parts.append(f"filter(array({', '.join(free)}), h -> {hit})")
    if bound:
        parts.append(
            f"CASE WHEN size({_FOUND}) > 0 THEN filter(array({', '.join(bound)}), h -> {hit}) "
            f"ELSE filter(array({bound[0]}), h -> false) END"
        )
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def lowered(text: Column) -> Column:
    """A text in lower case in which only ASCII letters become ASCII ones."""
    for ch in LOWERS_TO_ASCII:
        text = F.replace(text, F.lit(ch), F.lit("\x01"))
    return F.lower(text)


def odd_case(text: Column) -> Column:
    odd = F.lit(False)
    for ch in FOLDS_TO_ASCII:
        odd = odd | F.contains(text, F.lit(ch))
    return odd


def prepare(df: DataFrame, text: Column, path: Column, carry: list[str], rules: list[Rule]) -> DataFrame:
    """Columns the rule branches read."""
    words = pass_words(rules)
    body = F.coalesce(text, F.lit(""))
    body = F.when(body.startswith(BOM), F.substring(body, 2, 2**31 - 1)).otherwise(body)
    staged = df.select(*carry, path.alias(_PATH), body.alias(_TEXT))
    gates = sorted({r.gate for r in rules if r.gate and not (r.literals and _spared(r.gate, words))})
    staged = staged.select(
        "*",
        F.when(F.contains(F.col(_TEXT), F.lit(MARK)), F.col(_TEXT)).alias(_WHOLE),
        lowered(F.col(_TEXT)).alias(_LOWER),
        (F.octet_length(_TEXT) != F.length(_TEXT)).alias(_WIDE),
    )
    staged = staged.select("*", *(
        (F.col(_WIDE) & F.col(_TEXT).rlike(keywords.GATES[g]) if g == "cjk" else F.col(_TEXT).rlike(keywords.GATES[g]))
        .alias(_GATE + g)
        for g in gates
    ))
    found = "CAST(array() AS array<string>)"
    if words:
        any_gate = " OR ".join(_GATE + g for g in gates if g != "cjk")
        found = (
            f"CASE WHEN {any_gate} THEN array_distinct(regexp_extract_all({_LOWER}, "
            f"{sql_text(keywords.pass_pattern(words))}, 1)) ELSE {found} END"
        )
    return staged.select(
        "*",
        F.expr(found).alias(_FOUND),
        odd_case(F.col(_TEXT)).alias(_ODD),
        path_fn.is_env_path(F.col(_PATH)).alias(_ENV),
        path_fn.is_code_path(F.col(_PATH)).alias(_CODE),
    )


def parts_sql(marked: str, whole: str, pattern: str) -> str:
    """What a marked text is made of: text between matches and matches by turns."""
    gaps, texts = f"split({whole}, {pattern}, -1)", f"regexp_extract_all({whole}, {pattern}, 0)"
    by_turns = arrays.let_sql(gaps, lambda g: arrays.let_sql(texts, lambda m: (
        f"flatten(transform({g}, (x, i) -> IF(i < size({m}), array(x, {m}[i]), array(x))))"
    )))
    return f"IF({whole} IS NULL, split({marked}, {sql_text(MARK)}, -1), {by_turns})"


def spans_sql(marked: str, whole: str, pattern: str, rule_id: str) -> str:
    """Positions of all matches of one rule in one text, as SQL.

    Running totals of the lengths of all parts are exact offsets in code
    points. What stands beside a match is given to the one rule that asks.
    """
    nl, tail = arrays.newlines_sql, arrays.after_last_newline_sql

    def located(parts: str) -> str:
        facts = (
            f"transform({parts}, p -> IF(contains(p, '\\n'), "
            f"named_struct('n', CAST(length(p) AS BIGINT), 'b', CAST({nl('p')} AS BIGINT), 't', CAST({tail('p')} AS BIGINT)), "
            f"named_struct('n', CAST(length(p) AS BIGINT), 'b', 0L, 't', 0L)))"
        )

        def with_facts(f: str) -> str:
            return arrays.let_sql(arrays.sums_before_sql(f"{f}.n"), lambda start: arrays.let_sql(
                arrays.sums_before_sql(f"{f}.b"), lambda above: arrays.let_sql(arrays.max_before_sql(
                    f"transform({f}, (x, i) -> IF(x.b > 0, {start}[i] + x.n - x.t - 1, -1L))"
                ), lambda last: build(start, above, last))))

        def build(start: str, above: str, last: str) -> str:
            beside = f"{rule_id} = 'pii.ja.phone'"
            return (
                f"transform(sequence(1, size({parts}) - 2, 2), k -> named_struct('value', {parts}[k], 'start', {start}[k], "
                f"'line', CAST(1 + {above}[k] AS INT), 'column', CAST({start}[k] - {last}[k] AS INT), "
                f"'gap', {parts}[k - 1], "
                f"'left', IF({beside}, right(concat(coalesce(get({parts}, k - 2), ''), {parts}[k - 1]), 2), ''), "
                f"'right', IF({beside}, left(concat({parts}[k + 1], coalesce(get({parts}, k + 2), '')), 2), '')))"
            )

        return arrays.let_sql(facts, with_facts)

    return arrays.let_sql(parts_sql(marked, whole, pattern), located)


def checks() -> dict:
    """The check that belongs to a rule; rules without one accept every match."""
    v = validators
    labelled = lambda s: v.labelled_token_ok(s["value"])
    return {
        "pii.email": lambda s: v.email_ok(s["value"]),
        "pii.credit_card": lambda s: v.luhn(s["value"]),
        "pii.ja.phone": lambda s: v.ja_phone_ok(s["value"]) & ~v.ja_phone_embedded(s["left"], s["right"]),
        "pii.ja.postal_code": lambda s: v.ja_postal_ok(s["value"]),
        "pii.ja.address": lambda s: v.ja_address_ok(s["value"]),
        "secret.openai_api_key": lambda s: v.openai_ok(s["value"]),
        "secret.generic_api_key": lambda s: (
            v.generic_key_ok(s["value"]) & ~v.generic_key_public(s["gap"], s["value"])
        ),
        "secret.twilio_auth_token": labelled,
        "secret.vercel_token": labelled,
        "secret.cloudflare_api_token": labelled,
        "secret.notion_integration_token": labelled,
        "env.sensitive_assignment": lambda s: v.env_assign_ok(s["value"]),
        "ai_context.embedded_bom": lambda s: s["start"] > 0,
    }


def match_is_valid(rules: list[Rule], rule_id: Column, span: Column) -> Column:
    out = None
    present = {r.rule_id for r in rules}
    for name, check in checks().items():
        if name in present:
            test = rule_id == name
            out = F.when(test, check(span)) if out is None else out.when(test, check(span))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _allow_hit(allow: providers.Allow, secret: Column, whole: Column, path: Column) -> Column:
    target = whole if allow.target == "match" else secret
    tests = []
    if allow.regexes:
        tests.append(target.rlike("|".join(f"(?:{dialect.to_java(r)})" for r in allow.regexes)))
    if allow.paths:
        tests.append(path.rlike("|".join(f"(?:{dialect.to_java(r)})" for r in allow.paths)))
    if allow.stopwords:
        stop = F.lit(False)
        for word in allow.stopwords:
            stop = stop | F.contains(secret, F.lit(word))
        tests.append(stop)
    out = tests[0]
    for test in tests[1:]:
        out = (out & test) if allow.condition == "and" else (out | test)
    return out


def rule_allows(rules: list[Rule], rule_id: Column, secret: Column, whole: Column, path: Column) -> Column:
    """Exceptions shipped with a rule: documented sample keys and the like."""
    out = None
    for rule in rules:
        if not rule.allow:
            continue
        hit = F.lit(False)
        for allow in rule.allow:
            hit = hit | _allow_hit(allow, secret, whole, path)
        out = F.when(rule_id == rule.rule_id, hit) if out is None else out.when(rule_id == rule.rule_id, hit)
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def enough_entropy(secret: Column, floor: Column) -> Column:
    return floor.isNull() | (validators.entropy(secret) + F.lit(1e-6) >= floor)


def _group_value(rules: list[Rule], rule_id: Column, span: Column) -> Column:
    """Narrow the match to a rule's value group, position included."""
    out = None
    for rule in rules:
        if rule.secret_group is None:
            continue
        whole = span["value"]
        head = F.regexp_extract(whole, rule.lead, 0)
        lines = arrays.newlines(head)
        column = F.when(lines > 0, F.lit(1) + arrays.after_last_newline(head)).otherwise(span["column"] + F.length(head))
        moved = F.struct(
            F.regexp_extract(whole, rule.java, rule.secret_group).alias("value"),
            whole.alias("whole"),
            (span["start"] + F.length(head)).alias("start"),
            (span["line"] + lines).cast("int").alias("line"),
            column.cast("int").alias("column"),
            *(span[f].alias(f) for f in ("gap", "left", "right")),
        )
        test = rule_id == rule.rule_id
        out = F.when(test, moved) if out is None else out.when(test, moved)
    plain = F.struct(
        span["value"].alias("value"), span["value"].alias("whole"),
        *(span[f].alias(f) for f in ("start", "line", "column", "gap", "left", "right")),
    )
    return plain if out is None else out.otherwise(plain)


def valid_spans(rules: list[Rule], rule: Column, spans: Column) -> Column:
    """Spans of one rule narrowed to its value group, those that its checks accept; ``rule`` is a rule struct."""
    rule_id = rule["rule_id"]

    def accepted(s: Column) -> Column:
        ok = match_is_valid(rules, rule_id, s)
        if any(r.entropy is not None for r in rules):
            ok = ok & enough_entropy(s["value"], rule["entropy"])
        if any(r.allow for r in rules):
            ok = ok & ~rule_allows(rules, rule_id, s["value"], s["whole"], F.col(_PATH))
        return ok

    return F.filter(F.transform(spans, lambda s: _group_value(rules, rule_id, s)), accepted)


def hits(
    df: DataFrame,
    policy: Policy = Policy(),
    *,
    text: str | Column = "text",
    path: str | Column = "path",
    carry: list[str] | None = None,
    rules: list[Rule] | None = None,
    ignores: Column | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """One row per document and rule whose pattern occurs: rule facts and matches.

    ``matches`` is empty when the checks rejected every occurrence. Filtering on
    it here would make Catalyst evaluate the array twice, so readers explode.

    ``ignores`` is an optional array of ``(line, rule)`` directives that travels
    with the document.
    """
    rules = rules_for(policy) if rules is None else rules
    text = F.col(text) if isinstance(text, str) else text
    path = F.col(path) if isinstance(path, str) else path
    carry = [c for c in df.columns if c not in ("text",)] if carry is None else carry
    base = prepare(df, text, path, carry, rules)
    if ignores is not None:
        base = base.withColumn(_IGNORES, ignores)
        travel = [_IGNORES]
    else:
        travel = []
    if not rules:
        raise ValueError("no rule is enabled")
    rows = base.select(
        *carry, _PATH, _WHOLE, *([_TEXT] if keep_text else []), *travel,
        F.explode_outer(F.expr(branches_sql(rules))).alias("hit"),
    ).where(F.col("hit").isNotNull())
    rows = rows.withColumn("spans", F.expr(spans_sql("hit.marked", _WHOLE, "hit.pattern", "hit.rule_id")))
    matches = F.transform(
        valid_spans(rules, F.col("hit"), F.col("spans")),
        lambda s: F.struct(
            s["value"].alias("value"),
            F.concat(
                F.lit(hashing.HASH_PREFIX), hashing.hmac_hex(F.col("hit.inner"), F.col("hit.outer"), s["value"])
            ).alias("value_hash"),
            s["start"].alias("start"), s["line"].alias("line"), s["column"].alias("column"),
        ),
    )
    meta = ["number", "rule_id", "severity", "kind", "message", "confidence"]
    return rows.select(
        *carry, F.col(_PATH).alias("file"), *travel, *([_TEXT] if keep_text else []),
        *(F.col(f"hit.{m}").alias(m) for m in meta), matches.cast(MATCH_TYPE).alias("matches"),
    )


def matches(df: DataFrame, policy: Policy = Policy(), **options) -> DataFrame:
    """One row per match, raw value included; for use inside a job only."""
    rows = hits(df, policy, **options)
    keep = [c for c in rows.columns if c != "matches"]
    return rows.select(*keep, F.explode_outer("matches").alias("m")).where(F.col("m").isNotNull()).select(
        *keep, "m.*"
    )


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity) - 1, F.lit(0)).cast("int")
