"""Masking: text in, text out, line structure kept.

Two passes as in a careful manual redaction. The first looks at each line on its
own and replaces every occurrence of what matched there. The second looks at
the whole text for values that only match across lines. Both work inside the
document's row, so masking a table is a narrow map without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.arrays import let
from ..functions.validators import SPACE
from ..policy import MaskSettings, Policy, severity_rank
from ..rules import dialect, tuned
from ..rules.table import Rule, rules_for
from . import detect
from .detect import BOM, _CODE, _LOWER, _ODD, _PATH, _TEXT, cheap_test, pass_words, sql_text

MARKER = "[REDACTED]"
LINE_MARKER = "[REDACTED_LINE]"
ROUNDS = 4
_RULES, _LINES, _STARTS, _BLOCKS, _BOM, _MASKED, _LOW = (
    "__rules", "__lines", "__starts", "__blocks", "__bom", "__masked", "__low_lines"
)
# literals that many lines hold without a match
COMMON = (".", ":", "-", "=")
SPAN = "struct<s:int,e:int,forced:boolean>"
MAX = 2**31 - 1


def partial_value(value: Column, prefix: int, suffix: int) -> Column:
    """Keep the edges of a value, but never more than half of it."""
    kept = prefix + suffix
    edges = F.concat(F.left(value, F.lit(prefix)), F.lit(MARKER), F.right(value, F.lit(suffix)))
    return F.when(F.lit(2 * kept) > F.length(value), MARKER).otherwise(edges)


# -- which rules can matter for a document ---------------------------------------


def _rule_struct(rule: Rule, words: list[str], floor: int) -> str:
    tests = cheap_test(rule, words)
    if rule.rule_id == "ai_context.bidi_control" and floor > rule.rank:
        tests.append(_CODE)
    keys = rule.literals if rule.source == "provider" else ()
    body = (
        f"named_struct('rule_id', {sql_text(rule.rule_id)}, 'pattern', {sql_text(rule.java)}, "
        f"'line_pattern', {sql_text(rule.line_java or '(?s).')}, "
        f"'words', CAST(array({', '.join(map(sql_text, keys))}) AS array<string>), "
        f"'literals', CAST(array({', '.join(map(sql_text, rule.literals))}) AS array<string>), "
        f"'rare', {'true' if rule.literals and not set(COMMON) & set(rule.literals) else 'false'}, "
        f"'folds', {'true' if rule.folds_case and rule.source != 'provider' else 'false'}, "
        f"'entropy', CAST({'NULL' if rule.entropy is None else rule.entropy} AS DOUBLE))"
    )
    return f"CASE WHEN {' AND '.join(tests)} THEN {body} END" if tests else body


def _usable(rules: list[Rule], floor: int) -> list[Rule]:
    high = severity_rank(tuned.CODE_SEVERITY)
    return [r for r in rules if r.rank >= floor or (r.rule_id == "ai_context.bidi_control" and high >= floor)]


def plain_spans(text: Column, pattern: Column) -> Column:
    """Matches of a pattern with offsets and what validators look at."""

    def located(texts: Column, gaps: Column) -> Column:
        sizes = F.transform(texts, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("bigint"))
        return let(arrays.sums_before_of(sizes), lambda origin: with_origin(texts, gaps, origin))

    def with_origin(texts: Column, gaps: Column, origin: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            gap = F.get(gaps, i)
            before = F.get(origin, i) + F.length(gap)
            previous = F.coalesce(F.get(texts, i - 1), F.lit(""))
            following = F.concat(F.coalesce(F.get(gaps, i + 1), F.lit("")), F.coalesce(F.get(texts, i + 1), F.lit("")))
            return F.struct(
                m.alias("value"), before.alias("start"), F.lit(1).alias("line"), F.lit(1).alias("column"),
                gap.alias("gap"), F.right(F.concat(previous, gap), F.lit(2)).alias("left"),
                F.left(following, F.lit(2)).alias("right"),
            )

        return F.transform(texts, one)

    return let(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        # without a match the text is not cut
        lambda texts: let(F.when(F.size(texts) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")),
                          lambda gaps: located(texts, gaps)),
    )


def valid_spans(rules: list[Rule], rule: Column, text: Column) -> Column:
    """Accepted matches of one rule in one text; ``rule`` is a rule struct."""
    return detect.valid_spans(rules, rule, plain_spans(text, rule["pattern"]))


def _has_literal(rule: Column, low: Column, odd: Column) -> Column:
    """A rule with literals cannot match a text that holds none of them; ``low`` is that text in lower case."""
    return (F.size(rule["literals"]) == 0) | F.exists(rule["literals"], lambda w: F.contains(low, w)) | (rule["folds"] & odd)


def _has_word(rule: Column, text: Column) -> Column:
    return (F.size(rule["words"]) == 0) | let(
        F.lower(text), lambda low: F.exists(rule["words"], lambda w: F.contains(low, w))
    )


# -- private key blocks ------------------------------------------------------------

# --- fixed values: header lines of armored keys ------------------------------------
ARMOR_HEADERS = "Proc-Type DEK-Info Comment Version Hash Charset MessageID".split()
MIN_DECORATED_BODY = 16
_BASE64 = "[A-Za-z0-9+/=]"
_LEAD = r"""[\s\x{85}\p{Z}>+"']*"""
_TRAIL = r"""(?:\\[nr]|[\\,+;"'\s\x{85}\p{Z}])*"""
HEADER = dialect.to_java(tuned.PRIVATE_KEY_HEADER)
FOOTER = dialect.to_java(tuned.PRIVATE_KEY_FOOTER)
_BODY = rf"\A{_LEAD}({_BASE64}{{{MIN_DECORATED_BODY - 1},}}[A-Za-z0-9/=]){_TRAIL}\z"


def _line_class(line: Column) -> Column:
    """What a line after an unclosed key header is: blank, armor, decorated body, or other."""
    return (
        F.when(line.rlike(rf"\A{_LEAD}{_TRAIL}\z"), "_")
        .when(line.rlike(rf"\A{SPACE}*(?:{'|'.join(ARMOR_HEADERS)}){SPACE}*:"), "a")
        .when(line.rlike(rf"\A{SPACE}*{_BASE64}+{SPACE}*\z"), "a")
        .when(line.rlike(_BODY), "d")
        .otherwise("x")
    )


def _open_block(segment: Column) -> Column:
    """Length of the part after an unclosed header that belongs to the key."""
    right_trim = lambda c: F.regexp_replace(c, rf"{SPACE}+\z", "")

    def measure(lines: Column) -> Column:
        first = right_trim(F.get(lines, F.lit(0)))
        flags = F.transform(F.slice(lines, F.lit(2), F.size(lines)), _line_class)

        def body(marks: Column) -> Column:
            kept = F.regexp_extract(F.array_join(marks, ""), r"\A[_ad]*[ad]", 0)

            def end(n: Column) -> Column:
                last = F.get(lines, n)
                tail = F.when(
                    F.get(marks, n - 1) == "d",
                    F.concat(F.regexp_extract(last, rf"\A{_LEAD}", 0), F.regexp_extract(last, _BODY, 1)),
                ).otherwise(right_trim(last))
                full = F.concat(F.array_join(F.slice(lines, F.lit(1), n), "\n"), F.lit("\n"), tail)
                return F.when(n > 0, F.length(full)).otherwise(F.length(first))

            return let(F.length(kept), end)

        bare = F.get(lines, F.lit(0)).rlike(rf"\A{_LEAD}{_TRAIL}\z")
        return F.when(bare, let(flags, body)).otherwise(F.length(first))

    return let(F.split(segment, "\n", -1), measure)


def key_blocks(text: Column) -> Column:
    """Ranges of private keys: header to footer, or the armor lines after an open header."""

    def ranges(heads: Column, gaps: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            start = F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(
                F.slice(heads, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)
            )
            segment = F.get(gaps, i + 1)
            inside = F.when(
                segment.rlike(FOOTER), F.length(F.regexp_extract(segment, rf"\A(?s:.*?)(?:{FOOTER})", 0))
            ).otherwise(_open_block(segment))
            return F.struct(
                start.cast("int").alias("s"), (start + F.length(h) + inside).cast("int").alias("e"),
                F.lit(True).alias("forced"),
            )

        return F.transform(heads, one)

    found = let(
        F.regexp_extract_all(text, F.lit(HEADER), F.lit(0)),
        lambda heads: let(F.split(text, HEADER, -1), lambda gaps: ranges(heads, gaps)),
    )
    return F.when(F.contains(text, F.lit("PRIVATE KEY")), found).otherwise(F.array().cast(f"array<{SPAN}>"))


# -- pass one: lines -----------------------------------------------------------------


def _occurrences(line: Column, value: Column) -> Column:
    """Every non-overlapping occurrence of a literal value in a line."""
    quoted = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))

    def spans(gaps: Column) -> Column:
        def one(_g: Column, i: Column) -> Column:
            at = F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)) + i * F.length(value)
            return F.struct(at.alias("s"), (at + F.length(value)).alias("e"), F.lit(False).alias("forced"))

        return F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), one)

    return let(F.split(line, quoted, -1), spans)


def merge_spans(spans: Column) -> Column:
    """Overlapping spans become one; spans that only touch stay apart."""
    ordered = F.array_sort(F.transform(
        spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), x["e"].alias("e"), x["forced"].alias("forced"))
    ))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(
            last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), (last["forced"] | x["forced"]).alias("forced")
        )
        fresh = F.struct(x["s"].alias("s"), x["e"].alias("e"), x["forced"].alias("forced"))
        overlap = (F.size(acc) > 0) & (x["s"] < F.get(acc, F.size(acc) - 1)["e"])
        return F.when(overlap, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(
            F.concat(acc, F.array(fresh))
        )

    return F.aggregate(ordered, F.array().cast(f"array<{SPAN}>"), step)


def replace_spans(text: Column, spans: Column, replacement) -> Column:
    """Rebuild a text with its (disjoint, ordered) spans replaced."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), replacement(x)).alias("out"),
            x["e"].alias("at"),
        )

    return F.aggregate(
        spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(MAX)))
    )


def mask_line(line: Column, values: Column, blocks: Column, settings: MaskSettings) -> Column:
    """Replace every occurrence of the values and the forced spans in one line."""
    def repl(x: Column) -> Column:
        if settings.redaction != "partial":
            return F.lit(MARKER)
        kept = partial_value(
            F.substring(line, x["s"] + 1, x["e"] - x["s"]), settings.preserve_prefix, settings.preserve_suffix
        )
        return F.when(x["forced"], MARKER).otherwise(kept)

    touched = (F.size(values) > 0) | (F.size(blocks) > 0)
    if settings.redaction == "full":
        return F.when(touched, LINE_MARKER).otherwise(line)
    spans = F.concat(blocks.cast(f"array<{SPAN}>"), F.flatten(F.transform(values, lambda v: _occurrences(line, v))))
    return F.when(touched, let(merge_spans(spans), lambda ms: replace_spans(line, ms, repl))).otherwise(line)


def _line_values(rules: list[Rule], lines: Column) -> Column:
    """Per candidate rule and line: the values that rule finds in that line.

    The rule is the outer loop, so its pattern is compiled once per document.
    """
    empty = F.array().cast("array<string>")

    def of_rule(r: Column) -> Column:
        return F.transform(lines, lambda x, i: F.when(
            _has_literal(r, F.get(F.col(_LOW), i), F.col(_ODD)) & _has_word(r, x),
            F.transform(valid_spans(rules, r, x), lambda s: s["value"]),
        ).otherwise(empty))

    return F.transform(
        F.filter(F.col(_RULES), lambda r: r["rare"] | F.rlike(F.col(_TEXT), r["line_pattern"])), of_rule)


def _blocks_of_line(blocks: Column, start: Column, length: Column) -> Column:
    cut = F.transform(blocks, lambda b: F.struct(
        (F.greatest(b["s"].cast("long"), start) - start).cast("int").alias("s"),
        (F.least(b["e"].cast("long"), start + length) - start).cast("int").alias("e"), F.lit(True).alias("forced"),
    ))
    return F.filter(cut, lambda b: b["s"] < b["e"])


def _first_pass(rules: list[Rule], settings: MaskSettings) -> Column:
    raw = F.col(_LINES)
    bare = F.transform(raw, lambda x, i: F.when(
        (i < F.size(raw) - 1) & F.endswith(x, F.lit("\r")), F.left(x, F.length(x) - 1)).otherwise(x))

    def masked(lines: Column, values: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            found = F.array_distinct(F.flatten(F.transform(values, lambda v: F.get(v, i))))
            blocks = _blocks_of_line(F.col(_BLOCKS), F.get(F.col(_STARTS), i), F.length(x))
            new = let(found, lambda vs: let(blocks, lambda bs: mask_line(x, vs, bs, settings)))
            whole = F.concat(new, F.when(F.length(F.get(raw, i)) > F.length(x), "\r").otherwise(""))
            changed = (F.size(_BLOCKS) > 0) | F.exists(values, lambda v: F.size(F.get(v, i)) > 0)
            return F.when(changed, whole).otherwise(F.get(raw, i))

        return F.array_join(F.transform(lines, one), "\n")

    return let(bare, lambda lines: let(_line_values(rules, lines), lambda values: masked(lines, values)))


# -- pass two: across lines ------------------------------------------------------------


def _mark_piece(piece: Column, settings: MaskSettings) -> Column:
    """One marker per line of a match; indentation and line ends stay."""
    if settings.redaction == "full":
        mark = lambda x: F.regexp_replace(x, r"(?s)\A.*?(\r*)\z", LINE_MARKER.replace("[", r"\[") + "$1")
    else:
        mark = lambda x: F.regexp_replace(
            x, r"(?s)\A([\s\x{85}\p{Z}]*)([^\s\x{85}\p{Z}].*?)(\r*)\z", "$1" + MARKER.replace("[", r"\[") + "$3"
        )
    return F.array_join(F.transform(F.split(piece, "\n", -1), mark), "\n")


def _residual(rules: list[Rule], settings: MaskSettings, text: Column) -> Column:
    """One round over the whole text; unchanged text when nothing matches."""
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def core(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["value"], rf"\A{SPACE}*", 0))
        body = F.length(F.regexp_replace(s["value"], rf"\A{SPACE}+|{SPACE}+\z", ""))
        begin = (s["start"] + lead).cast("int")
        if settings.redaction == "full":
            before, after = F.substring(text, F.lit(1), begin), F.substring(text, begin + body + 1, F.lit(MAX))
            line_start = begin - arrays.after_last_newline(before)
            rest = F.length(F.regexp_extract(after, r"\A[^\n]*?(?=\r?(?:\n|\z))", 0))
            return F.struct(line_start.cast("int").alias("s"), (begin + body + rest).cast("int").alias("e"))
        return F.struct(begin.alias("s"), (begin + body).cast("int").alias("e"))

    def found(low: Column) -> Column:
        def of_rule(r: Column) -> Column:
            spans = F.filter(F.transform(valid_spans(rules, r, text), core), lambda x: x["s"] < x["e"])
            return F.when(_has_literal(r, low, detect.odd_case(text)) & _has_word(r, text), spans).otherwise(empty)

        return F.flatten(F.transform(F.col(_RULES), of_rule))

    def rebuild(ranges: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def step(acc: Column, x: Column) -> Column:
            begin = F.greatest(x["s"], acc["at"])
            piece = F.substring(text, begin + 1, x["e"] - begin)
            grown = F.struct(
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, begin - acc["at"]), _mark_piece(piece, settings))
                .alias("out"),
                x["e"].alias("at"),
            )
            return F.when(x["e"] <= acc["at"], acc).otherwise(grown)

        ordered = F.array_sort(F.transform(
            ranges, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), x["e"].alias("e"))
        ))
        rebuilt = F.aggregate(
            ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(MAX)))
        )
        return F.when(F.size(ranges) > 0, rebuilt).otherwise(text)

    return let(let(detect.lowered(text), found), rebuild)


def mask(
    df: DataFrame,
    policy: Policy = Policy(),
    *,
    text: str = "text",
    path: str = "path",
    output: str | None = None,
    rules: list[Rule] | None = None,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Replace what the rules find at or above the policy's masking floor.

    The result has the input's columns; masked text replaces ``text`` or goes to
    ``output``.
    """
    settings = policy.mask
    floor = severity_rank(settings.min_severity)
    rules = _usable(rules_for(policy) if rules is None else rules, floor)
    carry = list(df.columns)
    words = pass_words(rules)
    base = detect.prepare(df, F.col(text), F.col(path), carry, rules)
    structs = ",\n".join(_rule_struct(r, words, floor) for r in rules)
    raw_text = F.coalesce(F.col(text), F.lit(""))
    blocks = key_blocks(F.col(_TEXT)) if policy.secrets else F.array().cast(f"array<{SPAN}>")
    staged = base.select(
        *carry, _PATH, _TEXT, raw_text.startswith(BOM).alias(_BOM),
        F.expr(f"filter(array({structs}), r -> r IS NOT NULL)").alias(_RULES), F.split(F.col(_TEXT), "\n", -1).alias(_LINES),
        F.split(F.col(_LOWER), "\n", -1).alias(_LOW), _ODD,
        blocks.alias(_BLOCKS),
    )
    staged = staged.withColumn(
        _STARTS, F.expr(arrays.sums_before_sql(f"transform({_LINES}, x -> CAST(length(x) + 1 AS BIGINT))"))
    )
    # a document no rule touches is passed on as it is
    touched = (F.size(_RULES) > 0) | (F.size(_BLOCKS) > 0)
    first = staged.withColumn(
        _MASKED, F.when(touched, _first_pass(rules, settings)).otherwise(F.col(_TEXT))
    ).withColumn("__touched", touched)

    def round_of(acc: Column, _i: Column) -> Column:
        # a round that changes nothing is the last one
        again = let(_residual(rules, settings, acc["text"]), lambda new: F.struct(
            new.alias("text"), (new == acc["text"]).alias("done")))
        return F.when(acc["done"], acc).otherwise(again)

    second = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.col(_MASKED).alias("text"), F.lit(False).alias("done")), round_of,
        lambda acc: acc["text"],
    ) if rounds else F.col(_MASKED)
    final = F.concat(
        F.when(F.col(_BOM), BOM).otherwise(""), F.when(F.col("__touched"), second).otherwise(F.col(_MASKED))
    )
    final = F.when(F.col(text).isNotNull(), final)
    target = output or text
    return first.select(*(c for c in carry if c != target), final.alias(target))


def mask_bytes(df: DataFrame, policy: Policy = Policy(), *, content: str = "content", path: str = "path", **options) -> DataFrame:
    """Mask content that is not valid UTF-8 by its ASCII bytes; other bytes stay."""
    wide = df.withColumn("__latin", F.decode(F.col(content), "ISO-8859-1"))
    masked = mask(wide, policy, text="__latin", path=path, **options)
    return masked.withColumn(content, F.encode("__latin", "ISO-8859-1")).drop("__latin")


# -- lines shown to people ---------------------------------------------------------------

DISPLAY_LIMIT = 200


def display_line(line: Column, rules: list[Rule]) -> Column:
    """A context line with everything the rules match replaced, cut for display."""
    structs = F.array(*(F.struct(
        F.lit(r.rule_id).alias("rule_id"), F.lit(r.source).alias("source"), F.lit(r.java).alias("pattern"),
        F.array(*(F.lit(w) for w in (r.literals if r.source == "provider" else ()))).cast("array<string>").alias("words"),
        F.lit(r.entropy).cast("double").alias("entropy"),
    ) for r in rules))

    def step(acc: Column, r: Column) -> Column:
        def checked(spans: Column) -> Column:
            hit = F.filter(spans, lambda s: detect.match_is_valid(rules, r["rule_id"], s))
            marked = F.transform(hit, lambda s: F.struct(
                s["start"].cast("int").alias("s"), (s["start"] + F.length(s["value"])).cast("int").alias("e")
            ))
            return let(marked, lambda ms: replace_spans(acc, ms, lambda _x: F.lit(MARKER)))

        plain = F.regexp_replace(acc, r["pattern"], F.lit(MARKER.replace("[", r"\[")))
        redone = F.when(r["source"] == "tuned", let(plain_spans(acc, r["pattern"]), checked)).otherwise(plain)
        return F.when(F.rlike(acc, r["pattern"]) & _has_word(r, acc), redone).otherwise(acc)

    redacted = F.aggregate(structs, line, step)
    return let(redacted, lambda x: F.when(
        F.length(x) > DISPLAY_LIMIT, F.concat(F.left(x, F.lit(DISPLAY_LIMIT)), F.lit("…"))
    ).otherwise(x))


def guarded_line(line: Column, start: Column, ranges: Column) -> Column:
    """Replace the parts of a line that key blocks or multi-line matches cover."""
    cut = F.filter(F.transform(ranges, lambda b: F.struct(
        (F.greatest(b["s"].cast("long"), start) - start).cast("int").alias("s"),
        (F.least(b["e"].cast("long"), start + F.length(line)) - start).cast("int").alias("e"), F.lit(True).alias("forced"),
    )), lambda b: b["s"] < b["e"])
    return let(merge_spans(cut), lambda ms: replace_spans(line, ms, lambda _x: F.lit(MARKER)))


def context(df: DataFrame, rules: list[Rule], *, text: str = "__text", line: str = "line") -> DataFrame:
    """Add ``context_before`` and ``context_after``: one redacted line each."""
    carry = [c for c in df.columns if c != text]
    staged = df.select(
        *carry, F.split(F.col(text), "\n", -1).alias(_LINES), key_blocks(F.col(text)).alias(_BLOCKS)
    ).withColumn(_STARTS, F.expr(arrays.sums_before_sql(f"transform({_LINES}, x -> CAST(length(x) + 1 AS BIGINT))")))
    lines = F.col(_LINES)
    count = F.when(F.element_at(lines, -1) == "", F.size(lines) - 1).otherwise(F.size(lines))

    def shown(at: Column) -> Column:
        bare = F.regexp_replace(F.get(lines, at), r"\r\z", "")
        safe = guarded_line(bare, F.get(F.col(_STARTS), at), F.col(_BLOCKS))
        inside = (at >= 0) & (at < count)
        empty = F.array().cast("array<string>")
        return F.when(inside, F.array(display_line(safe, rules))).otherwise(empty)

    return staged.select(
        *carry, shown(F.col(line) - 2).alias("context_before"), shown(F.col(line)).alias("context_after")
    )
