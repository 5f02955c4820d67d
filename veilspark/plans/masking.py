"""Queries for masking."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import mask, scan
from ..policy import MaskSettings, Policy
from ..rules.table import builtin
from . import detection, scanning
from .kit import REGISTRY, derived, for_oracle, planted
from .samples import Pool, quote

RULES = [r for r in builtin() if r.rule_id in ("pii.email", "secret.aws_access_key", "pii.en.ssn", "pii.ipv4")]
_p = Pool("doc_id", "m")
MAIL = f"concat('user', {_p.digits(5)}, '@mail.example.test')"
KEY = f"concat('AKIA', upper({_p.take(16)}))"
HOST = "concat('10.1.2.', cast(doc_id % 200 as string))"
# the value also occurs where the rule alone would not match it: next to letters
LINE = f"concat('x', {KEY}, 'y ', {KEY}, ' and ', {MAIL}, chr(13), chr(10), 'host ', {HOST}, ' plain', chr(10), 'last ', {MAIL})"
SRC = planted(LINE).replace(", chr(10)) AS text", ") AS text")
MEDIUM = MaskSettings()


def _masked(spark, sf_dir, settings=MEDIUM, src=SRC, rules=RULES):
    docs = derived(spark, sf_dir, src)
    return mask.mask(docs, Policy(mask=settings), rules=rules).select("doc_id", "text")


EMAIL = detection.re2(next(r.re2 for r in RULES if r.rule_id == "pii.email"))
IPV4 = detection.re2(next(r.re2 for r in RULES if r.rule_id == "pii.ipv4"))
SSN = detection.re2(next(r.re2 for r in RULES if r.rule_id == "pii.en.ssn"))
AKIA = quote("(AKIA|ASIA)[0-9A-Z]{16}")
BASE = f"WITH src AS ({for_oracle(SRC)})"


def chain(text: str, repl: str = "'[REDACTED]'") -> str:
    for pattern in (EMAIL, AKIA, SSN):
        text = f"regexp_replace({text}, {pattern}, {repl}, 'g')"
    return text


for _key in ("mask_match", "sink_masked"):
    REGISTRY.put(_key, lambda spark, sf_dir: _masked(spark, sf_dir), f"{BASE} SELECT doc_id, {chain('text')} AS text FROM src")


@REGISTRY.add("mask_min_severity", f"""{BASE} SELECT doc_id, 'medium' AS floor, {chain('text')} AS text FROM src
UNION ALL SELECT doc_id, 'high', regexp_replace(text, {AKIA}, '[REDACTED]', 'g') FROM src""")
def mask_min_severity(spark, sf_dir):
    floors = [_masked(spark, sf_dir, MaskSettings(min_severity=f)).withColumn("floor", F.lit(f)) for f in ("medium", "high")]
    return floors[0].unionByName(floors[1]).select("doc_id", "floor", "text")


# a lone carriage return, both orders of the pair, and no end at the last line
_ENDINGS = planted(f"concat('a ', {MAIL}, chr(13), 'b ', {KEY}, chr(13), chr(10), 'c', chr(10), chr(13), {MAIL}, chr(13), chr(13), chr(10), chr(10), 'd ', {MAIL})").replace(", chr(10)) AS text", ") AS text")


@REGISTRY.add("mask_line_endings", f"WITH src AS ({for_oracle(_ENDINGS)}) SELECT doc_id, {chain('text')} AS text FROM src")
def mask_line_endings(spark, sf_dir):
    return _masked(spark, sf_dir, src=_ENDINGS)


@REGISTRY.add("mask_full_line", f"""{BASE} SELECT doc_id, array_to_string([CASE WHEN regexp_matches(l, {EMAIL}) OR regexp_matches(l, {AKIA}) OR regexp_matches(l, {SSN})
THEN '[REDACTED_LINE]' || CASE WHEN l LIKE '%' || chr(13) THEN chr(13) ELSE '' END ELSE l END for l in string_split(text, chr(10))], chr(10)) AS text FROM src""")
def mask_full_line(spark, sf_dir):
    return _masked(spark, sf_dir, MaskSettings("full"))


_EDGES = quote(r"\1[REDACTED]\2")


@REGISTRY.add("mask_partial", f"""{BASE}, a AS (SELECT doc_id, regexp_replace(text, {quote('([A-Za-z0-9._%+-]{2})([A-Za-z0-9._%+-]*@[a-zA-Z0-9.-]+[.])([a-zA-Z]*?)([a-zA-Z]{2})' + chr(92) + 'b')}, {quote(chr(92) + '1[REDACTED]' + chr(92) + '4')}, 'g') AS text FROM src)
SELECT doc_id, regexp_replace(regexp_replace(text, {quote('(AK)IA[0-9A-Z]{14}([0-9A-Z]{2})')}, {_EDGES}, 'g'), {SSN}, '[REDACTED]', 'g') AS text FROM a""")
def mask_partial(spark, sf_dir):
    return _masked(spark, sf_dir, MaskSettings("partial", 2, 2))


_FN = "SELECT p_partkey AS id, p_name AS value FROM {part}"


@REGISTRY.add("fn_partial_value", """SELECT p_partkey AS id, CASE WHEN 14 > length(p_name) THEN '[REDACTED]'
ELSE left(p_name, 4) || '[REDACTED]' || right(p_name, 3) END AS shown FROM part""")
def fn_partial_value(spark, sf_dir):
    return derived(spark, sf_dir, _FN).select("id", mask.partial_value(F.col("value"), 4, 3).alias("shown"))


@REGISTRY.add("set_values_distinct", f"""WITH src AS ({for_oracle(SRC)}) SELECT doc_id, len(list_distinct(regexp_extract_all(text, {EMAIL}))) AS n FROM src""")
def set_values_distinct(spark, sf_dir):
    rows = scan.scan_rows(derived(spark, sf_dir, SRC), carry=["doc_id"], rules=[r for r in RULES if r.rule_id == "pii.email"])
    return rows.select("doc_id", F.size("found").alias("n"))


# a key body, an open key and text after it
_hex = Pool("doc_id", "k")
CLOSED = f"concat('-----BEGIN RSA PRIVATE KEY-----', chr(10), {_hex.take(64)}, chr(10), {_hex.take(20)}, chr(10), '-----END RSA PRIVATE KEY-----')"
OPEN = f"concat('-----BEGIN PRIVATE KEY-----', chr(10), 'Proc-Type: 4,ENCRYPTED', chr(10), chr(10), {_hex.take(64)}, chr(10), 'plain words follow here')"
KEYS = planted(f"concat({CLOSED}, chr(10), 'between', chr(10), {OPEN})")
_TAIL = ("chr(10), '[REDACTED]', chr(10), '[REDACTED]', chr(10), '[REDACTED]', chr(10), '[REDACTED]', chr(10), 'between', chr(10), "
         "'[REDACTED]', chr(10), '[REDACTED]', chr(10), chr(10), '[REDACTED]', chr(10), 'plain words follow here', chr(10)")
KEY_RULES = [r for r in builtin() if r.rule_id == "secret.private_key_block"]


@REGISTRY.add("mask_key_blocks", f"SELECT doc_id, concat(coalesce(text, ''), {_TAIL}) AS text FROM documents")
def mask_key_blocks(spark, sf_dir):
    return _masked(spark, sf_dir, src=KEYS, rules=KEY_RULES)


@REGISTRY.add("det_private_key_blocks", f"""SELECT doc_id, cast(length(coalesce(text, '')) + 1 AS INT) AS s, cast(length(coalesce(text, '')) + 1 + length({CLOSED}) AS INT) AS e FROM documents
UNION ALL SELECT doc_id, cast(length(coalesce(text, '')) + 1 + length({CLOSED}) + 9 AS INT), cast(length(coalesce(text, '')) + 1 + length({CLOSED}) + 9 + length({OPEN}) - 24 AS INT) FROM documents""")
def det_private_key_blocks(spark, sf_dir):
    docs = derived(spark, sf_dir, KEYS)
    return docs.select("doc_id", F.explode(mask.key_blocks(F.col("text"))).alias("b")).select("doc_id", "b.s", "b.e")


# a label on one line and its value on the next
SPLIT = planted(f"concat('ssn', chr(10), '  ', {_p.digits(3)}, '-', {_p.digits(2)}, '-', {_p.digits(4)}, chr(10), 'end')")
SSN_RULES = [r for r in builtin() if r.rule_id == "pii.en.ssn"]


@REGISTRY.add("mask_residual", "SELECT doc_id, concat(coalesce(text, ''), chr(10), '[REDACTED]', chr(10), '  [REDACTED]', chr(10), 'end', chr(10)) AS text FROM documents")
def mask_residual(spark, sf_dir):
    return _masked(spark, sf_dir, src=SPLIT, rules=SSN_RULES)


@REGISTRY.add("mask_bytes", f"WITH src AS ({for_oracle(SRC)}) SELECT doc_id, md5({chain('text')}) AS digest FROM src")
def mask_bytes(spark, sf_dir):
    docs = derived(spark, sf_dir, SRC).withColumn("content", F.encode("text", "UTF-8")).drop("text")
    out = mask.mask_bytes(docs, Policy(mask=MEDIUM), rules=RULES)
    return out.select("doc_id", F.md5("content").alias("digest"))


DISPLAY_RULES = [r for r in builtin() if r.rule_id in ("pii.email", "secret.aws_access_key")]
_SHOWN = f"concat('mail ', {MAIL}, ' key ', {KEY}, ' card 4111-1111-1111-1112 ', coalesce(text, ''))"
_LINES = f"SELECT doc_id, replace({_SHOWN}, chr(10), ' ') AS line FROM {{documents}}"
_RED = f"regexp_replace(regexp_replace(line, {EMAIL}, '[REDACTED]', 'g'), {AKIA}, '[REDACTED]', 'g')"


@REGISTRY.add("mask_display_line", f"""SELECT doc_id, CASE WHEN length({_RED}) > 200 THEN concat(left({_RED}, 200), '…') ELSE {_RED} END AS shown
FROM ({for_oracle(_LINES)})""")
def mask_display_line(spark, sf_dir):
    lines = derived(spark, sf_dir, _LINES)
    return lines.select("doc_id", mask.display_line(F.col("line"), DISPLAY_RULES).alias("shown"))


OTHER_KEY = f"concat('AKIA', upper({Pool('doc_id', 'c').take(16)}))"
CONTEXT = planted(f"concat('before ', {MAIL}, chr(10), 'key ', {KEY}, chr(10), 'after ', {OTHER_KEY}, chr(10), 'tail')")


@REGISTRY.add("prj_context", """WITH d AS (SELECT doc_id, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS n FROM documents)
SELECT doc_id, cast(n + 3 AS INT) AS line, 'before [REDACTED]' AS before, 'after [REDACTED]' AS after FROM d
UNION ALL SELECT doc_id, cast(n + 4 AS INT), 'key [REDACTED]', 'tail' FROM d""")
def prj_context(spark, sf_dir):
    """The lines around every finding."""
    aws = [r for r in builtin() if r.rule_id == "secret.aws_access_key"]
    rows = scan.scan_rows(derived(spark, sf_dir, CONTEXT), carry=["doc_id"], rules=aws, keep_text=True)
    each = rows.select("doc_id", "__text", F.explode_outer(F.array_distinct(F.transform("found", lambda m: m["line"]))).alias("line")).where("line IS NOT NULL")
    shown = mask.context(each, DISPLAY_RULES)
    return shown.select("doc_id", "line", F.get("context_before", F.lit(0)).alias("before"), F.get("context_after", F.lit(0)).alias("after"))
