"""Queries for pseudonymization, restoring and their scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import normalize as norm
from ..functions.hashing import KeyMaterial
from ..operators import detect
from ..operators import pseudonymize as psd
from ..operators.pseudonymize import ResolvedColumn
from ..rules.table import builtin
from .kit import REGISTRY, derived, for_oracle, hmac_sql, planted
from .samples import Pool

KEY = KeyMaterial(bytes([0x33]) * 32, bytes([0x44]) * 32)
PEOPLE = """SELECT c_custkey AS id, CASE c_custkey % 11 WHEN 3 THEN 'N/A' WHEN 5 THEN concat('bad', cast(c_custkey as string)) WHEN 7 THEN concat(' User', cast(c_custkey % 50 as string), '+tag@Example.COM ')
ELSE concat('user', cast(c_custkey % 50 as string), '@example.com') END AS email,
CASE c_custkey % 7 WHEN 2 THEN '' WHEN 4 THEN '12-34' WHEN 5 THEN concat('+81 90 1234 ', lpad(cast(c_custkey % 100 + 1000 as string), 4, '0'))
ELSE concat('090-1234-', cast(c_custkey % 100 + 1000 as string)) END AS phone, c_name AS name, c_mktsegment AS note FROM {customer}"""
COLUMNS = [
    ResolvedColumn(1, "email", "email", "chosen"), ResolvedColumn(2, "phone", "phone", "chosen"),
    ResolvedColumn(3, "name", "name", "chosen"),
]

TRIM = "trim(regexp_replace({}, '[[:space:]]+', ' ', 'g'))"
N_EMAIL = (
    "CASE WHEN regexp_matches(lower({0}), '^[a-z0-9][a-z0-9.+]*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?[.])+[a-z]{{2,}}$') THEN lower({0}) END"
)
DIG = "regexp_replace({0}, '[^0-9]', '', 'g')"
N_PHONE = (
    "CASE WHEN {0} LIKE '+81%' AND length(" + DIG + ") = 12 THEN '+' || " + DIG
    + " WHEN {0} LIKE '0%' AND length(" + DIG + ") = 11 THEN '+81' || substr(" + DIG + ", 2) END"
)
MISSING = "('', 'NULL', 'null', 'N/A', '#N/A', '-', '—')"
_B32 = "abcdefghijklmnopqrstuvwxyz234567"


def token_sql(kind: str, value: str, bits: int = 64) -> str:
    digest = hmac_sql(KEY.kind_key(kind), value)
    chars = -(-bits // 5)
    padded = f"rpad(substr({digest}, 1, {bits // 4}), {((chars * 5 + 3) // 4)}, '0')"
    bit = "array_to_string([['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][position(h in '0123456789abcdef')] for h in string_split(hx, '')], '')"
    five = "[substr(bs, k * 5 + 1, 5) for k in range(0, {c})]".format(c=chars)
    value_of = "16 * cast(substr(q,1,1) AS INT) + 8 * cast(substr(q,2,1) AS INT) + 4 * cast(substr(q,3,1) AS INT) + 2 * cast(substr(q,4,1) AS INT) + cast(substr(q,5,1) AS INT) + 1"
    return (
        f"(SELECT '{hashing.token_prefix(kind)}_' || array_to_string([substr('{_B32}', {value_of}, 1) for q in {five}], '') "
        f"FROM (SELECT {bit} AS bs FROM (SELECT {padded} AS hx)))"
    )


def _cell(kind: str, column: str, value: str) -> str:
    return (
        f"CASE WHEN {TRIM.format(column)} IN {MISSING} THEN {column} WHEN {value} IS NULL THEN '[UNPARSED]' "
        f"ELSE {token_sql(kind, value)} END"
    )


E, P, N = (
    N_EMAIL.format(TRIM.format("email")), N_PHONE.format(TRIM.format("phone")), TRIM.format("name"),
)
BASE = f"people AS ({for_oracle(PEOPLE)})"
TABLE_SQL = f"""WITH {BASE} SELECT id, {_cell('email', 'email', E)} AS email, {_cell('phone', 'phone', P)} AS phone,
{_cell('name', 'name', N)} AS name, note FROM people"""


def people(spark, sf_dir):
    return derived(spark, sf_dir, PEOPLE)


for _key in ("psd_table", "sink_pseudonymized"):
    REGISTRY.put(_key, lambda spark, sf_dir: psd.pseudonymize_table(people(spark, sf_dir), COLUMNS, KEY), TABLE_SQL)


@REGISTRY.add("agg_replaced_unparsed", f"""WITH {BASE}, c AS (SELECT 'email' AS kind, {TRIM.format('email')} AS cell, {E} AS v FROM people
UNION ALL SELECT 'phone', {TRIM.format('phone')}, {P} FROM people UNION ALL SELECT 'name', {N}, {N} FROM people)
SELECT kind, count(*) FILTER (cell NOT IN {MISSING} AND v IS NOT NULL) AS replaced, count(*) FILTER (cell NOT IN {MISSING} AND v IS NULL) AS unparsed FROM c GROUP BY kind""")
def agg_replaced_unparsed(spark, sf_dir):
    return psd.replaced_unparsed(people(spark, sf_dir), COLUMNS, KEY)


MAP_SQL = f"""WITH {BASE}, c AS (SELECT id, 1 AS n, 'email' AS kind, {_cell('email', 'email', E)} AS token, email AS original FROM people WHERE {TRIM.format('email')} NOT IN {MISSING} AND {E} IS NOT NULL
UNION ALL SELECT id, 2, 'phone', {_cell('phone', 'phone', P)}, phone FROM people WHERE {TRIM.format('phone')} NOT IN {MISSING} AND {P} IS NOT NULL),
f AS (SELECT token, kind, original, min((id, n)) AS first FROM c GROUP BY ALL)
SELECT token, kind, list(original ORDER BY first) AS originals FROM f GROUP BY token, kind"""


for _key in ("sink_restore_map", "psd_map"):
    def _map(spark, sf_dir, merge=_key == "psd_map"):
        rows = people(spark, sf_dir)
        if not merge:
            return psd.restore_map(rows, COLUMNS[:2], KEY, order="id")
        # two halves built apart and merged give the map of the whole
        half = F.col("id") < 700
        return psd.merge_maps(
            psd.restore_map(rows.where(half), COLUMNS[:2], KEY, order="id"),
            psd.restore_map(rows.where(~half), COLUMNS[:2], KEY, order="id"),
        )

    REGISTRY.put(_key, _map, MAP_SQL)


for _key in ("psd_restore_table", "join_table_restore"):
    def _restored(spark, sf_dir):
        rows = people(spark, sf_dir)
        hidden = psd.pseudonymize_table(rows, COLUMNS[2:], KEY)
        return psd.restore_table(hidden, ["name"], psd.restore_map(rows, COLUMNS[2:], KEY, order="id"))

    REGISTRY.put(_key, _restored, f"SELECT * FROM ({for_oracle(PEOPLE)})")


# names of three letters, in a table at full width and in texts at half width
_KANA = "translate(lpad(cast(id % 500 as string), 3, '0'), '0123456789', '{0}')"
FULL, HALF = "アイウエオカキクケコ", "ｱｲｳｴｵｶｷｸｹｺ"
_NAMED = f"SELECT id, email, {_KANA.format(FULL)} AS kana, concat('x', chr(10), '氏名: ', {_KANA.format(HALF)}, chr(10), note) AS text FROM ({PEOPLE})"


@REGISTRY.add("psd_linkage", f"""WITH {BASE}, t AS (SELECT id, {E} AS v, id % 500 AS k FROM people),
mails AS (SELECT v, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY v), names AS (SELECT k, count(*) AS n FROM t GROUP BY k)
SELECT id AS left_id, coalesce(mails.n, 0) AS links, names.n AS text_links FROM t LEFT JOIN mails USING (v) JOIN names USING (k)""")
def psd_linkage(spark, sf_dir):
    """Tables and texts pseudonymized apart still join on their tokens."""
    rows = derived(spark, sf_dir, _NAMED)
    mails = psd.pseudonymize_table(rows.select("id", "email"), [ResolvedColumn(1, "email", "email", "chosen")], KEY)
    names = psd.pseudonymize_table(rows.select("id", "kana"), [ResolvedColumn(1, "kana", "name", "chosen")], KEY)
    # counted per token first, so a frequent value is not paired row by row
    by_mail = mails.where(F.col("email").startswith("email_")).groupBy("email").agg(F.count(F.lit(1)).alias("links"))
    by_name = names.groupBy(F.col("kana").alias("token")).agg(F.count(F.lit(1)).alias("text_links"))
    texts = psd.pseudonymize_text(rows.select("id", "text"), KEY, rules=[r for r in builtin() if r.rule_id == "pii.ja.name"])
    told = texts.select("id", F.regexp_extract("text", r"氏名: (name_\w+)\n", 1).alias("token"))
    linked = mails.join(by_mail, "email", "left").select("id", F.coalesce("links", F.lit(0)).alias("links"))
    return linked.join(told.join(by_name, "token"), "id").select(F.col("id").alias("left_id"), "links", "text_links")


_RATES = """SELECT email, phone, note FROM {customer_view}""".replace("{customer_view}", f"({PEOPLE})")


@REGISTRY.add("agg_column_rates", f"""WITH c AS (SELECT 'email' AS "column", email AS cell FROM ({for_oracle(PEOPLE)}) UNION ALL SELECT 'phone', phone FROM ({for_oracle(PEOPLE)}) UNION ALL SELECT 'note', note FROM ({for_oracle(PEOPLE)})),
k AS (SELECT "column", regexp_matches(cell, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{{2,}}') AS e, regexp_matches(cell, '0[0-9]{{1,4}}-[0-9]{{1,4}}-[0-9]{{4}}') AS p FROM c WHERE {TRIM.format('cell')} NOT IN {MISSING})
SELECT "column", count(*) AS scored, count(*) FILTER (e) / count(*) AS email_rate, count(*) FILTER (p) / count(*) AS phone_rate FROM k GROUP BY "column\"""")
def agg_column_rates(spark, sf_dir):
    return psd.column_rates(derived(spark, sf_dir, _RATES))


@REGISTRY.add("win_sample_rows", f"SELECT id, email FROM ({for_oracle(PEOPLE)}) ORDER BY id LIMIT 20")
def win_sample_rows(spark, sf_dir):
    return psd.sample(people(spark, sf_dir).select("id", "email"), ["id"])


@REGISTRY.add("psd_resolve_columns", """SELECT * FROM (VALUES (1, 'email', 'email', 'inferred'), (2, 'phone', 'phone', 'inferred'), (3, 'name', 'name', 'config')) t("index", name, kind, source)
WHERE (SELECT count(*) FROM customer) > 0""")
def psd_resolve_columns(spark, sf_dir):
    chosen = psd.resolve_columns(people(spark, sf_dir), config={"Name": "name"}, order=["id"])
    rows = F.explode(F.array(*(
        F.struct(F.lit(c.index).alias("index"), F.lit(c.name).alias("name"), F.lit(c.kind).alias("kind"),
                 F.lit(c.source).alias("source")) for c in chosen)))
    return people(spark, sf_dir).limit(1).select(rows.alias("r")).select("r.*")


@REGISTRY.add("psd_header_infer")
def psd_header_infer(spark, sf_dir):
    rows = people(spark, sf_dir)
    first = rows.orderBy("id").limit(1)
    return first.select(F.lit(psd.infer_header(first)).alias("has_header"))


_NOTES = """SELECT p_partkey AS id, p_name AS name, CASE p_size % 5 WHEN 0 THEN concat('a', chr(10), 'b,c,d') WHEN 1 THEN concat('say ', chr(34), chr(10), 'x') WHEN 2 THEN concat('two', chr(10), 'lines')
ELSE p_type END AS note FROM {part}"""


for _key in ("psd_merged_guard", "fn_merged_row"):
    REGISTRY.put(
        _key, lambda spark, sf_dir: psd.check_merged(derived(spark, sf_dir, _NOTES), []).select("id"),
        "SELECT p_partkey AS id FROM part WHERE p_size % 5 IN (0, 1)",
    )

# -- scalar functions ---------------------------------------------------------------------


@REGISTRY.add("fn_normalize_common", f"SELECT id, {TRIM.format('cell')} AS value FROM (SELECT p_partkey AS id, concat('  ', p_name, chr(9), ' x ', p_type, chr(10)) AS cell FROM part)")
def fn_normalize_common(spark, sf_dir):
    rows = derived(spark, sf_dir, "SELECT p_partkey AS id, concat('  ', p_name, chr(9), ' x ', p_type, chr(10)) AS cell FROM {part}")
    return rows.select("id", norm.normalize_common(F.col("cell")).alias("value"))


@REGISTRY.add("fn_missing", f"WITH {BASE} SELECT id, {TRIM.format('email')} IN {MISSING} AS missing FROM people")
def fn_missing(spark, sf_dir):
    return people(spark, sf_dir).select("id", norm.is_missing(norm.normalize_common(F.col("email"))).alias("missing"))


@REGISTRY.add("fn_normalize_email", f"WITH {BASE} SELECT id, {E} AS value, regexp_replace({E}, '[+][^@]*@', '@') AS stripped FROM people")
def fn_normalize_email(spark, sf_dir):
    common = norm.normalize_common(F.col("email"))
    return people(spark, sf_dir).select(
        "id", norm.normalize_email(common).alias("value"), norm.normalize_email(common, True).alias("stripped"))


@REGISTRY.add("fn_normalize_phone", f"WITH {BASE} SELECT id, {P} AS value FROM people")
def fn_normalize_phone(spark, sf_dir):
    return people(spark, sf_dir).select("id", norm.normalize_phone(norm.normalize_common(F.col("phone"))).alias("value"))


@REGISTRY.add("fn_token", "SELECT c_custkey AS id, " + ", ".join(
    f"{token_sql('custom:member', 'c_name', b)} AS t{b}" for b in (64, 96, 128)) + " FROM customer")
def fn_token(spark, sf_dir):
    rows = derived(spark, sf_dir, "SELECT c_custkey AS id, c_name FROM {customer}")
    return rows.select("id", *(hashing.token(KEY, "custom:member", F.col("c_name"), b).alias(f"t{b}") for b in (64, 96, 128)))


@REGISTRY.add("fn_kind_key", f"SELECT c_custkey AS id, {hmac_sql(KEY.kind_key('email'), 'c_name')} AS digest FROM customer")
def fn_kind_key(spark, sf_dir):
    inner, outer = hashing.hmac_pads(KEY.kind_key("email"))
    rows = derived(spark, sf_dir, "SELECT c_custkey AS id, c_name FROM {customer}")
    return rows.select("id", hashing.hmac_hex(F.lit(inner), F.lit(outer), F.col("c_name")).alias("digest"))


_STORED = """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 3 THEN concat('v2:', md5(c_name)) WHEN 4 THEN NULL
ELSE concat('v1:', md5(c_name), md5(c_mktsegment), ':', upper(md5(concat('s', c_name))), md5(cast(c_nationkey as string))) END AS stored FROM {customer}"""


@REGISTRY.add("fn_fingerprint", f"""SELECT id, CASE WHEN stored LIKE 'v1:%' THEN substr(sha256(unhex(replace(substr(stored, 4), ':', ''))), 1, 16) END AS fingerprint
FROM ({for_oracle(_STORED)})""")
def fn_fingerprint(spark, sf_dir):
    return derived(spark, sf_dir, _STORED).select("id", hashing.fingerprint(F.col("stored")).alias("fingerprint"))


@REGISTRY.add("fn_classify_cell", f"""WITH {BASE} SELECT id, CASE WHEN regexp_matches(email, '@[a-zA-Z0-9.-]+[.][a-zA-Z]{{2,}}') THEN 'email' END AS email_kind,
CASE WHEN regexp_matches(phone, '0[0-9]{{1,4}}-[0-9]{{1,4}}-[0-9]{{4}}') THEN 'phone' END AS phone_kind FROM people""")
def fn_classify_cell(spark, sf_dir):
    return people(spark, sf_dir).select(
        "id", psd.cell_kind(F.col("email")).alias("email_kind"), psd.cell_kind(F.col("phone")).alias("phone_kind"))


_HEADERS = """SELECT p_partkey AS id, CASE p_size % 9 WHEN 0 THEN ' E-Mail' WHEN 1 THEN '電話番号' WHEN 2 THEN 'TEL' WHEN 3 THEN 'メアド' WHEN 4 THEN 'email address'
WHEN 5 THEN 'Phone_Number ' WHEN 6 THEN NULL WHEN 7 THEN 'telegram' ELSE p_name END AS header FROM {part}"""


@REGISTRY.add("fn_header_kind", f"""SELECT id, CASE WHEN trim(header) IN ('E-Mail', 'メアド') THEN 'email' WHEN trim(header) IN ('電話番号', 'TEL', 'Phone_Number') THEN 'phone' END AS kind
FROM ({for_oracle(_HEADERS)})""")
def fn_header_kind(spark, sf_dir):
    return derived(spark, sf_dir, _HEADERS).select("id", norm.header_kind_of(F.col("header")).alias("kind"))


_SHAPES = "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '12/3, (4)' WHEN 1 THEN '-()' WHEN 2 THEN concat(cast(p_size as string), ':00') ELSE p_name END AS cell FROM {part}"


@REGISTRY.add("fn_number_shaped", f"SELECT id, regexp_matches(cell, '^[0-9 +().,/:-]*$') AND regexp_matches(cell, '[0-9]') AS ok FROM ({for_oracle(_SHAPES)})")
def fn_number_shaped(spark, sf_dir):
    return derived(spark, sf_dir, _SHAPES).select("id", norm.number_shaped(F.col("cell")).alias("ok"))


_NAMES = """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '氏名: 山田太郎様' WHEN 1 THEN 'Name: Ada Lovelace' WHEN 2 THEN '名前佐藤花子さん' ELSE 'by Grace Hopper' END AS m,
CASE c_custkey % 3 WHEN 0 THEN ' 太郎。' WHEN 1 THEN ' 住所: x' ELSE ' 次郎: y' END AS rest FROM {customer}"""


@REGISTRY.add("fn_split_name_label", "SELECT c_custkey AS id, ['氏名: ', 'Name: ', '名前', 'by '][c_custkey % 4 + 1] AS label, ['山田太郎様', 'Ada Lovelace', '佐藤花子さん', 'Grace Hopper'][c_custkey % 4 + 1] AS name FROM customer")
def fn_split_name_label(spark, sf_dir):
    m = F.col("m")
    label = psd.name_label(m)
    return derived(spark, sf_dir, _NAMES).select("id", label.alias("label"), F.substring(m, F.length(label) + 1, F.length(m)).alias("name"))


@REGISTRY.add("fn_honorific", "SELECT c_custkey AS id, ['様', '', 'さん', ''][c_custkey % 4 + 1] AS honorific FROM customer")
def fn_honorific(spark, sf_dir):
    return derived(spark, sf_dir, _NAMES).select("id", psd.honorific(F.col("m")).alias("honorific"))


@REGISTRY.add("fn_given_name", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN ' 太郎' ELSE '' END AS given FROM customer")
def fn_given_name(spark, sf_dir):
    return derived(spark, sf_dir, _NAMES).select("id", psd.given_name(F.lit("氏名: 山田"), F.col("rest")).alias("given"))


# -- texts -----------------------------------------------------------------------------------
_p = Pool("doc_id", "x")
USER = "concat('User', cast(doc_id % 300 as string), '@example.com')"
TEXT = planted(f"concat('mail ', {USER}, ' tel 090-1234-', cast(doc_id % 1000 + 1000 as string), ' key AKIA', upper({_p.take(16)}), ' ssn 123-45-', {_p.digits(4)}, chr(10), '氏名: 山田 太郎様')")
TEXT_RULES = [r for r in builtin() if r.rule_id in ("pii.email", "pii.ja.phone", "secret.aws_access_key", "pii.en.ssn", "pii.ja.name")]


@REGISTRY.add("psd_rule_kinds", """SELECT rule_id, kind, count(*) AS documents FROM documents,
(VALUES ('pii.email', 'email'), ('pii.ja.phone', 'phone'), ('pii.ja.name', 'name'), ('pii.en.ssn', 'custom:ssn'), ('secret.aws_access_key', NULL)) t(rule_id, kind) GROUP BY ALL""")
def psd_rule_kinds(spark, sf_dir):
    """Findings of the rules, each with the kind of its tokens; one rule has a kind of the caller's, one has none."""
    kinds = psd.rule_kinds({"pii.en.ssn": "custom:ssn"})
    found = detect.matches(derived(spark, sf_dir, TEXT), carry=["doc_id"], rules=TEXT_RULES).groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    known = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    return found.groupBy("rule_id", known[F.col("rule_id")].alias("kind")).agg(F.count(F.lit(1)).alias("documents"))


@REGISTRY.add("psd_text")
def psd_text(spark, sf_dir):
    return psd.pseudonymize_text(derived(spark, sf_dir, TEXT), KEY).select("doc_id", "text")


@REGISTRY.add("srt_greedy_spans", f"""SELECT doc_id, concat('mail ', {token_sql('email', f'lower({USER})')}, ' tel ', {token_sql('phone', "concat('+81901234', cast(doc_id % 1000 + 1000 as string))")},
' key [REDACTED] [REDACTED]', chr(10), '氏名: ', {token_sql('name', "'山田 太郎'")}, '様') AS tail FROM documents""")
def srt_greedy_spans(spark, sf_dir):
    """The planted part after the edits: wider and secret spans won, labels and honorifics stayed."""
    out = psd.pseudonymize_text(derived(spark, sf_dir, TEXT), KEY, rules=TEXT_RULES)
    return out.select("doc_id", F.regexp_extract("text", r"(mail email_[^\n]*\n[^\n]*)\n\z", 1).alias("tail"))


TOKENS = f"SELECT doc_id, concat('a ', {{t}}, ', b x{{t}} ', {{t}}, '!', chr(10), coalesce(text, '')) AS text, {USER} AS original, {{t}} AS token FROM {{documents}}"


def _token_texts(spark, sf_dir):
    base = derived(spark, sf_dir, f"SELECT doc_id, {USER} AS original, coalesce(text, '') AS text FROM {{documents}}")
    token = hashing.token(KEY, "email", F.lower("original"))
    with_token = base.withColumn("token", token)
    text = F.concat(F.lit("a "), F.col("token"), F.lit(", b x"), F.col("token"), F.lit(" "), F.col("token"), F.lit("!\n"), F.col("text"))
    return with_token.withColumn("text", text)


def _token_map(texts):
    firsts = texts.groupBy("token", F.lit("email").alias("kind"), "original").agg(F.min(F.struct("doc_id", F.lit(0).alias("i"))).alias("first"))
    return psd.collect_originals(firsts)


for _key in ("psd_restore_text", "join_restore"):
    def _restored_text(spark, sf_dir):
        texts = _token_texts(spark, sf_dir)
        return psd.restore_text(texts.select("doc_id", "text"), _token_map(texts), key="doc_id").select("doc_id", "text")

    REGISTRY.put(_key, _restored_text, f"SELECT doc_id, concat('a ', {USER}, ', b x', {token_sql('email', f'lower({USER})')}, ' ', {USER}, '!', chr(10), coalesce(text, '')) AS text FROM documents")


@REGISTRY.add("agg_restore_ambiguous", "SELECT cast(2 * count(*) AS BIGINT) AS replacements, cast(0 AS BIGINT) AS ambiguous FROM documents")
def agg_restore_ambiguous(spark, sf_dir):
    texts = _token_texts(spark, sf_dir)
    done = psd.restore_text(texts.select("doc_id", "text"), _token_map(texts), key="doc_id")
    return done.agg(F.sum("replacements").alias("replacements"), F.sum("ambiguous").cast("long").alias("ambiguous"))


for _key in ("psd_check_remaining", "agg_leftovers"):
    def _left(spark, sf_dir):
        out = psd.pseudonymize_text(derived(spark, sf_dir, TEXT), KEY, rules=[r for r in TEXT_RULES if r.rule_id != "pii.en.ssn"])
        return psd.leftovers(out, rules=TEXT_RULES, carry=["doc_id"])

    REGISTRY.put(_key, _left, "SELECT 'pii.en.ssn' AS rule_id FROM documents LIMIT 1")
