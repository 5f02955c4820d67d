"""Pseudonymization of tables and texts, restore maps and restoring.

Tokens are keyed hashes of normalized values, so the same person gets the same
token in every table and file and tables can still be joined. Replacing is a
narrow map; only building a map of tokens to originals aggregates.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, hashing
from ..functions import normalize as norm
from ..functions.arrays import let
from ..functions.hashing import KeyMaterial
from ..policy import Policy
from ..rules.table import Rule, rules_for
from . import detect, mask
from .detect import _CODE, _ENV, _PATH, _TEXT

UNPARSED = "[UNPARSED]"
REDACTED = "[REDACTED]"
# --- fixed values: how many rows decide a column, and by what share -------------
SAMPLE_ROWS = 20
MATCH_THRESHOLD = 0.60
# -------------------------------------------------------------------------------
RESERVED = ("email", "phone", "name")
BROADCAST_TOKENS = 1_000_000


def check_kind(kind: str) -> str:
    kind = kind.strip()
    if kind in RESERVED:
        return kind
    label = kind.removeprefix("custom:")
    if label == kind or label in RESERVED or not re.fullmatch(r"[a-z][a-z0-9_]{0,32}", label):
        raise ValueError(f"unknown kind {kind!r} (use email, phone, name or custom:<label>)")
    return kind


# -- choosing columns --------------------------------------------------------------


@dataclass(frozen=True)
class ResolvedColumn:
    index: int
    name: str
    kind: str
    source: str                 # config | chosen | inferred
    match_rate: float | None = None


def cell_kind(value: Column) -> Column:
    """``email`` or ``phone`` when a cell holds exactly one of the two."""
    from ..functions import validators as v
    from ..rules.table import builtin

    rule = {r.rule_id: r for r in builtin()}
    address = F.size(F.filter(
        F.regexp_extract_all(value, F.lit(rule["pii.email"].java), F.lit(0)), v.email_ok)) > 0
    ja = mask.valid_spans(
        [rule["pii.ja.phone"]],
        F.struct(F.lit("pii.ja.phone").alias("rule_id"), F.lit(rule["pii.ja.phone"].java).alias("pattern"),
                 F.lit(None).cast("double").alias("entropy")), value)
    phone = value.rlike(rule["pii.en.phone"].java) | (F.size(ja) > 0)
    return let(
        F.struct(address.alias("e"), phone.alias("p")),
        lambda x: F.when(x["e"] & ~x["p"], "email").when(x["p"] & ~x["e"], "phone"),
    )


def column_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of addresses and phone numbers per column, missing cells left out."""
    columns = list(df.columns) if columns is None else columns
    cells = df.select(F.explode(F.array(*(
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in columns
    ))).alias("x")).select("x.column", "x.cell")
    common = norm.normalize_common(F.col("cell"))
    kinds = cells.where(F.col("cell").isNotNull() & ~norm.is_missing(common)).select(
        "column", cell_kind(F.col("cell")).alias("kind"))
    return kinds.groupBy("column").agg(
        F.count(F.lit(1)).alias("scored"),
        (F.count_if(F.col("kind") == "email") / F.count(F.lit(1))).alias("email_rate"),
        (F.count_if(F.col("kind") == "phone") / F.count(F.lit(1))).alias("phone_rate"),
    )


def sample(df: DataFrame, order: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows of a table in a stated order; a distributed table has no other first rows."""
    return df.orderBy(*order).limit(rows)


def resolve_columns(
    df: DataFrame,
    *,
    config: Mapping[str, str] | None = None,
    chosen: Mapping[str, str] | None = None,
    skip: tuple[str, ...] = (),
    positions: Mapping[int, str | None] | None = None,
    order: list[str] | None = None,
) -> list[ResolvedColumn]:
    """Which columns to replace: by position, by name, or by looking at a small sample."""
    names = list(df.columns)
    if positions:
        if chosen or skip:
            raise ValueError("positional and named column choices cannot be mixed")
        for index in positions:
            if index >= len(names):
                raise ValueError(f"column position {index + 1} does not exist (the table has {len(names)} columns)")
        return [ResolvedColumn(i, names[i], check_kind(k), "chosen") for i, k in sorted(positions.items()) if k]
    explicit: dict[str, tuple[str, str]] = {}
    for source, given in (("config", config or {}), ("chosen", chosen or {})):
        folded = [norm.header_key(n) for n in given]
        if len(set(folded)) != len(folded):
            raise ValueError("column named twice after case folding")
        explicit.update({norm.header_key(n): (check_kind(k), source) for n, k in given.items()})
    skipped = {norm.header_key(s) for s in skip}
    keys = [norm.header_key(n) for n in names]
    missing = [n for n in [*(chosen or {}), *skip] if norm.header_key(n) not in keys]
    if missing:
        raise ValueError(f"columns did not match any header: {', '.join(missing)}")
    open_columns = [n for n, k in zip(names, keys) if k not in skipped and k not in explicit]
    rates = {}
    if open_columns:
        # at most SAMPLE_ROWS rows reach this aggregate; the result has one row per column
        probe = sample(df, order or names[:1]).select(*open_columns)
        rates = {r["column"]: r for r in column_rates(probe).collect()}
    out = []
    for i, (name, key) in enumerate(zip(names, keys)):
        if key in skipped:
            continue
        if key in explicit:
            out.append(ResolvedColumn(i, name, *explicit[key]))
            continue
        r = rates.get(name)
        if r and r["email_rate"] >= MATCH_THRESHOLD and r["email_rate"] >= r["phone_rate"]:
            out.append(ResolvedColumn(i, name, "email", "inferred", r["email_rate"]))
        elif r and r["phone_rate"] >= MATCH_THRESHOLD:
            out.append(ResolvedColumn(i, name, "phone", "inferred", r["phone_rate"]))
        elif norm.header_kind(name):
            out.append(ResolvedColumn(i, name, norm.header_kind(name), "inferred", 0.0))
    return out


def infer_header(first_row: DataFrame) -> bool:
    """A first row that holds an address or a phone number is data, not a header."""
    cells = [cell_kind(F.col(c).cast("string")).isNotNull() for c in first_row.columns]
    return not first_row.limit(1).where(F.greatest(*cells, F.lit(False))).take(1)


# -- tables --------------------------------------------------------------------------


def cell_states(df: DataFrame, columns: list[ResolvedColumn], material: KeyMaterial, *, bits: int = 64,
                strip_subaddress: bool = False) -> DataFrame:
    """Add per selected column ``__new_i`` (replacement) and ``__state_i`` (kept, unparsed, token)."""
    hashing.check_token_bits(bits)
    common = df.select("*", *(
        norm.normalize_common(F.col(c.name).cast("string")).alias(f"__c_{c.index}") for c in columns
    ))
    valued = common.select("*", *(
        norm.normalize_kind(c.kind, F.col(f"__c_{c.index}"), strip_subaddress).alias(f"__v_{c.index}") for c in columns
    ))
    made = []
    for c in columns:
        missing = F.col(f"__c_{c.index}").isNull() | norm.is_missing(F.col(f"__c_{c.index}"))
        value = F.col(f"__v_{c.index}")
        made.append(F.when(missing, "kept").when(value.isNull(), "unparsed").otherwise("token").alias(f"__state_{c.index}"))
        made.append(
            F.when(missing, F.col(c.name).cast("string")).when(value.isNull(), UNPARSED)
            .otherwise(hashing.token(material, c.kind, value, bits)).alias(f"__new_{c.index}")
        )
    return valued.select(*df.columns, *made)


def pseudonymize_table(df: DataFrame, columns: list[ResolvedColumn], material: KeyMaterial, **options) -> DataFrame:
    """Replace the selected columns; everything else is copied."""
    staged = cell_states(df, columns, material, **options)
    by_name = {c.name: c for c in columns}
    return staged.select(*(
        F.col(f"__new_{by_name[n].index}").alias(n) if n in by_name else F.col(n) for n in df.columns
    ))


def replaced_unparsed(df: DataFrame, columns: list[ResolvedColumn], material: KeyMaterial, **options) -> DataFrame:
    """Cells replaced and cells that could not be read, per kind."""
    staged = cell_states(df, columns, material, **options)
    cells = staged.select(F.explode(F.array(*(
        F.struct(F.lit(c.kind).alias("kind"), F.col(f"__state_{c.index}").alias("state")) for c in columns
    ))).alias("x")).select("x.kind", "x.state")
    return cells.groupBy("kind").agg(
        F.count_if(F.col("state") == "token").alias("replaced"),
        F.count_if(F.col("state") == "unparsed").alias("unparsed"),
    )


def restore_map(df: DataFrame, columns: list[ResolvedColumn], material: KeyMaterial, *, order: str, **options) -> DataFrame:
    """Tokens with their distinct originals, first seen first.

    Each original is first reduced to its earliest row, which is what keeps a
    value that fills a third of the table from piling up in one array.
    """
    staged = cell_states(df, columns, material, **options)
    cells = staged.select(F.col(order).alias("at"), F.explode(F.array(*(
        F.struct(F.lit(c.kind).alias("kind"), F.col(f"__state_{c.index}").alias("state"),
                 F.col(f"__new_{c.index}").alias("token"), F.col(c.name).cast("string").alias("original"),
                 F.lit(c.index).alias("index"))
        for c in columns
    ))).alias("x")).select("at", "x.*").where(F.col("state") == "token")
    firsts = cells.groupBy("token", "kind", "original").agg(F.min(F.struct("at", "index")).alias("first"))
    return collect_originals(firsts)


def collect_originals(firsts: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("first", "original")))
    return firsts.groupBy("token", "kind").agg(F.transform(ordered, lambda x: x["original"]).alias("originals"))


def merge_maps(*maps: DataFrame) -> DataFrame:
    """Union of restore maps; earlier maps' originals come first."""
    rows = None
    for rank, m in enumerate(maps):
        part = m.select("token", "kind", F.posexplode("originals").alias("pos", "original")).withColumn(
            "first", F.struct(F.lit(rank).alias("at"), F.col("pos").alias("index"))).drop("pos")
        rows = part if rows is None else rows.unionByName(part)
    firsts = rows.groupBy("token", "kind", "original").agg(F.min("first").alias("first"))
    return collect_originals(firsts)


def check_merged(df: DataFrame, columns: list[ResolvedColumn], delimiter: str = ",", field_count: str | None = None) -> DataFrame:
    """Rows whose copied fields look like swallowed rows; refuse to write when any exists."""
    selected = {c.name for c in columns}
    width = len(df.columns)
    bad = F.lit(False)
    for name in df.columns:
        if name not in selected:
            field = F.col(name).cast("string")
            bad = bad | F.coalesce(norm.merged_row(field, delimiter, width, width), F.lit(False))
            if delimiter == "\t":
                bad = bad | F.coalesce(F.contains(field, F.lit("\t")), F.lit(False))
    return df.where(bad)


def metadata(df: DataFrame, columns: list[ResolvedColumn], material: KeyMaterial, *, bits: int = 64, **options) -> DataFrame:
    """One row about a run: columns, counts and key fingerprint, never a value."""
    counts = replaced_unparsed(df, columns, material, bits=bits, **options)
    entries = counts.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "replaced")))).alias("replaced"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "unparsed")))).alias("unparsed"),
    )
    return entries.select(
        F.lit("table").alias("mode"), F.lit("v1").alias("norm"), F.lit(bits).alias("token_bits"),
        F.lit(material.fingerprint()).alias("key_fingerprint"),
        F.array(*(F.struct(F.lit(c.name).alias("name"), F.lit(c.kind).alias("kind"), F.lit(c.source).alias("source"))
                  for c in columns)).alias("columns"),
        "replaced", "unparsed",
    )


# -- restoring -------------------------------------------------------------------------

TOKEN_PATTERN = r"(?<![0-9A-Za-z_])([a-z][a-z0-9_]*_[a-z2-7]{13,26})(?![a-z2-7])"


def restore_table(df: DataFrame, columns: list[str], restore: DataFrame, size: int | None = None) -> DataFrame:
    """Put originals back into columns of whole-cell tokens.

    ``size`` is the number of tokens when known; a map beyond the limit joins by
    shuffle. Cells that no token looks like (empty, ``N/A``, marks for unparsed
    values) get keys of their own, spread over the tasks, that the map has not.
    """
    out = df
    first = restore.select("token", F.get("originals", F.lit(0)).alias("__original"))
    rest = F.concat(F.lit(" "), F.xxhash64(*[F.col(c) for c in df.columns]).cast("string"))
    for name in columns:
        key = F.when(F.col(name).rlike(r"\A[a-z][a-z0-9_]*_[a-z2-7]{13,26}\z"), F.col(name)).otherwise(rest)
        part = first.withColumnRenamed("token", "__key")
        part = F.broadcast(part) if size is not None and size <= BROADCAST_TOKENS else part
        out = out.withColumn("__key", key).join(part, "__key", "left")
        out = out.withColumn(name, F.coalesce("__original", name)).drop("__original", "__key")
    return out.select(*df.columns)


def text_tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Token candidates of each text with their positions; texts without any give none."""
    found = F.col(text).rlike(TOKEN_PATTERN)
    rows = df.where(found).select(
        key, F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(1)).alias("tokens"))
    return rows.select(key, F.posexplode("tokens").alias("pos", "token"))


def restore_text(df: DataFrame, restore: DataFrame, *, key: str, text: str = "text", size: int | None = None) -> DataFrame:
    """Put originals back into texts.

    Only texts that hold token candidates take part: their distinct tokens meet
    the map in a join and return as one small lookup per text.
    """
    wanted = text_tokens(df, key, text).select(key, "token").distinct()
    first = restore.select("token", F.get("originals", F.lit(0)).alias("original"), (F.size("originals") > 1).alias("several"))
    known = wanted.join(F.broadcast(first) if size is not None and size <= BROADCAST_TOKENS else first, "token")
    lookup = known.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("__map"),
        F.count_if("several").alias("ambiguous"),
    )
    joined = df.join(lookup, key, "left")
    keep = [c for c in df.columns if c != text]

    def rebuilt(tokens: Column, gaps: Column) -> Column:
        parts = F.transform(tokens, lambda t, i: F.concat(F.get(gaps, i), F.coalesce(F.col("__map")[t], t)))
        return F.concat(F.array_join(parts, ""), F.element_at(gaps, -1))

    restored = let(
        F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(1)),
        lambda tokens: let(F.split(F.col(text), TOKEN_PATTERN, -1), lambda gaps: F.struct(
            rebuilt(tokens, gaps).alias("text"),
            F.size(F.filter(tokens, lambda t: F.col("__map")[t].isNotNull())).alias("replacements"),
        )),
    )
    state = F.when(F.col("__map").isNotNull(), restored)
    return joined.select(*keep, F.col(text), state.alias("__r"), "ambiguous").select(
        *keep, F.coalesce("__r.text", text).alias(text), F.coalesce("__r.replacements", F.lit(0)).alias("replacements"),
        F.coalesce("ambiguous", F.lit(0)).alias("ambiguous"),
    )


# -- free text --------------------------------------------------------------------------

# --- fixed values ------------------------------------------------------------------------
RULE_KINDS = {
    "pii.email": "email", "pii.en.phone": "phone", "pii.ja.phone": "phone", "pii.en.name": "name",
    "pii.ja.name": "name",
}
HONORIFICS = ("様", "さま", "さん", "くん", "ちゃん")
FIELD_LABELS = (
    "氏名 名前 フリガナ ふりがな 住所 年齢 性別 生年月日 電話 携帯 メール 連絡先 郵便番号 会社 勤務先 所属 部署 役職 職業 国籍 "
    "担当 番号 備考"
).split()
JA_NAME_CHAR = (
    r"[\x{3005}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FFFF}]"
)


def rule_kinds(overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    return {**RULE_KINDS, **{k: check_kind(v) for k, v in (overrides or {}).items()}}


def name_label(text: Column) -> Column:
    """Label part of a name match, up to the name itself."""
    space = r"[\s\x{85}\p{Z}]*"
    return F.when(
        text.rlike("[:：#]"), F.regexp_extract(text, rf"\A[^:：#]*[:：#]{space}", 0)
    ).when(
        text.rlike(r"\A(?:氏名|名前)"), F.regexp_extract(text, rf"\A(?:氏名|名前){space}", 0)
    ).otherwise(F.regexp_extract(text, r"\A[^\s\x{85}\p{Z}]*[\s\x{85}\p{Z}]+", 0))


def honorific(name: Column) -> Column:
    """Trailing honorific, empty when fewer than two characters would remain."""
    return F.regexp_extract(name, rf"(?s)\A.{{2,}}?({'|'.join(HONORIFICS)})\z", 1)


def given_name(match: Column, rest: Column) -> Column:
    """The word after a Japanese family name when it reads like a given name, with its separator."""
    name = F.substring(match, F.length(name_label(match)) + 1, F.length(match))
    word = rf"\A([ 　]{JA_NAME_CHAR}{{1,12}})(?!{JA_NAME_CHAR})(?![ 　\t]*[:：])"
    follows = F.regexp_extract(rest, word, 1)
    label = F.substring(follows, 2, 12).rlike(rf"\A(?:{'|'.join(FIELD_LABELS)})")
    return F.when((name != "") & (honorific(name) == "") & ~label, follows).otherwise("")


def _replacement(text: Column, rule_id: Column, kinds: Mapping[str, str], material: KeyMaterial, bits: int,
                 strip: bool) -> Column:
    """Struct of the new text, the kind and the cell state for one accepted span."""

    def tokenized(kind: str) -> Column:
        label = name_label(text) if kind == "name" else F.lit("")

        def of_parts(lab: Column) -> Column:
            rest = F.substring(text, F.length(lab) + 1, F.length(text))
            tail = honorific(rest) if kind == "name" else F.lit("")

            def of_tail(t: Column) -> Column:
                value = F.left(rest, F.length(rest) - F.length(t))

                def cell(common: Column) -> Column:
                    def made(v: Column) -> Column:
                        new = (
                            F.when(norm.is_missing(common), value).when(v.isNull(), UNPARSED)
                            .otherwise(hashing.token(material, kind, v, bits))
                        )
                        state = F.when(norm.is_missing(common), "kept").when(v.isNull(), "unparsed").otherwise("token")
                        return F.struct(
                            F.concat(lab, new, t).alias("new"), F.lit(kind).alias("kind"), state.alias("state"),
                            new.alias("token"), value.alias("original"),
                        )

                    return let(norm.normalize_kind(kind, common, strip), made)

                return let(norm.normalize_common(value), cell)

            return let(tail, of_tail)

        return let(label, of_parts)

    gone = F.struct(
        F.lit(REDACTED).alias("new"), F.lit(None).cast("string").alias("kind"), F.lit("redacted").alias("state"),
        F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("original"),
    )
    out = F.when(rule_id.startswith("secret."), gone)
    for kind in sorted(set(kinds.values())):
        out = out.when(rule_id.isin(*[r for r, k in kinds.items() if k == kind]), tokenized(kind))
    return out.otherwise(gone)


def text_edits(
    df: DataFrame, material: KeyMaterial, policy: Policy = Policy(), *, text: str = "text", bits: int = 64,
    rules: list[Rule] | None = None,
) -> DataFrame:
    """Documents with ``__edits``: accepted spans in order, each with its replacement."""
    hashing.check_token_bits(bits)
    settings = policy.pseudonymize
    kinds = rule_kinds(settings.rules)
    scoped = [
        r for r in (rules_for(policy) if rules is None else rules)
        if r.source in ("tuned", "provider") and not r.env_paths
    ]
    base = detect.prepare(df, F.col(text), F.lit("input.txt"), list(df.columns), scoped)
    rows = base.select(*df.columns, _PATH, _TEXT, detect._WHOLE, _ENV, _CODE, F.expr(detect.branches_sql(scoped)).alias("__hits"))
    located = detect.spans_sql("h.marked", detect._WHOLE, "h.pattern", "h.rule_id")
    rows = rows.withColumn("__hits", F.expr(
        f"transform(__hits, h -> named_struct('rule_id', h.rule_id, 'entropy', h.entropy, 'spans', {located}))"))

    def of_rule(h: Column) -> Column:
        return F.transform(detect.valid_spans(scoped, h, h["spans"]), lambda s: F.struct(
            s["start"].cast("int").alias("s"), (s["start"] + F.length(s["value"])).cast("int").alias("e"),
            h["rule_id"].alias("rule_id"), s["value"].alias("value"),
        ))

    spans = F.flatten(F.transform(F.col("__hits"), of_rule))

    def with_names(plain: Column) -> Column:
        names = F.filter(plain, lambda s: s["rule_id"] == "pii.ja.name")
        wider = F.transform(names, lambda s: let(
            given_name(s["value"], F.substring(F.col(_TEXT), s["e"] + 1, F.lit(32))),
            lambda g: F.struct(
                s["s"].alias("s"), (s["e"] + F.length(g)).alias("e"), s["rule_id"].alias("rule_id"),
                F.concat(s["value"], g).alias("value"),
            )))
        longer = F.filter(wider, lambda w: ~F.exists(names, lambda n: (n["s"] == w["s"]) & (n["e"] == w["e"])))
        return F.concat(plain, longer)

    ranked = F.array_sort(F.transform(let(spans, with_names), lambda s: F.struct(
        s["s"].alias("s"), s["e"].alias("e"), (~s["rule_id"].startswith("secret.")).cast("int").alias("rank"),
        (-F.octet_length(s["value"])).alias("wide"), s["rule_id"].alias("rule_id"), s["value"].alias("value"),
    )))
    staged = rows.select(*df.columns, _TEXT, ranked.alias("__spans"))
    staged = staged.withColumn(
        "__reach", F.expr(arrays.max_before_sql("transform(__spans, x -> CAST(x.e AS BIGINT))")))
    # spans that touch no other are taken at once; only the rest compete
    alone = lambda s, i: (F.get(F.col("__reach"), i) <= s["s"]) & (
        F.coalesce(F.get(F.col("__spans"), i + 1)["s"], F.lit(mask.MAX)) >= s["e"])
    free = F.filter(F.col("__spans"), alone)
    rivals = F.array_sort(F.transform(
        F.filter(F.col("__spans"), lambda s, i: ~alone(s, i)),
        lambda s: F.struct(s["rank"].alias("rank"), s["wide"].alias("wide"), s["s"].alias("s"), s["e"].alias("e"),
                           s["rule_id"].alias("rule_id"), s["value"].alias("value"))))
    kept_type = "array<struct<s:int,e:int,rule_id:string,value:string>>"
    slim = lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), s["rule_id"].alias("rule_id"), s["value"].alias("value"))
    chosen = F.aggregate(
        rivals, F.array().cast(kept_type),
        lambda acc, s: F.when(F.exists(acc, lambda a: (a["s"] < s["e"]) & (s["s"] < a["e"])), acc)
        .otherwise(F.concat(acc, F.array(slim(s)))))
    accepted = F.array_sort(F.concat(F.transform(free, slim).cast(kept_type), chosen))
    edits = F.transform(accepted, lambda s: F.struct(
        s["s"].alias("s"), s["e"].alias("e"), s["rule_id"].alias("rule_id"),
        _replacement(s["value"], s["rule_id"], kinds, material, bits, settings.email_strip_subaddress).alias("r")))
    return staged.select(*df.columns, _TEXT, edits.alias("__edits"))


def pseudonymize_text(df: DataFrame, material: KeyMaterial, policy: Policy = Policy(), *, text: str = "text", **options) -> DataFrame:
    """Tokens for addresses, phones and names; secrets and other detections are redacted."""
    edited = text_edits(df, material, policy, text=text, **options)
    rebuilt = mask.replace_spans(F.col(_TEXT), F.col("__edits"), lambda x: x["r"]["new"])
    body = F.when(F.size("__edits") > 0, rebuilt).otherwise(F.col(_TEXT))
    return edited.select(*(c for c in df.columns if c != text), F.when(F.col(text).isNotNull(), body).alias(text))


def text_map(edited: DataFrame, order: str) -> DataFrame:
    """Restore map of ``text_edits`` output."""
    cells = edited.select(F.col(order).alias("at"), F.explode("__edits").alias("x")).where(
        F.col("x.r.state") == "token"
    ).select("at", F.col("x.s").alias("index"), F.col("x.r.token").alias("token"), F.col("x.r.kind").alias("kind"),
             F.col("x.r.original").alias("original"))
    firsts = cells.groupBy("token", "kind", "original").agg(F.min(F.struct("at", "index")).alias("first"))
    return collect_originals(firsts)


# -- checking an output --------------------------------------------------------------------


def leftovers(df: DataFrame, policy: Policy = Policy(), **options) -> DataFrame:
    """Rules that still find something in an output, suppression switched off."""
    rules = [r for r in (options.pop("rules", None) or rules_for(policy)) if r.rule_id != "pii.plaintext_map"]
    found = detect.hits(df, policy, rules=rules, **options)
    return found.where(F.size("matches") > 0).select("rule_id").distinct().orderBy("rule_id")
