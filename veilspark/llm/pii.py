"""Personal data by boosted trees over candidate spans.

Strict rules give the base spans. Loose generators propose further, overlapping candidates: addresses with other
marks, digits grouped as telephone or card numbers, quads and hextets. Each candidate becomes a short vector of its
format and context, without what a strict rule decides on (a leading plus, the check digit). The trees have to know
personal data that the strict rules miss, so they learn from base spans that were altered until these miss them: the plus
or the country code dropped, other separators, obfuscated ``at`` and ``dot``, one digit of a card changed. Each stands
where it stood. Hard negatives are dates, times, versions, amounts, identifiers and handles with the digits of the span,
once in its place and once behind a word of their own. Equal vectors are counted, so every base span takes part in a table
of counts. One fold of the documents is kept out of the fit; on it each kind gets the lowest threshold that still reaches
the wished precision. Candidates that pass and touch no base span are added to the base spans.

All of it is column expressions: the trees are turned into CASE expressions, and redaction is a map over rows.

Defined cases: a null text is empty and has no spans; repeated rows have a row each; without base spans there is nothing
to learn from and nothing is added; spans count code points, end exclusive, and sort by start, then kind, then end. The
fit takes at most ``MAX_VECTORS`` different vectors, those with the least hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let_sql, max_before_sql, sums_before_sql
from .common import ROW, kept, packed, released, texts

KINDS = ("email", "ip", "card", "phone")
# The strict rules. Possessive repeats and the look at the character before keep long runs linear; they match what
# the plain forms do, leftmost and without overlap, since a run that fails at its first character fails at all.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": "contains({t}, '@')", "ip": "has_digit", "card": "has_digit", "phone": "contains({t}, '+')"}
OCTETS = r"\A(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|\z)){4}\z"
LOOSE = {
    "email": r"(?<![^\s<(\[,;:'\"])[\w.%+-]{1,64}+(?:@|\s?[(\[]at[)\]]\s?)[\w-]{1,63}+(?:(?:\.|\s?[(\[]dot[)\]]\s?)[\w-]{1,63}+){0,6}",
    "ip": r"(?<![\w.:])(?:[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4})(?![\w:])",
    "card": r"(?<!\w)[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?<!\w)\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,4}){2,4}(?![0-9])",
}
CUES = {
    "email": "mail|contact|write|courriel|correo",
    "ip": "ip|host|server|addr|client|login",
    "card": "card|visa|master|credit|pay|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|ruf|fono",
}
FEATURES = ("kind", "digits", "letters", "marks", "groups", "longest", "ending", "before", "after", "cue", "distinct")
SPAN = "array<struct<start: bigint, kind: int, end: bigint, value: string>>"
CONTEXT = 24
FOLDS = 5
PRECISION = 0.98
MAX_VECTORS = 100_000
BESIDE = 40
TREES = 16
DEPTH = 3


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def located(text: str, pattern: str, kind: int, gate: str, valid: str) -> str:
    """SQL for the spans of a pattern whose value ``x`` passes ``valid``."""
    p = quoted(pattern)

    def spans(m: str) -> str:
        def with_gaps(g: str) -> str:
            steps = f"transform({m}, (x, i) -> CAST(length({g}[i]) + length(x) AS BIGINT))"
            return let_sql(sums_before_sql(steps), lambda s: (
                f"filter(transform({m}, (x, i) -> named_struct('start', {s}[i] + length({g}[i]), 'kind', {kind}, "
                f"'end', {s}[i] + length({g}[i]) + length(x), 'value', x)), z -> {valid.format(x='z.value')})"
            ))

        return f"CASE WHEN size({m}) > 0 THEN {let_sql(f'split({text}, {p}, -1)', with_gaps)} ELSE CAST(array() AS {SPAN}) END"

    return f"CASE WHEN {gate} THEN {let_sql(f'regexp_extract_all({text}, {p}, 0)', spans)} ELSE CAST(array() AS {SPAN}) END"


def luhn(value: str) -> str:
    """SQL: the digits of ``value`` pass the check."""
    doubled = "element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), CAST(c AS INT) + 1)"
    digits = f"filter(split(reverse(regexp_replace({value}, '[^0-9]', '')), ''), c -> c != '')"
    return (
        f"aggregate({digits}, named_struct('s', 0, 'i', 0), (a, c) -> named_struct('s', a.s + "
        f"CASE WHEN a.i % 2 = 1 THEN {doubled} ELSE CAST(c AS INT) END, 'i', a.i + 1)).s % 10 = 0"
    )


def count_of(value: str, chars: str) -> str:
    return f"length(regexp_replace({value}, '[^{chars}]', ''))"


def strict_spans(text: str) -> str:
    digits = count_of("{x}", "0-9")
    valid = {
        "email": "true",
        "ip": f"{{x}} rlike {quoted(OCTETS).replace('{', '{{').replace('}', '}}')}",
        "card": f"({digits} BETWEEN 12 AND 19) AND {luhn('{x}')}",
        "phone": f"{digits} BETWEEN 9 AND 15",
    }
    each = [located(text, STRICT[k], n, GATES[k].format(t=text), valid[k]) for n, k in enumerate(KINDS)]
    return f"array_sort(concat({', '.join(each)}))"


def loose_spans(text: str) -> str:
    gates = GATES | {"email": f"contains({text}, '@') OR contains({text}, 'at)') OR contains({text}, 'at]')", "phone": "has_digit"}
    each = [located(text, LOOSE[k], n, gates[k].format(t=text), "true") for n, k in enumerate(KINDS)]
    return f"concat({', '.join(each)})"


def char_class(c: str) -> str:
    return (
        f"CASE WHEN {c} = '' OR {c} rlike '\\\\s' THEN 0 WHEN {c} rlike '[\\\\p{{L}}]' THEN 1 WHEN {c} rlike '[0-9]' THEN 2 "
        f"WHEN {c} rlike '[,.;:)(]' THEN 3 ELSE 4 END"
    )


def vector(text: str, c: str) -> str:
    """SQL for the features of a candidate ``c``, small whole numbers."""
    v = f"{c}.value"
    left = f"substring({text}, CAST(greatest({c}.start - {CONTEXT}, 0) + 1 AS INT), CAST(least({c}.start, {CONTEXT}) AS INT))"
    cue = " ".join(f"WHEN {c}.kind = {n} THEN lower({left}) rlike '{CUES[k]}'" for n, k in enumerate(KINDS))
    groups = f"filter(split({v}, '[^0-9]+'), g -> g != '')"
    parts = {
        "kind": f"{c}.kind",
        "digits": f"least({count_of(v, '0-9')}, 24)",
        "letters": f"least({count_of(v, 'A-Za-z')}, 24) DIV 3",
        "marks": f"least({count_of(v, ' ().@:-')}, 8)",
        "groups": f"least(size({groups}), 8)",
        "longest": f"least(coalesce(array_max(transform({groups}, g -> length(g))), 0), 20)",
        "ending": f"CASE WHEN {v} rlike '(?:[.]|dot[)\\\\]] ?)[A-Za-z]{{2,}}$' THEN 2 WHEN {v} rlike '[0-9]$' THEN 1 ELSE 0 END",
        "before": char_class(f"substring({text}, CAST({c}.start AS INT), CASE WHEN {c}.start > 0 THEN 1 ELSE 0 END)"),
        "after": char_class(f"substring({text}, CAST({c}.end AS INT) + 1, 1)"),
        "cue": f"CAST((CASE {cue} ELSE false END) AS INT)",
        "distinct": f"size(array_distinct(filter(split({v}, ''), d -> d rlike '[0-9]')))",
    }
    return "named_struct(" + ", ".join(f"'{n}', CAST({parts[n]} AS INT)" for n in FEATURES) + ")"


def touching(c: str, spans: str) -> str:
    return f"exists({spans}, b -> b.start < {c}.end AND {c}.start < b.end)"


def candidates(docs: DataFrame) -> DataFrame:
    """The rows with ``base`` spans and ``loose`` candidates that touch none of them, each with its vector ``f``.

    Both come out of one expression in which each array is bound to a variable, so a document with very many
    candidates is searched once and not once for each of them.
    """
    def both(base: str) -> str:
        free = f"filter({loose_spans('text')}, c -> NOT {touching('c', base)})"
        vectors = f"transform({free}, c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind, 'f', {vector('text', 'c')}))"
        return f"named_struct('base', {base}, 'loose', {vectors})"

    gated = docs.withColumn("has_digit", F.expr("text rlike '[0-9]'"))
    found = gated.withColumn("found", F.expr(let_sql(strict_spans("text"), both)))
    return found.withColumns({"base": F.col("found.base"), "loose": F.col("found.loose")}).drop("found", "has_digit")


def altered(value: str) -> str:
    """SQL: forms of a base span that its strict rule misses, by kind."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    # the check digit of another number; groups of four
    card = f"concat(substring({digits}, 1, length({digits}) - 1), (CAST(right({digits}, 1) AS INT) + 3) % 10)"
    grouped = "regexp_replace({0}, '([0-9]{{4}})(?=[0-9])', '$1{1}')"
    local = f"regexp_replace({value}, '^[+][0-9]{{1,3}}[ .-]*', '')"
    spelled = lambda v, at, dot: f"concat(split_part({v}, '@', 1), '{at}', replace(split_part({v}, '@', 2), '.', '{dot}'))"
    lettered = f"translate({value}, '0123456789', 'abcdefghij')"
    forms = {
        "email": [f"replace({lettered}, '@', ' [at] ')", spelled(lettered, "[at]", "[dot]"), f"replace({value}, '@', ' [at] ')",
                  spelled(value, "[at]", "[dot]"), f"replace({value}, '@', '(at)')", spelled(value, " (at) ", " (dot) ")],
        "ip": [f"replace({value}, '.', '[.]')", f"replace({value}, '.', '(.)')"],
        "card": [card, grouped.format(card, "-"), grouped.format(card, " "), grouped.format(digits, ".")],
        "phone": [f"substring({value}, 2)", local, f"regexp_replace({local}, '[^0-9]+', '.')", f"regexp_replace({local}, '[^0-9]+', '-')",
                  f"regexp_replace({local}, '[^0-9]+', ' ')"],
    }
    return "CASE " + " ".join(f"WHEN b.kind = {n} THEN array({', '.join(forms[k])})" for n, k in enumerate(KINDS)) + " END"


def lookalikes(h: str) -> str:
    """SQL: pairs of a word and something that looks like personal data and is none, from a hash."""
    part = lambda k, low, high: f"CAST({low} + pmod(shiftright({h}, {k}), {high - low + 1}) AS STRING)"
    two = lambda k, low, high: f"lpad({part(k, low, high)}, 2, '0')"
    day, month, year = two(3, 1, 28), two(9, 1, 12), part(13, 1950, 2035)
    clock = f"{two(5, 0, 23)}, ':', {two(11, 0, 59)}, ':', {two(17, 0, 59)}"
    made = [
        ("on", f"concat_ws('.', {day}, {month}, {year})"), ("since", f"concat_ws('-', {year}, {month}, {day})"),
        ("date", f"concat_ws('/', {month}, {day}, {year})"), ("until", f"concat_ws(' ', {day}, {month}, {year})"),
        ("at", f"concat({year}, '-', {month}, '-', {day}, ' ', {clock})"), ("time", f"concat({clock}, ':', {two(23, 0, 59)}, ':', {two(29, 0, 59)})"),
        ("version", f"concat_ws('.', {part(2, 1, 40)}, {part(7, 0, 99)}, {part(15, 0, 400)})"),
        ("release", f"concat_ws('.', {part(4, 10, 40)}, {part(8, 10, 99)}, {part(16, 300, 999)}, {part(21, 1000, 9999)})"),
        ("total", f"concat_ws('.', {part(6, 10, 999)}, {part(12, 100, 999)}, {part(20, 100, 999)})"),
        ("sum", f"concat_ws(' ', {part(6, 10, 99)}, {part(12, 100, 999)}, {part(20, 100, 999)})"),
        ("order", f"concat({year}, {month}, {day}, {part(19, 1000, 999999)})"), ("item", f"concat_ws('-', {part(1, 1000, 9999)}, {part(10, 10, 99)}, {part(18, 10, 99)})"),
        ("see", f"concat('step@', {part(5, 1, 99)})"), ("we meet", f"concat('all [at] ', {part(5, 1, 12)})"), ("run", "'job@main'"),
        ("from", "'deploy-service@cluster-main'"), ("owner", "'pipeline.build@production'"), ("all", "'everyone [at] noon'"),
        ("people", "'administrators [at] headquarters'"), ("only", "'x@y'"), ("buy", f"concat({part(5, 1, 99)}, '@', {part(9, 1, 99)})"),
    ]
    return "array(" + ", ".join(f"named_struct('word', '{w}', 'value', {v})" for w, v in made) + ")"


def examples(docs: DataFrame) -> DataFrame:
    """out (of the fit), kind, vector and label y of candidates in altered and in look-alike surroundings of all base spans."""
    gated = docs.withColumn("has_digit", F.expr("text rlike '[0-9]'"))
    spans = gated.select(
        (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0).alias("out"), "text", F.explode_outer(F.expr(strict_spans("text"))).alias("b")
    ).where("b IS NOT NULL")
    left = f"substring(text, CAST(greatest(b.start - {BESIDE}, 0) + 1 AS INT), CAST(least(b.start, {BESIDE}) AS INT))"
    beside = spans.selectExpr("out", "b", f"{left} AS before", f"substring(text, CAST(b.end AS INT) + 1, {BESIDE}) AS behind", "xxhash64(b.value) AS h")
    missed = f"transform({altered('b.value')}, v -> named_struct('before', before, 'value', v, 'kind', b.kind))"
    there = f"transform({lookalikes('h')}, x -> named_struct('before', before, 'value', x.value, 'kind', -1))"
    alone = f"transform({lookalikes('shiftleft(h, 1)')}, x -> named_struct('before', concat(' ', x.word, ' '), 'value', x.value, 'kind', -1))"
    made = beside.select("out", "behind", F.explode(F.expr(f"concat({missed}, {there}, {alone})")).alias("m")).selectExpr(
        "out", "concat(m.before, m.value, behind) AS text", "length(m.before) AS low", "length(m.before) + length(m.value) AS high", "m.kind AS meant"
    )
    found = candidates(made).select("out", "low", "high", "meant", F.explode("loose").alias("c"))
    return found.where("c.start < high AND low < c.end").selectExpr("out", "CAST(c.kind = meant AS DOUBLE) AS y", "c.f")


@dataclass
class Detector:
    """Trees as SQL over ``c.f`` and a threshold a kind; none if nothing could be learned."""

    margin: str | None
    thresholds: dict[int, float]


def number(x) -> str:
    """A DOUBLE literal; without the suffix Spark would take a DECIMAL."""
    return f"{float(x)!r}D"


def tree_sql(node) -> str:
    if node.numDescendants() == 0:
        return number(node.prediction())
    name = FEATURES[node.split().featureIndex()]
    return (
        f"CASE WHEN c.f.{name} <= {number(node.split().threshold())} THEN {tree_sql(node.leftChild())} "
        f"ELSE {tree_sql(node.rightChild())} END"
    )


def fit(docs: DataFrame, precision: float = PRECISION) -> Detector:
    """Learn from all documents; ``docs`` has doc_id and text."""
    counted = kept(
        examples(docs).groupBy("out", "y", *[F.col(f"f.{n}").alias(n) for n in FEATURES]).agg(F.count("*").cast("double").alias("n")),
        "pii-vectors",
    )
    fitted = counted.where("NOT out").orderBy(F.xxhash64(*FEATURES, "y"), *FEATURES, "y").limit(MAX_VECTORS)
    if fitted.select("y").distinct().count() < 2:
        return Detector(None, {})
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(fitted)
    trees = GBTClassifier(
        featuresCol="x", labelCol="y", weightCol="n", maxIter=TREES, maxDepth=DEPTH, stepSize=0.4, seed=5
    ).fit(table.coalesce(1).sortWithinPartitions(*FEATURES, "y"))
    parts = [
        f"{number(w)} * ({tree_sql(t.rootNode())})" for w, t in zip(trees.treeWeights, trees._java_obj.trees(), strict=True)
    ]
    margin = "round(" + " + ".join(parts) + ", 3)"
    scored = counted.where("out").selectExpr("kind", "y", "n", f"named_struct({', '.join(f"'{n}', {n}" for n in FEATURES)}) AS f")
    steps = (
        scored.selectExpr("kind", "y", "n", f"transform(array(named_struct('f', f)), c -> {margin})[0] AS m")
        .groupBy("kind", "m").agg(F.sum(F.expr("n * y")).alias("hits"), F.sum("n").alias("n")).collect()
    )
    thresholds = {}
    for kind in range(len(KINDS)):
        hits = total = 0.0
        rows = sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["m"])
        for row, lower in zip(rows, [*(r["m"] for r in rows[1:]), None], strict=False):
            hits, total = hits + row["hits"], total + row["n"]
            if row["m"] > 0 and hits / total >= precision:
                # half way to the next margin that was seen: what lies between was not, and the precision stays
                thresholds[kind] = round(max(0.0, (row["m"] + (-row["m"] if lower is None else lower)) / 2), 4)
    released(counted)
    return Detector(margin, thresholds)


def detect(docs: DataFrame, detector: Detector) -> DataFrame:
    """The rows with ``base`` and ``spans``, sorted arrays of start, end, kind and value or score."""
    found = candidates(docs)
    plain = "transform(base, b -> named_struct('start', b.start, 'kind', b.kind, 'end', b.end))"
    added = "CAST(array() AS array<struct<start: bigint, kind: int, end: bigint>>)"
    if detector.margin and detector.thresholds:
        passes = " OR ".join(f"(c.kind = {k} AND m >= {number(t)})" for k, t in sorted(detector.thresholds.items()))
        scored = let_sql(f"({detector.margin})", lambda m: "(" + passes.replace("m >=", f"{m} >=") + ")")
        added = (
            f"transform(filter(loose, c -> {scored}), "
            "c -> named_struct('start', c.start, 'kind', c.kind, 'end', c.end))"
        )
    return found.withColumn("spans", F.expr(f"array_sort(array_distinct(concat({plain}, {added})))")).drop("loose")


def names() -> str:
    return "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"


def listed(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat({names()}[s.kind], ':', s.start, ':', s.end)), ',')"


def redacted(text: str, spans: str) -> str:
    """SQL: the text with every span replaced by its kind in brackets; spans that overlap count as one."""
    def body(ends: str) -> str:
        def with_before(prev: str) -> str:
            piece = (
                f"CASE WHEN s.end <= {prev}[i] THEN '' ELSE concat(substring({text}, CAST(greatest({prev}[i], 0) AS INT) + 1, "
                f"CAST(greatest(s.start - greatest({prev}[i], 0), 0) AS INT)), "
                f"CASE WHEN s.start < {prev}[i] THEN '' ELSE concat('[', upper({names()}[s.kind]), ']') END) END"
            )
            return (
                f"concat(array_join(transform({spans}, (s, i) -> {piece}), ''), "
                f"substring({text}, CAST(array_max({ends}) AS INT) + 1))"
            )

        return let_sql(max_before_sql(ends), with_before)

    return f"CASE WHEN size({spans}) = 0 THEN {text} ELSE {let_sql(f'transform({spans}, s -> s.end)', body)} END"


def report(docs: DataFrame, detector: Detector) -> DataFrame:
    """One row a document: counts and digest of the base spans, and all spans."""
    found = detect(texts(docs), detector)
    counts = [F.expr(f"CAST(size(filter(base, b -> b.kind = {n})) AS BIGINT) AS n_{k}") for n, k in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.expr(f"sha2({listed('base')}, 256) AS base_sha256"), F.expr(f"{listed('spans')} AS spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the spans in ``text`` replaced; other columns stay, ``n_chars`` follows the text."""
    detector = fit(texts(docs))
    found = detect(packed(docs), detector).withColumn("clean", F.expr(redacted("text", "spans")))
    columns = []
    for name in docs.columns:
        old = F.col(ROW)[name]
        if name == "text":
            old = F.when(old.isNotNull(), F.col("clean"))
        elif name == "n_chars":
            old = F.when(old.isNotNull(), F.length("clean").cast(docs.schema[name].dataType))
        columns.append(old.alias(name))
    return found.select(columns)
