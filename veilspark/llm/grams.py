"""Rolling word k-grams of documents, joined by hash to the k-grams of a table of templates.

One pass: each document gives one marker row and the hash of every k-gram; a broadcast hash join keeps the marker and
the k-grams that a template has, and compares the words of those. The document's words never enter a shuffle: what
leaves the scan are positions and the words of hits. A task holds all rows of one document at once, so none of them holds
the document's arrays, else a long text with many hits would take the product of both. The side that is broadcast is
measured as it lies in memory; beyond the limit it is cut by template into parts that fit, and the documents are passed
once for each part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def gram_hash(words: str, k: int, form: int) -> str:
    """SQL: hashes of all k-grams of an array, in order; an array shorter than k has none."""
    parts = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return (
        f"CASE WHEN size({words}) >= {k} THEN transform(sequence(0, size({words}) - {k}), i -> xxhash64({form}, {parts})) "
        "ELSE CAST(array() AS array<bigint>) END"
    )


def template_grams(templates: DataFrame, form: int, k: int, words: str = "words", beside: str = "words") -> DataFrame:
    """h, form, k, template, at, gram and mine for each k-gram of the templates that are matched with this k.

    ``mine`` is the same slice of ``beside``, an array as long as the words.
    """
    parts = f"named_struct('h', h, 'gram', slice({words}, i + 1, {k}), 'mine', slice({beside}, i + 1, {k}))"
    return templates.select(
        "template", F.posexplode(F.expr(f"transform({gram_hash(words, k, form)}, (h, i) -> {parts})")).alias("at", "g")
    ).select(F.col("g.h").alias("h"), F.lit(form).alias("form"), F.lit(k).alias("k"), "template", "at", "g.gram", "g.mine")


def row_bytes(grams: DataFrame) -> int:
    """Bytes of ``grams`` as rows in memory; their compressed files say little, as neighbours share all words but one."""
    words = "aggregate({0}, 16L, (n, w) -> n + 8 + (octet_length(w) + 7) DIV 8 * 8)"
    size = F.expr(f"64 + {words.format('gram')} + {words.format('mine')}")
    return grams.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long")).first()[0]


def hits(docs: DataFrame, grams: DataFrame, wanted: list[tuple[str, int, int]], beside: dict[str, str] | None = None) -> DataFrame:
    """Rows of (uid, doc_id, n_words, template, form, k, pos, at) for every k-gram of a document that a template has.

    ``docs`` has doc_id and the word arrays; ``wanted`` lists (array column, form, k). Every document also has one
    row with template null. ``beside`` names for each word array one that is as long; hits then also have ``mine``
    of the template and ``theirs``, the same slice of that array of the document.
    """
    array_of = {f: a for a, f, _ in wanted}
    arrays = [*dict.fromkeys([*array_of.values(), *(beside or {}).values()])]
    ends = ["1"]
    for a, _, k in wanted:
        ends.append(f"{ends[-1]} + greatest(size({a}) - {k - 1}, 0)")
    form, place = "CASE WHEN e = 0 THEN -1", "CASE WHEN e = 0 THEN -1"
    for low, high, (_, f, k) in zip(ends, ends[1:], wanted, strict=False):
        form += f" WHEN e < {high} THEN {f * 1000 + k}"
        place += f" WHEN e < {high} THEN e - ({low})"

    def by_form(what) -> str:
        """SQL: ``what`` of the arrays' forms; the code is no longer for many k, or the compiler would leave it."""
        return "CASE " + " ".join(f"WHEN fk < {(f + 1) * 1000} THEN {what(f, a)}" for f, a in sorted(array_of.items())) + " END"

    def sliced(array: str) -> str:
        return f"slice({array}, pos + 1, fk % 1000)"

    # one number for each k-gram, not an array of hashes: what follows is generated code, up to the hits. The outer form,
    # since for the inner one Catalyst infers a filter over the sequence; it is never empty
    rows = docs.withColumn("uid", F.monotonically_increasing_id()).select(
        "uid", "doc_id", *arrays, F.explode_outer(F.expr(f"sequence(0, {ends[-1]} - 1)")).alias("e")
    )
    placed = rows.withColumns({"fk": F.expr(f"{form} ELSE -1 END"), "pos": F.expr(f"{place} END")}).withColumn(
        "h", F.coalesce(F.expr(f"CASE WHEN fk >= 0 THEN {by_form(lambda f, a: f'xxhash64({f}, {sliced(a)})')} END"), F.lit(0))
    )
    marker = "SELECT 0L AS h, -1 AS form_k, CAST(NULL AS bigint) AS template, 0 AS at, CAST(NULL AS array<string>) AS gram, CAST(NULL AS array<string>) AS mine"
    keyed = grams.select("h", (F.col("form") * 1000 + F.col("k")).alias("form_k"), F.col("template").cast("bigint"), "at", "gram", "mine")
    side = keyed.unionByName(docs.sparkSession.sql(marker))
    parts = max(1, -(-row_bytes(grams) // BROADCAST_BYTES))
    # no part is told by h and no key can be null: Catalyst would infer filters that compute all hashes twice
    cut = F.pmod(F.coalesce("template", F.lit(0)), F.lit(parts))
    found = reduce(DataFrame.unionByName, [
        placed.join(F.broadcast(side.where(cut == part) if parts > 1 else side), "h") for part in range(parts)
    ]).where(F.expr(f"fk - form_k = 0 AND CASE WHEN fk = -1 THEN true ELSE {by_form(lambda f, a: f'{sliced(a)} = gram')} END"))
    words = []
    if beside:
        # as a generated row, since Catalyst would move a plain column up to where it is used, and the arrays with it
        found = found.select("*", F.explode_outer(F.expr(f"array(CASE WHEN fk >= 0 THEN {by_form(lambda f, a: sliced(beside[a]))} END)")).alias("theirs"))
        words = ["mine", "theirs"]
    return found.select(
        "uid", "doc_id", F.size(arrays[0]).cast("long").alias("n_words"), "template", F.expr("fk DIV 1000").cast("int").alias("form"),
        F.expr("fk % 1000").cast("int").alias("k"), "pos", "at", *words
    )
