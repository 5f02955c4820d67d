"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms, its words with their counts. For each of ``SAMPLES`` draws every term gets the same
gamma variates r, c and the same uniform b wherever it occurs, from hashes of the term and the draw. With weight S it
takes t = floor(ln S / r + b) and the rank ln c - r (t - b) - r; the term of lowest rank is drawn, with its t. Two
texts draw the same pair with probability equal to their generalised Jaccard similarity sum min / sum max.

The rank and the drawn pair are packed into one whole number, so a draw is the minimum of a column, and everything
runs in generated code behind one exchange: documents are dealt into buckets along their ids, and the first document
of each bucket is a guest in the bucket before it, so neighbours meet without a global sort.

Defined cases: a null text is empty; an empty text has the fingerprint of zeros, two of which are alike and like no
other; documents of equal id are ordered by their text's hash; null ids come last; a single document is followed by
itself; repeated rows have a row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts
from .order import bucket_of

SAMPLES = 32
#: Words; runs without white space are cut, so that texts of other scripts have more than one term.
TERM = r"\S{1,12}"
LOW = (1 << 31) - 1


def draw(k: int) -> str:
    """SQL over the term hash ``h`` and ``weight``, the logarithm of its count: rank and drawn pair of one draw, as one whole number."""
    a, b = f"xxhash64(h, {2 * k})", f"xxhash64(h, {2 * k + 1})"
    unit = lambda z, shift: f"((shiftrightunsigned({z}, {shift}) & 16777215L) + 0.5D) / 16777216D"
    r = f"(-ln({unit(a, 40)} * {unit(a, 16)}))"
    c = f"(-ln({unit(b, 40)} * {unit(b, 16)}))"
    beta = f"((({a} & 65535L) + 0.5D) / 65536D)"
    t = f"floor(weight / {r} + {beta})"
    rank = f"(ln({c}) - {r} * ({t} - {beta} + 1D))"
    pair = f"(({b} ^ (CAST({t} AS BIGINT) * 40503L)) & {LOW}L)"
    place = f"CAST(greatest(0D, least(4294967295D, ({rank} + 96D) * 33554432D)) AS BIGINT)"
    return f"{place} * 2147483648L + {pair}"


def with_terms(df: DataFrame, text: str) -> DataFrame:
    """One row for each distinct term of ``text`` with its hash and the logarithm of its count; a text without terms has one null row."""
    words = f"transform(regexp_extract_all({text}, '{TERM.replace(chr(92), chr(92) * 2)}', 0), w -> xxhash64(w))"
    sorted_ = df.withColumn("hs", F.expr(f"sort_array({words})")).drop(text)
    runs = sorted_.withColumn(
        "runs", F.expr("CASE WHEN size(hs) > 0 THEN filter(sequence(0, size(hs) - 1), i -> i = 0 OR hs[i] != hs[i - 1]) ELSE array() END")
    )
    rest = [c for c in df.columns if c != text]
    each = runs.select(*rest, "hs", "runs", F.posexplode_outer("runs").alias("nth", "at"))
    return each.select(
        *rest, F.expr("get(hs, at)").alias("h"), F.expr("ln(CAST(coalesce(get(runs, nth + 1), size(hs)) - at AS DOUBLE))").alias("weight")
    )


def signatures(df: DataFrame, keys: list[str], text: str, carried: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys``, the whole numbers in ``carried``, and ``sig``, an array with the pair of each draw."""
    draws = [F.min(F.expr(f"CASE WHEN h IS NOT NULL THEN {draw(k)} END")).alias(f"s{k}") for k in range(samples)]
    grouped = with_terms(df.select(*keys, *carried, text), text).groupBy(*keys).agg(*[F.max(c).alias(c) for c in carried], *draws)
    sig = F.array(*[F.coalesce(F.col(f"s{k}").bitwiseAND(LOW), F.lit(0)) for k in range(samples)])
    return grouped.select(*keys, *carried, sig.alias("sig"))


def hex_words(digest: str) -> list[str]:
    """SQL: a sha256 in hex as four whole numbers, which an aggregation can hold in place."""
    return [f"CAST(conv(substring({digest}, {1 + 16 * k}, 16), 16, -10) AS BIGINT)" for k in range(4)]


def alike(a: str, b: str) -> str:
    return f"(size(filter(zip_with({a}, {b}, (x, y) -> x = y), z -> z)) / CAST(size({a}) AS DOUBLE))"


def printed(sig: str) -> str:
    return f"array_join(transform({sig}, x -> lower(lpad(hex(x), 8, '0'))), '')"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of every row."""
    rows = texts(docs).withColumn("uid", F.monotonically_increasing_id())
    return signatures(rows, ["uid"], "text", ["doc_id"]).select("doc_id", F.expr(printed("sig")).alias("fingerprint"))


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document against its edited form and against the next document, by descending id."""
    rows = texts(docs)
    placed = rows.withColumns({"bucket": bucket_of(rows), "h": F.xxhash64("text")})
    heads = (
        placed.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("head")).collect()
    )  # a row for each bucket, of which there is a bounded number
    numbers = sorted(r["bucket"] for r in heads)
    host = {b: numbers[(k + 1) % len(numbers)] for k, b in enumerate(numbers)}
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(r["bucket"], r["head"]["doc_id"], r["head"]["h"], host[r["bucket"]]) for r in heads],
        "bucket int, head_id long, head_h long, host int",
    )
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    own = F.struct(F.col("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest"))
    dealt = (
        placed.join(F.broadcast(table), "bucket")
        .select("doc_id", "text", "h", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))).alias("at"))
        .select("at.bucket", "at.guest", "doc_id", "h", "text")
    )
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    met = dealt.withColumns({"place": F.row_number().over(order), "next": F.lead("text").over(order)})
    third = "CAST(floor(length(text) / 3) AS INT)"
    edited = f"concat(substring(text, 1, length(text) - {third}), substring(next, 1, {third}))"
    both = (
        met.withColumn("edited", F.expr(f"CASE WHEN guest = 0 THEN {edited} END"))
        .withColumn("sha", F.sha2("edited", 256))
        .select(
            "bucket", "place", F.col("doc_id").cast("long").alias("doc_id"), F.col("guest").cast("long").alias("guest"),
            F.length("text").cast("long").alias("n_chars"), *[F.expr(x).alias(f"sha{k}") for k, x in enumerate(hex_words("sha"))],
            F.explode(F.expr("CASE WHEN guest = 0 THEN array(named_struct('kind', 0, 'text', text), named_struct('kind', 1, 'text', edited)) "
                             "ELSE array(named_struct('kind', 0, 'text', text)) END")).alias("version"),
        )
        .select("bucket", "place", "version.kind", "doc_id", "guest", "n_chars", "sha0", "sha1", "sha2", "sha3", "version.text")
    )
    signed = signatures(both, ["bucket", "place", "kind"], "text", ["doc_id", "guest", "n_chars", "sha0", "sha1", "sha2", "sha3"])
    line = Window.partitionBy("bucket").orderBy("place", "kind")
    beside = signed.withColumns({"edited": F.lead("sig", 1).over(line), "next": F.lead("sig", 2).over(line)})
    digest = "lower(concat(" + ", ".join(f"lpad(hex(sha{k}), 16, '0')" for k in range(4)) + "))"
    return beside.where("kind = 0 AND guest = 0").select(
        F.col("doc_id").cast(rows.schema["doc_id"].dataType).alias("doc_id"), "n_chars", F.expr(digest).alias("edited_sha256"),
        F.expr(printed("sig")).alias("fingerprint"), F.expr(printed("edited")).alias("edited_fingerprint"),
        F.expr(alike("sig", "edited")).alias("near_edited"), F.expr(alike("sig", "next")).alias("near_next"),
    )
