"""Texts against a table of patterns, by an index of what a match has to contain.

A wildcard pattern has literal parts, and each match holds the longest of them, its anchor. One gram of the anchor, the
one that fewest patterns share, is the pattern's key; a text has all its grams. Equal keys give candidates, and only
these are tested by the pattern's regular expression. So texts and patterns meet in joins on equality, which Spark
broadcasts or shuffles as their sizes ask, and both tables may be of any length. A pattern without a literal part has
the empty key, which every text has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAMS = (6, 3, 1)
#: Up to so many patterns become one expression, which costs no join; the rows are the same.
FEW = 1_000


def few(table: DataFrame) -> list | None:
    """The rows of a short table, null for a longer one."""
    rows = table.limit(FEW + 1).collect()
    return rows if len(rows) <= FEW else None


def any_regex(text: Column, regexes) -> Column:
    regexes = sorted(r for r in regexes if r is not None)
    return F.coalesce(text.rlike("|".join(regexes)), F.lit(False)) if regexes else F.lit(False)


def glob_anchor(glob: str) -> str:
    """The longest text that every match of a path glob holds: no wildcard, class or alternative, nor what may be missing."""
    runs, i, depth = [""], 0, 0
    while i < len(glob):
        ch = glob[i]
        if ch == "\\" and i + 1 < len(glob) and not depth:
            runs[-1] += glob[i + 1]
            i += 2
            continue
        if ch == "[":
            i = max(glob.find("]", i + 2), i)
        depth += (ch == "{") - (ch == "}" and depth > 0)
        if ch in "*?[{}" or depth:
            runs.append("")
            # the separator after a double star is optional
            if ch == "*" and glob[i : i + 3] == "**/":
                i += 2
        else:
            runs[-1] += ch
        i += 1
    return max(runs, key=len)


def star_anchor(pattern: Column) -> Column:
    """The longest part of a pattern between its ``*``."""
    parts = F.transform(F.split(pattern, r"\*"), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))
    return F.array_max(parts)["p"]


def gram_size(anchor: Column) -> Column:
    size = F.lit(0)
    for g in reversed(GRAMS):
        size = F.when(F.length(anchor) >= g, g).otherwise(size)
    return size


def grams_of(text: Column, size: int) -> Column:
    """All runs of ``size`` characters, each once."""
    if size == 0:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def keyed(patterns: DataFrame, pattern: str, anchor: str) -> DataFrame:
    """``pattern`` (distinct), its ``size`` and ``gram``, the one of its anchor that fewest patterns share."""
    sized = patterns.select(pattern, anchor, gram_size(F.col(anchor)).alias("size")).distinct()
    every = F.array().cast("array<string>")
    for g in (*GRAMS, 0):
        every = F.when(F.col("size") == g, grams_of(F.col(anchor), g)).otherwise(every)
    each = sized.select(pattern, "size", F.explode(every).alias("gram"))
    shared = each.groupBy("gram").agg(F.count(F.lit(1)).alias("shared"))
    return each.join(shared, "gram").groupBy(pattern, "size").agg(F.min(F.struct("shared", "gram"))["gram"].alias("gram"))


def matches(texts: DataFrame, patterns: DataFrame, *, pattern: str, anchor: str) -> DataFrame:
    """(text, pattern) for each pattern, a regular expression, that covers a text of the column ``text``; each pair once.

    Null texts and null patterns match nothing. Grams travel with a hash of their text, so long texts are not copied;
    texts of equal hashes are told apart by the test itself.
    """
    index = keyed(patterns.where(F.col(pattern).isNotNull()), pattern, anchor)
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())
    if not sizes:
        return texts.select("text").limit(0).crossJoin(patterns.select(pattern).limit(0))
    known = texts.where(F.col("text").isNotNull()).select("text").distinct().withColumn("__id", F.xxhash64("text"))
    grams = known.select("__id", F.explode(F.concat(*[grams_of(F.col("text"), g) for g in sizes])).alias("gram"))
    found = grams.join(index.select(pattern, "gram"), "gram").select("__id", pattern).distinct()
    return found.join(known, "__id").where(F.rlike(F.col("text"), F.col(pattern))).select("text", pattern)
