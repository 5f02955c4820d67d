"""Shards of near-equal bytes by a k-d tree over document metadata.

The points are groups of equal texts, with the logarithm of their size and the hashes of their language and source as
dimensions, weighted by their bytes. A node that stands for k shards is cut along its widest dimension at the weighted
quantile that gives the two sides k/2 shards each, until a leaf has the bytes of one shard. A group of more than
``SPLIT`` of a shard is first dealt into parts by the hash of the id, so a group may hold any share of all rows; every
other group stays whole. Ties along a dimension are ordered by a hash of the group.

A quantile is found for all nodes of a level at once from sums over ranges of the coordinate, narrowed until the range
holds one point. The driver sees these sums and the cuts, never the points.

Defined cases: a null text has no bytes, so size 16 and crc 0; an empty table has no rows; with fewer groups than shards
some shards are empty; null metadata counts as the empty text; repeated rows are rows of their own in one group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

SHARDS = 40
OVERHEAD = 16
#: Share of a shard's bytes above which a group of equal texts is dealt into parts.
SPLIT = 0.05
BINS = 1024
SLOT_ROWS = 2_000
SLOT_BUCKETS = 4_096
DIMENSIONS = ("c0", "c1", "c2")


@dataclass
class Node:
    """A leaf stands for one shard; another node sends points at or below ``cut`` along ``dim`` to the left."""

    first: int
    shards: int
    dim: str | None = None
    cut: int | None = None
    left: Node | None = None
    right: Node | None = None

    def sql(self) -> str:
        """SQL: the first shard of the lowest node that a point is in."""
        if self.cut is None:
            return str(self.first)
        return f"CASE WHEN {self.dim} <= {self.cut}L THEN {self.left.sql()} ELSE {self.right.sql()} END"

    def open(self) -> list[Node]:
        if self.cut is not None:
            return self.left.open() + self.right.open()
        return [self] if self.shards > 1 else []


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the group's key and the metadata; missing metadata columns count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    extra = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in ("lang", "source")]
    return docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"), extra[0].alias("lang"), extra[1].alias("source"),
    )


def points(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their part, and one point for each group and part."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    limit = max(1.0, SPLIT * total / shards)
    # each of these groups has over SPLIT / shards of all bytes, so there are at most shards / SPLIT of them
    large = rows.groupBy("key", "size").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > limit).where("bytes > size")
    parts = F.broadcast(large.select("key", "size", F.ceil(F.col("bytes") / limit).cast("long").alias("parts")))
    dealt = rows.join(parts, ["key", "size"], "left").withColumn(
        "part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("parts"))).otherwise(F.lit(0)).cast("int")
    ).drop("parts")
    groups = dealt.groupBy("key", "size", "part").agg(F.sum("size").alias("bytes"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    tie = F.shiftrightunsigned(F.xxhash64("key", "size", "part"), 32)
    values = (
        F.floor(F.log2(F.col("size").cast("double")) * (1 << 25)).cast("long"),
        F.shiftrightunsigned(F.xxhash64("lang"), 33), F.shiftrightunsigned(F.xxhash64("source"), 33),
    )
    coordinates = [(v * (1 << 32) + tie).alias(c) for v, c in zip(values, DIMENSIONS, strict=True)]
    return dealt, groups.select("key", "size", "part", "bytes", *coordinates)


@dataclass
class Search:
    """The range in which a node's cut lies, and the bytes below that range that the left side has already."""

    node: Node
    dim: str
    low: int
    high: int
    wanted: float
    below: float = 0.0

    @property
    def width(self) -> int:
        return -(-(self.high - self.low + 1) // BINS)


def split_level(table: DataFrame, root: Node, spread: dict[str, int]) -> bool:
    """Cut every open node once; false if there is none."""
    nodes = {n.first: n for n in root.open()}
    if not nodes:
        return False
    before = root.sql()  # the tree as it is while this level's cuts are looked for
    at = F.expr(before).alias("node")
    bounds = [f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]
    seen = table.select(at, "bytes", *DIMENSIONS).groupBy("node").agg(F.sum("bytes").alias("bytes"), *bounds)
    searches = []
    found = {r["node"]: r for r in seen.collect()}
    for first, node in nodes.items():
        half = node.shards // 2
        node.left, node.right = Node(first, half), Node(first + half, node.shards - half)
        if first not in found:
            node.dim, node.cut = DIMENSIONS[0], 0
            continue
        row = found[first]
        dim = max(DIMENSIONS, key=lambda c: ((row[f"high_{c}"] - row[f"low_{c}"]) / spread[c], -DIMENSIONS.index(c)))
        searches.append(Search(node, dim, row[f"low_{dim}"], row[f"high_{dim}"], row["bytes"] * half / node.shards))
    while searches:
        # looked up by node; a filter here would be pushed down and repeat the tree's expression
        of = {s.node.first: s for s in searches}
        listed = lambda f: "array(" + ", ".join(f(of[k]) if k in of else "NULL" for k in range(root.shards)) + ")"
        reach = {
            "d": listed(lambda s: str(DIMENSIONS.index(s.dim))), "l": listed(lambda s: f"{s.low}L"),
            "h": listed(lambda s: f"{s.high}L"), "w": listed(lambda s: f"{s.width}L"),
        }
        ranged = table.select(F.expr(before).alias("node"), "bytes", *DIMENSIONS).select(
            "node", "bytes", *DIMENSIONS, *[F.expr(f"get({x}, node)").alias(n) for n, x in reach.items()]
        ).select("node", "bytes", F.expr(f"get(array({', '.join(DIMENSIONS)}), d)").alias("c"), "l", "h", "w")
        binned = (
            ranged.select("node", "bytes", "c", F.expr("CASE WHEN c BETWEEN l AND h THEN (c - l) DIV w END").alias("bin"))
            .groupBy("node", "bin").agg(F.sum("bytes").alias("bytes"), F.min("c").alias("least"), F.max("c").alias("most"))
        )
        sums: dict[int, list] = {}
        for row in binned.collect():
            if row["bin"] is not None:
                sums.setdefault(row["node"], []).append(row)
        searches = [s for s in searches if narrow(s, sorted(sums.get(s.node.first, []), key=lambda r: r["bin"]))]
    return True


def narrow(search: Search, bins: list) -> bool:
    """Move to the bin in which the wished bytes are reached; set the cut once that bin is a single value."""
    for row in bins:
        if search.below + row["bytes"] >= search.wanted:
            if row["least"] == row["most"]:
                over = search.below + row["bytes"] - search.wanted
                search.node.dim = search.dim
                search.node.cut = row["least"] if over <= search.wanted - search.below else row["least"] - 1
                return False
            search.low, search.high = row["least"], row["most"]
            return True
        search.below += row["bytes"]
    search.node.dim, search.node.cut = search.dim, search.high
    return False


def grow(table: DataFrame, shards: int) -> Node:
    root = Node(0, shards)
    ends = table.agg(*[f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]).first()
    spread = {c: max(1, (ends[f"high_{c}"] or 0) - (ends[f"low_{c}"] or 0)) for c in DIMENSIONS}
    while split_level(table, root, spread):
        pass
    return root


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; slots of a shard run from 0 without a gap."""
    rows = kept(described(docs), "shard-rows")
    dealt, groups = points(rows, shards)
    table = kept(groups, "shard-points")
    root = grow(table, shards)
    homes = table.select("key", "size", "part", F.expr(root.sql()).cast("int").alias("shard"))
    placed = kept(dealt.join(homes, ["key", "size", "part"]).select("doc_id", "size", "text_crc32", "key", "shard"), "shard-homes")
    # row numbers of small buckets, on top of the counts of the buckets before them
    buckets = max(1, min(SLOT_BUCKETS, placed.count() // (shards * SLOT_ROWS)))
    spread = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        spread.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "key")
    return (
        spread.withColumn("place", F.row_number().over(order)).join(F.broadcast(offsets), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"))
    )
