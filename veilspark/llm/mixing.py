"""Mixing sources to target weights by the cube method.

Every document of a source should be taken target / size of the source times. The whole part of that ratio is taken as it
is; what is left is an inclusion probability, equal for all documents of the source. The cube method turns these into
zeros and ones and keeps two sums of each source as they are: the words and the documents that are taken. The flight
holds three undecided documents at a time. The vector in the null space of their constraints, (size, 1), is the cross
product of the two rows; probabilities move along it, to one side or the other with the chances that keep their mean,
until one of them is 0 or 1 and another document comes in. When no document is left at most two are undecided.

A source of many rows is flown in blocks of about ``BLOCK`` rows, in tasks of their own; what each leaves undecided flies
again with that of other blocks, until one block holds all. Only then does a source land: its last two documents, at most,
are rounded so that its words come nearest. So the words of a source differ from its target by less than two documents.

Targets: sources have the weights 3, 1, 2 in turn, by their name, null last. They share a multiple of all words; a target
stops at ``CAP`` times its source, and the excess goes to the others by weight until none is above. As that only raises
the words a unit of weight gets, the loop's state is this one number, and each round is one aggregation.

Draws come from a generator seeded with the seed, the source's place, the level and the block, over rows sorted by a hash
of the id, so reruns agree. The flight is a stream over sorted rows and holds three of them.

Defined cases: a null text has size 0; documents of size 0 are drawn like others and add no words; a null source is a
source of its own; null ids and repeated rows take part one by one, and rows of one id and size are in one block, whatever
its length; a source without words has target 0; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import random
from functools import reduce
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joinable, kept
from .ranks import ranked

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK = 20_000
SEED = 42
WORD = r"[^\\x20\\x09-\\x0D]++"
EDGE = 1e-9
FLYING = ("place", "blocks", "block", "doc_id", "size", "draw", "chance")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words of every row, with ``draw``, the hash that orders the flight."""
    size = F.expr(f"CAST(regexp_count(coalesce(text, ''), '{WORD}') AS BIGINT)")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))
    return rows.withColumn("draw", F.xxhash64(F.lit(SEED), "doc_id", "size"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """place, source, rows, source_size and target of every source."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    placed = ranked(sources, [F.col("source").asc_nulls_last()], "mixing-sources").withColumnRenamed("position", "place")
    turn = F.array(*map(F.lit, weights))
    known = kept(placed.withColumn("weight", F.get(turn, F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int"))), "mixing-weights")
    total = known.agg(F.sum("source_size")).first()[0]
    most, per_weight = cap * F.col("source_size"), 0.0
    while total:
        full = most < per_weight * F.col("weight")
        spent, left = known.agg(
            F.coalesce(F.sum(F.when(full, most)), F.lit(0)).cast("double"), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        raised = (share * total - spent) / left if left else float("inf")
        if raised <= per_weight:
            break
        per_weight = raised
    # a source on the edge is full as well, so that it is taken a whole number of times
    target = F.when(most <= per_weight * F.col("weight"), most.cast("double")).otherwise(per_weight * F.col("weight"))
    return kept(known.withColumn("target", target), "mixing-targets")


class Flight:
    """The undecided documents of one block: each is [payload, size, probability]."""

    def __init__(self, seed: str):
        self.open: list[list] = []
        self.draws = random.Random(seed)

    def add(self, payload, size: int, chance: float) -> list[tuple[object, int]]:
        """Take one more document in; gives the documents that this decides, with 0 or 1."""
        self.open.append([payload, size, chance])
        return self.move() if len(self.open) > 2 else []

    def move(self) -> list[tuple[object, int]]:
        a, b, c = (u[1] for u in self.open)
        way = (c - b, a - c, b - a)
        if not any(way):
            way = (1, -1, 0)
        chances = [u[2] for u in self.open]
        forth = min((1 - p if w > 0 else p) / abs(w) for p, w in zip(chances, way, strict=True) if w)
        back = min((p if w > 0 else 1 - p) / abs(w) for p, w in zip(chances, way, strict=True) if w)
        step = forth if self.draws.random() * (forth + back) < back else -back
        decided, left = [], []
        for unit, w in zip(self.open, way, strict=True):
            unit[2] += step * w
            if EDGE < unit[2] < 1 - EDGE:
                left.append(unit)
            else:
                decided.append((unit[0], int(unit[2] > 0.5)))
        self.open = left
        return decided

    def land(self) -> list[tuple[object, int]]:
        """Round the last documents so that the words, then the number of documents, come nearest."""
        def cost(bits):
            moved = [(b - u[2], u[1]) for b, u in zip(bits, self.open, strict=True)]
            return abs(sum(d * s for d, s in moved)), abs(sum(d for d, _ in moved)), bits

        best = min(product((0, 1), repeat=len(self.open)), key=cost)
        return [(u[0], b) for u, b in zip(self.open, best, strict=True)]


def fly(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """The rows with ``taken``: 0, 1, or null if it is undecided; then ``chance`` is where the flight left it.

    ``rows`` has the columns of ``FLYING``. A source of one block lands.
    """
    def pilot(batches):
        flight, group, last = None, None, False

        def closed():
            chances = {id(u[0]): u[2] for u in flight.open}
            ends = flight.land() if last else [(u[0], None) for u in flight.open]
            return [(*p[:-1], chances[id(p)], t) for p, t in ends]

        def batch_of(found):
            columns = zip(*found, strict=True) if found else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [*FLYING, "taken"])

        for batch in batches:
            kinds = [*(batch.schema.field(n).type for n in FLYING), pa.int32()]
            out = []
            for unit in zip(*(batch[n].to_pylist() for n in FLYING), strict=True):
                place, blocks, block, _, size, _, chance = unit
                if (place, block) != group:
                    if flight:
                        out += closed()
                    group, last, flight = (place, block), blocks == 1, Flight(f"{seed}:{place}:{level}:{block}")
                out += [(*p, t) for p, t in flight.add(unit, size, chance)]
            yield batch_of(out)
        if flight:
            yield batch_of(closed())

    rows = rows.select(*FLYING)
    kinds = ", ".join(f"{n} {k}" for n, k in rows.dtypes)
    dealt = rows.repartition("place", "block").sortWithinPartitions("place", "block", "draw", "doc_id", "size", "chance")
    return dealt.mapInArrow(pilot, f"{kinds}, taken int")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = SEED
) -> DataFrame:
    """doc_id, source, size, source_size, target (of its source), times (a document is taken) and taken (its words)."""
    rows = kept(measured(docs), "mixing-sizes")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = targets(rows, weights, share, cap).withColumns({
        "whole": F.floor(ratio).cast("int"), "chance": ratio - F.floor(ratio), "blocks": F.ceil(F.col("rows") / block).cast("long"),
    })
    named = joinable(known.select(F.col("source").alias("name"), "place", "chance", "blocks"))
    joined = rows.join(named, F.col("source").eqNullSafe(F.col("name")))
    still = F.col("chance") <= EDGE
    settled = [joined.where(still).select("place", "doc_id", "size", F.lit(0).alias("taken"))]
    flying, level = joined.where(~still).withColumn("block", F.pmod("draw", "blocks")), 0
    # a block leaves two rows at most, so the rows of this many blocks make one of the next level
    half = block // 2
    while True:
        found = kept(fly(flying, level, seed), "mixing-flight")
        settled.append(found.where("taken IS NOT NULL").select("place", "doc_id", "size", "taken"))
        left = found.where("taken IS NULL")
        if left.isEmpty():
            break
        flying, level = left.withColumns({"blocks": F.ceil(F.col("blocks") / half), "block": F.floor(F.col("block") / half)}), level + 1
    facts = joinable(known.select("place", "source", "source_size", "target", "whole"))
    return reduce(DataFrame.unionByName, settled).join(facts, "place").withColumn("times", F.col("whole") + F.col("taken")).select(
        "doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken")
    )
