"""N-gram Jaccard join by chosen paths.

Texts are sets of hashed word five-grams. Each run sends a set down a tree: at a node every token of the set is chosen
with probability ``TOKENS`` / size, by a hash of the node and the token, and the set enters the bucket of each chosen
token. Similar sets choose common tokens, so they meet. Small buckets are compared by brute force on short minhash
signatures, and those of up to ``WHOLE`` sets on both signatures of each set, so that few sets that merely have a line in
common are tied; a row of such a bucket costs less there than below it. A bucket that is larger is compared with its first
member, which takes out all that are very like it (whatever is similar to one of these is tied to the first member as
well), and the rest goes one level down, to ``TOKENS`` children a row in the mean. With
``TOKENS`` = 2 a pair of similarity 0.8 survives each level with probability over 0.66, and ``runs_for`` gives the
number of runs for the target recall. The first ``EARLY`` runs go through the same jobs together, then the others, with
signatures of their own, which skip buckets whose sets are all tied already. What is left at the last level is taken as one candidate group.

Candidates tie sets into groups, by minimum labels with pointer jumping over contracted edges: a set in many stars keeps one
edge, so their number follows that of the sets. Each group is then compared exactly, all
pairs of it, in packs: a pack is some sets compressed into one row, and pairs of packs go to tasks of their own, so a
group of any size is spread, and what leaves a task is a count for each set and a forest of links, never all pairs.

Equal sets are one class member from the start, so copies cost nothing beyond their first.

A set that takes more than a block of a text is made block by block, and its temporaries are striped.

Defined cases: a null text is empty; a text without words is similar to nothing, not even to another one; a text of
fewer than five words is one gram; repeated rows are copies; null ids sort last in the choice of a class id.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, joinable, kept, released, slices, texts

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999999
EARLY = 4
TOKENS = 2.0
LEVELS = 3
SMALL = 64
#: At most 8.4 million pairs of signatures for one bucket, under a second.
WHOLE = 4_096
DRAWS = 32
#: Of 32 draws, each one byte: a pair of similarity 0.8 has fewer than 15 alike 6.3 times in a million, early and late
#: runs independently.
TIED = 15
#: Of the 64 draws of both signatures: a pair of similarity 0.8 has fewer alike 3.2 times in ten million, one of 0.2 has as
#: many 4.4 times in a billion.
TIED_BOTH = 34
#: A set similar to this one has TIED draws in common with the pivot if it has 20 in common with this one (all but 0.6 % at 0.8).
TAKEN = 27
PACK = 64
SUPER = 8
COLUMNS = 4_096
PACK_BYTES = 512 << 10
CONTRACTIONS = 3
BLOCK_CHARS = 1 << 20
BLOCK_WORDS = 1 << 16
STRIPE = 1 << 14
WORD = re.compile(r"\w+")
CACHED = 100_000


def survival(levels: int = LEVELS, tokens: float = TOKENS, similarity: float = SIMILARITY) -> float:
    """Chance that two sets of this similarity still share a node after so many levels of one run."""
    q = 1.0
    for _ in range(levels):
        q = 1 - math.exp(-tokens * similarity * q)
    return q


def runs_for(recall: float = RECALL) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival())))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, base: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(base))


def word_blocks(text: str) -> Iterator[list[str]]:
    """The words of a text, lowered; those of a long text in lists of ``BLOCK_WORDS``."""
    text = text.lower()
    if len(text) <= BLOCK_CHARS:
        yield WORD.findall(text)
        return
    found = WORD.finditer(text)
    while block := [m.group() for m in islice(found, BLOCK_WORDS)]:
        yield block


def gram_set(text: str, seen: dict[str, int], words: int = WORDS) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the word n-grams of a text."""
    parts, before = [], np.empty(0, np.uint64)
    for found in word_blocks(text):
        if len(seen) > CACHED:
            seen.clear()
        for w in set(found):
            if w not in seen:
                raw = w.encode()
                seen[w] = zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x9E3779B9)
        h = np.concatenate([before, mix(np.array([seen[w] for w in found], np.uint64))])
        if len(h) >= words:
            parts.append(folded(h, words))
        before = h[max(0, len(h) - words + 1) :]
    if not parts and before.size:
        parts.append(folded(before, len(before)))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint32)


def folded(h: np.ndarray, words: int) -> np.ndarray:
    """One 32-bit hash of each run of so many words."""
    n = len(h) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = mix(out * np.uint64(0x100000001B3) + h[k : k + n])
    return (out >> np.uint64(32)).astype(np.uint32)


def stripes(grams: np.ndarray) -> Iterator[np.ndarray]:
    return (grams[low : low + STRIPE].astype(np.uint64) for low in range(0, len(grams), STRIPE))


def signatures(grams: np.ndarray) -> tuple[bytes, bytes]:
    """Two signatures, for the early and the late runs: one byte of the least hash of each draw.

    A draw of the one takes the high half of a 64-bit hash, of the other the low half, so the two are independent.
    """
    draws, half = seeds(DRAWS, 11)[None, :], np.uint64(32)
    least = []
    for part in stripes(grams):
        h = mix(part[:, None] ^ draws)
        least.append((h.min(axis=0) >> half, h.astype(np.uint32).min(axis=0).astype(np.uint64)))
    return tuple((np.min([x[k] for x in least], axis=0) & np.uint64(255)).astype(np.uint8).tobytes() for k in (0, 1))


def children(path: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The buckets that a set enters below each of its nodes."""
    if not grams.size or not path.size:
        return np.empty(0, np.int64)
    limit = np.uint64(min(2**64 - 1, int(TOKENS / grams.size * 2.0**64)))
    out = []
    for part in stripes(grams):
        for nodes in np.array_split(path.astype(np.uint64), -(-len(path) * len(part) // (1 << 20))):
            h = mix(part[None, :] ^ nodes[:, None])
            node, token = np.nonzero(h <= limit)
            out.append(mix(h[node, token] + nodes[node]).view(np.int64))
    return np.concatenate(out)


def binary(values) -> pa.Array:
    return pa.array(list(values), pa.binary())


def grams_of(docs: DataFrame, runs: int, words: int) -> DataFrame:
    """uid, doc_id, key of the set, its size, the set, its signatures and first buckets in early and late runs."""
    roots = seeds(runs, 23)

    def build(batches):
        seen: dict[str, int] = {}
        for batch in slices(batches):
            sets = [gram_set(t, seen, words) for t in batch["text"].to_pylist()]
            raw = [s.tobytes() for s in sets]
            both = [signatures(x) if x.size else (b"", b"") for x in sets]
            keys = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_pydict({
                "uid": batch["uid"], "doc_id": batch["doc_id"], "key": binary(keys), "n": pa.array([len(s) for s in sets], pa.int32()),
                "grams": binary(raw), "early_sig": binary(x for x, _ in both), "late_sig": binary(x for _, x in both),
                "early": pa.array([children(roots[:EARLY], s).tolist() for s in sets], pa.list_(pa.int64())),
                "late": pa.array([children(roots[EARLY:], s).tolist() for s in sets], pa.list_(pa.int64())),
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        build, f"uid long, doc_id {kind}, key binary, n int, grams binary, early_sig binary, late_sig binary, early array<long>, late array<long>"
    )


def groups_of(batches, keys: tuple[str, ...]):
    """Runs of rows with equal ``keys`` in a sorted stream, as tables; only one run is held at a time."""
    held = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        cuts = [0, *np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1, batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            key = tuple(int(c[low]) for c in columns)
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(int(low), int(high - low)))
    if held:
        yield last, pa.Table.from_batches(held)


class Forest:
    """Union of a few numbers, by halving paths."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def tie(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def forest_of(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    forest = Forest(n)
    return [(int(a), int(b)) for a, b in zip(left, right, strict=True) if forest.tie(int(a), int(b))]


def edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = ([p[k] for p in pairs] for k in (0, 1))
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def spanning(sig: np.ndarray, n: np.ndarray, tied: int) -> list[tuple[int, int]]:
    """A forest of the sets with so many draws alike: each set is compared with those that none has reached yet."""
    own, draws, sizes, left = np.arange(len(n)), np.ascontiguousarray(sig.T), n, np.ones(len(n), bool)
    out, reached = [], []
    while left.any():
        if not reached:
            first = int(np.argmax(left))
            left[first] = False
            reached.append(int(own[first]))
        k = reached.pop()
        alike = (draws == sig[k][:, None]).view(np.uint8).sum(0, dtype=np.uint8)
        found = np.flatnonzero(left & (alike >= tied) & (np.minimum(sizes, n[k]) >= 0.75 * np.maximum(sizes, n[k])))
        left[found] = False
        reached += own[found].tolist()
        out += [(k, x) for x in own[found].tolist()]
        if 2 * np.count_nonzero(left) < len(left):
            own, draws, sizes, left = own[left], draws[:, left], sizes[left], left[left]
    return out


def buckets(rows: DataFrame) -> DataFrame:
    """Edges a, b between sets of a bucket that may be similar: a forest of each bucket, not its pairs.

    Rows of buckets over ``SMALL`` have their other signature too; it is null in small ones.
    """

    def compare(batches):
        out = []
        for _, table in groups_of(batches, ("path",)):
            if table.num_rows < 2:
                continue
            uid, n = table["uid"].to_numpy(), table["n"].to_numpy().astype(float)
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(uid), DRAWS)
            if len(uid) > SMALL:
                other = np.frombuffer(b"".join(table["other"].to_pylist()), np.uint8).reshape(len(uid), DRAWS)
                forest = spanning(np.hstack([sig, other]), n, TIED_BOTH)
            else:
                alike = (sig[:, None, :] == sig[None, :, :]).sum(2)
                near = (alike >= TIED) & (np.minimum.outer(n, n) >= 0.75 * np.maximum.outer(n, n))
                left, right = np.nonzero(np.triu(near, 1))
                forest = forest_of(left, right, len(uid))
            out += [(int(uid[a]), int(uid[b])) for a, b in forest]
            if len(out) > 5_000:
                yield edge_batch(out)
                out = []
        yield edge_batch(out)

    return rows.repartition("path").sortWithinPartitions("path", "uid").mapInArrow(compare, "a long, b long")


def against_pivot(rows: DataFrame) -> DataFrame:
    """uid, path, n, sig of rows with ``pivot`` and ``first``: ``tied`` and ``taken`` tell how like the first they are."""

    def compare(batches):
        for batch in batches:
            both = [np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, DRAWS) for c in ("sig", "pivot")]
            alike = (both[0] == both[1]).sum(1)
            yield pa.RecordBatch.from_pydict({
                **{c: batch[c] for c in ("path", "uid", "n", "sig", "first")}, "tied": pa.array(alike >= TIED), "taken": pa.array(alike >= TAKEN)
            })

    return rows.mapInArrow(compare, "path long, uid long, n int, sig binary, first long, tied boolean, taken boolean")


def below(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The next level of rows that are in large buckets: a set is fetched once for all its nodes."""

    def choose(batches):
        for batch in slices(batches):
            paths, uid = [], []
            for k, nodes in enumerate(batch["nodes"].to_pylist()):
                found = children(np.array(nodes, np.int64).view(np.uint64), np.frombuffer(batch["grams"][k].as_buffer(), np.uint32))
                paths.append(found)
                uid += [batch["uid"][k].as_py()] * len(found)
            yield pa.RecordBatch.from_pydict({
                "path": pa.array(np.concatenate(paths) if paths else [], pa.int64()), "uid": pa.array(uid, pa.int64()),
            })

    nodes = kept(rows.groupBy("uid").agg(F.collect_set("path").alias("nodes")), "jaccard-nodes")
    return sets.select("uid", "grams").join(joinable(nodes), "uid").mapInArrow(choose, "path long, uid long")


def level_of(rows: DataFrame, light: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Edges among buckets of one level, and the rows that go on below, of which the last level has none.

    ``rows`` has path, uid and comp, ``light`` uid, n, sig and other of all sets. Buckets of one set, or of sets that are all tied
    already, are done; the counts of the others decide which rows are fetched at all.
    """
    counts = kept(
        rows.groupBy("path").agg(F.count("*").alias("m"), F.min("uid").alias("first"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
        .where("m > 1 AND c0 != c1").select("path", "m", "first"), "jaccard-counts",
    )
    open_rows = rows.select("path", "uid").join(joinable(counts), "path")
    other = F.when(F.col("m") > SMALL, F.col("other")).alias("other")
    close = buckets(open_rows.where(F.col("m") <= WHOLE).join(light, "uid").select("path", "uid", "n", "sig", other))
    large = open_rows.where(F.col("m") > WHOLE)
    if last:
        whole = large.where("uid != first").select(F.col("uid").alias("a"), F.col("first").alias("b"))
        return kept(close.unionByName(whole.distinct()), "jaccard-found"), None
    firsts = kept(
        counts.where(F.col("m") > WHOLE).select(F.col("first").alias("uid")).distinct().join(light, "uid")
        .select(F.col("uid").alias("first"), F.col("sig").alias("pivot")), "jaccard-pivots",
    )
    large = large.select("path", "uid", "first").join(light.drop("other"), "uid").join(joinable(firsts), "first")
    judged = kept(against_pivot(large.select("path", "uid", "n", "sig", "first", "pivot")), "jaccard-judged")
    tied = judged.where("tied AND uid != first").select(F.col("uid").alias("a"), F.col("first").alias("b")).distinct()
    return kept(close.unionByName(tied), "jaccard-found"), judged.where("NOT taken")


def candidates(members: DataFrame, sets: DataFrame, paths: str, comps: DataFrame | None) -> DataFrame:
    """Edges a, b that tie sets which may be similar and are not tied by ``comps`` yet."""
    known = F.col("uid").alias("comp")
    if comps is not None:
        members = members.join(joinable(comps.withColumnRenamed("node", "uid")), "uid", "left")
        known = F.coalesce("comp", "uid").alias("comp")
    own = members.select("uid", known)
    light = members.select("uid", "n", F.col(f"{paths}_sig").alias("sig"), F.col("late_sig" if paths == "early" else "early_sig").alias("other"))
    rows = members.select(F.explode(paths).alias("path"), "uid", known)
    found = []
    for level in range(LEVELS):
        edges, left = level_of(rows, light, level + 1 == LEVELS)
        found.append(edges)
        if left is None or left.isEmpty():
            break
        lower = kept(below(left, sets), "jaccard-level")
        rows = lower.join(joinable(own), "uid") if comps is not None else lower.withColumn("comp", F.col("uid"))
    return reduce(DataFrame.unionByName, found)


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges a > b with the same components: each node and its lesser neighbours are tied to the least of these.

    A node in many stars keeps one edge of its own, and the stars' centres are tied to each other.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    ordered = edges.where("a != b").select(high.alias("a"), low.alias("b")).distinct()
    least = ordered.withColumn("least", F.min("b").over(Window.partitionBy("a")))
    tied = least.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return tied.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the least node of its component, for all nodes of the edges."""
    for _ in range(CONTRACTIONS):
        edges = kept(contracted(edges), "jaccard-edges")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("comp")), "jaccard-labels")
    while not labels.isEmpty():
        side = joinable(labels.select(F.col("node").alias("b"), F.col("comp").alias("theirs")))
        least = both.join(side, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        lower = labels.join(least, "node").select("node", "comp", F.least("comp", "theirs").alias("new"))
        lower = kept(lower, "jaccard-lower")
        jump = joinable(lower.select(F.col("node").alias("new"), F.col("new").alias("next")))
        moved = kept(lower.join(jump, "new").select("node", F.col("comp").alias("old"), F.least("new", "next").alias("comp")), "jaccard-moved")
        released(labels, lower)
        labels = moved
        if moved.where("old != comp").isEmpty():
            break
    return labels.select("node", "comp")


def pack(rows: DataFrame) -> DataFrame:
    """Rows of (comp, pack, blob): the uid, copies and set of up to about PACK members, compressed together."""

    def build(batches):
        tool = zstandard.ZstdCompressor(level=1)
        for (comp, number, supers), table in groups_of(batches, ("comp", "pack", "supers")):
            data = table.select(["uid", "copies", "grams"]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, data.schema) as stream:
                stream.write_table(data)
            yield pa.RecordBatch.from_pydict({
                "comp": pa.array([comp], pa.int64()), "pack": pa.array([number], pa.int64()), "supers": pa.array([supers], pa.int64()),
                "blob": binary([tool.compress(sink.getvalue().to_pybytes())]),
            })

    return rows.repartition("comp", "pack").sortWithinPartitions("comp", "pack", "uid").mapInArrow(build, "comp long, pack long, supers long, blob binary")


def unpack(blobs: list[bytes]):
    tool = zstandard.ZstdDecompressor()
    tables = [pa.ipc.open_stream(tool.decompress(b)).read_all() for b in blobs]
    uid = np.concatenate([t["uid"].to_numpy() for t in tables])
    copies = np.concatenate([t["copies"].to_numpy() for t in tables])
    return uid, copies, [np.frombuffer(g, np.uint32) for t in tables for g in t["grams"].to_pylist()]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of incidence matrices over stripes of the vocabulary."""
    sets = left + right
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    words, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(words), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(shared), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        dense = np.zeros((len(sets), min(COLUMNS, len(shared) - low)), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def exact(packs: DataFrame, similarity: float) -> DataFrame:
    """uid, links (rows similar to it in other classes) and ``other``, a set tied to it by a link or null."""
    last = F.col("supers") - 1
    own = F.floor(F.col("pack") / SUPER).cast("long")
    cells = packs.select(
        "comp", "pack", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"), "blob"
    ).select(
        "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own"), "pack", "blob"
    )

    def compare(batches):
        for (_, i, j), table in groups_of(batches, ("comp", "i", "j")):
            sides = []
            for side in dict.fromkeys((i, j)):
                blobs = [b for b, s in zip(table["blob"].to_pylist(), table["own"].to_pylist(), strict=True) if s == side]
                if blobs:
                    sides.append(unpack(blobs))
            if not sides or (i != j and len(sides) < 2):
                continue
            (uid_a, copies_a, a), (uid_b, copies_b, b) = sides[0], sides[-1]
            size_a, size_b = (np.array([len(s) for s in x], float) for x in (a, b))
            inter = overlaps(a, b)
            # written without a division, so a pair on the threshold counts whatever its sizes
            link = inter >= similarity / (1 + similarity) * np.add.outer(size_a, size_b) - 1e-3
            if i == j:
                np.fill_diagonal(link, False)
            left, right = np.nonzero(link)
            offset = 0 if i == j else len(a)
            out_uid, out_links, out_other = list(uid_a), list((link * copies_b[None, :]).sum(1)), [None] * len(a)
            if i != j:
                out_uid += list(uid_b)
                out_links += list((link * copies_a[:, None]).sum(0))
                out_other += [None] * len(b)
            everyone = np.concatenate([uid_a, uid_b]) if i != j else uid_a
            for x, y in forest_of(left, right + offset, len(everyone)):
                out_uid.append(everyone[x])
                out_links.append(0)
                out_other.append(int(everyone[y]))
            yield pa.RecordBatch.from_pydict({
                "uid": pa.array([int(u) for u in out_uid], pa.int64()), "links": pa.array([int(x) for x in out_links], pa.int64()),
                "other": pa.array(out_other, pa.int64()),
            })

    spread = cells.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "pack")
    return spread.mapInArrow(compare, "uid long, links long, other long")


def classes(rows: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """uid, doc_id, class (uid of its first row), class_id (least doc_id of the class), n_links and n_copies.

    ``rows`` has uid, doc_id and text, with uids that stay the same when it is read again. The runs, ``TIED``, ``TAKEN``
    and the size filter are made for ``SIMILARITY``; pairs below it would be lost, so lower values are refused.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"similarity has to be at least {SIMILARITY}, not {similarity}")
    sets = kept(grams_of(rows, runs_for(recall), words), "jaccard-sets")
    full = sets.where("n > 0")
    equal = kept(full.groupBy("key").agg(F.min("uid").alias("member"), F.count("*").alias("copies")), "jaccard-equal")
    members = kept(
        full.select("uid", "key", "n", "early_sig", "late_sig", "early", "late").join(equal.select("key", F.col("member").alias("uid"), "copies"), ["key", "uid"]),
        "jaccard-members",
    )
    # what the early runs tie is one node to the late ones, which skip buckets within it
    tied = candidates(members, full, "early", None)
    comps = components(tied)
    if runs_for(recall) > EARLY:
        comps = components(tied.unionByName(candidates(members, full, "late", comps)))
    # one row a component with more than one pack of members or bytes
    placed = comps.join(members.select(F.col("uid").alias("node"), "n", "copies"), "node")
    sizes = placed.groupBy("comp").agg(F.greatest(F.count("*") / PACK, F.sum("n") * 4 / PACK_BYTES).alias("m"))
    known = kept(sizes.select("comp", F.ceil("m").cast("long").alias("packs")).where("packs > 1"), "jaccard-sizes")
    placed = kept(placed.join(joinable(known), "comp", "left").select(
        F.col("node").alias("uid"), "copies", "comp", F.coalesce(F.pmod(F.xxhash64("node"), F.col("packs")), F.lit(0).cast("long")).alias("pack"),
        F.coalesce(F.ceil(F.col("packs") / SUPER), F.lit(1)).cast("long").alias("supers"),
    ), "jaccard-placed")
    whole = full.select("uid", "grams").join(joinable(placed), "uid")
    found = kept(exact(pack(whole), similarity), "jaccard-links")
    final = components(found.where("other IS NOT NULL").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    owned = members.select("uid", "key", "copies").join(counts, "uid", "left").join(final.withColumnRenamed("node", "uid"), "uid", "left").select(
        "key", F.coalesce("comp", "uid").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies"
    )
    light = sets.select("uid", "doc_id", "key", "n")
    # rows of one key share one small row of results; the aggregation below the join keeps copies out of one task
    table = kept(owned, "jaccard-classes")
    joined = light.join(joinable(table), "key", "left").select(
        "uid", "doc_id", F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("uid")).alias("class"),
        F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n") > 0, F.col("copies")).otherwise(F.lit(1)).cast("long").alias("n_copies"),
    )
    joined = kept(joined, "jaccard-rows")
    least = joined.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.min_by("uid", F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("keeper"))
    least = kept(least, "jaccard-least")
    released(sets, equal, members, placed, found, table)
    return joined.join(joinable(least), "class")


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a uid, written so that it stays the same."""
    return kept(docs.withColumn("uid", F.monotonically_increasing_id()), "jaccard-docs")


def join(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every row."""
    rows = texts(docs).withColumn("uid", F.monotonically_increasing_id())
    return classes(rows, similarity, words, recall).select("doc_id", "class_id", "n_links", "n_copies")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class, that of the least doc_id, whole and with its own columns."""
    rows = numbered(docs.select(F.struct("*").alias(ROW)))
    found = classes(rows.select("uid", F.col(ROW)["doc_id"].alias("doc_id"), F.coalesce(F.col(ROW)["text"], F.lit("")).alias("text")))
    drop = kept(found.where("uid != keeper").select("uid"), "jaccard-drop")
    return rows.join(joinable(drop), "uid", "left_anti").select(f"{ROW}.*")
