"""BPE encoding and decoding by tree concatenation.

A text longer than ``LEAF`` characters is halved until the pieces are short. The pieces are encoded by different
tasks, wherever the cuts fall. Neighbours are then joined in pairs, level by level: the tokens around a join are
re-encoded from their text, in a window that doubles until its first tokens agree with the left side's and its last
tokens with the right side's. A window that spans both sides is a plain encoding, so the walk always ends.

Why agreement is enough: pre-tokenization reads left to right without memory, so it is in step from the first
boundary that both sides share; and within one very long piece a sequence of tokens is the BPE encoding exactly if
each pair of neighbours is, and each pair lies in the left side, the window or the right side.

Only texts of more than one piece are shuffled, by document; all others are encoded where they are read.

Defined cases: a null text is empty; an empty text has no tokens; repeated rows give a row each; the text of a
special token is encoded as that token, as the library does.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD, slices, texts
from .tokens import Encoder, Numbers, byte_table

LEAF = 1 << 15
WINDOW = 32
CACHED = 250_000
OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Part:
    """A text, its bytes and its ids, with the byte at which each token ends."""

    def __init__(self, raw: bytes, ids: np.ndarray, ends: np.ndarray):
        self.raw, self.ids, self.ends = raw, ids, ends


class Tree:
    def __init__(self, path: str):
        self.encoder = Encoder(path, "space", CACHED)
        self.table = byte_table(self.encoder.library)
        self.numbers = Numbers(len(self.table))
        self.lengths = np.array([len(b) for b in self.table], np.int64)
        self.window = max(WINDOW, 2 * self.encoder.longest_added)

    def part(self, text: str, ids: np.ndarray | None = None) -> Part:
        ids = self.encoder.encode(text) if ids is None else ids
        return Part(text.encode(), ids, np.cumsum(self.lengths[ids]))

    def join(self, left: Part, right: Part) -> Part:
        raw = left.raw + right.raw
        if not left.raw or not right.raw:
            return left if left.raw else right
        reach = self.window
        while True:
            low, high = max(0, len(left.ids) - reach), min(len(right.ids), reach)
            while low > 0 and inside(left.raw, left.ends[low - 1]):
                low -= 1
            while high < len(right.ids) and inside(right.raw, right.ends[high - 1]):
                high += 1
            first = int(left.ends[low - 1]) if low else 0
            last = int(right.ends[high - 1])
            ids = self.encoder.whole((left.raw[first:] + right.raw[:last]).decode())
            guard = min(4, len(ids))
            same_left = low == 0 or np.array_equal(ids[:guard], left.ids[low : low + guard])
            same_right = high == len(right.ids) or np.array_equal(ids[-guard:], right.ids[max(0, high - guard) : high])
            if same_left and same_right:
                out = np.concatenate([left.ids[:low], ids, right.ids[high:]])
                return Part(raw, out, np.cumsum(self.lengths[out]))
            reach *= 2

    def grow(self, parts: list[Part]) -> Part:
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        """The whole of a text in one task."""
        return self.grow([self.part(text[k : k + leaf]) for k in range(0, max(1, len(text)), leaf)]).ids

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def digests(self, ids: np.ndarray) -> tuple[int, str, str]:
        back = self.decode(ids).encode()
        return len(ids), hashlib.sha256(self.numbers.joined(ids)).hexdigest(), hashlib.sha256(back).hexdigest()


@lru_cache(maxsize=2)
def tree_of(path: str) -> Tree:
    """One for each worker process: reading the vocabulary takes longer than encoding most documents."""
    return Tree(path)


def held(path: str) -> Tree:
    """The same in a task, until a task of another operator begins in this worker."""
    HELD["bpe"] = tree_of.cache_clear
    return tree_of(path)


def inside(raw: bytes, at: int) -> bool:
    """Whether a cut before byte ``at`` splits a character."""
    return at < len(raw) and raw[at] & 0xC0 == 0x80


def columns(rows: list[tuple]) -> dict[str, pa.Array]:
    n, ids, back = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
    return {
        "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(back, pa.string())
    }


def encode_documents(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, number of tokens and the digests of ids and of the decoded text."""
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def short(batches):
        tree = held(path)
        for batch in slices(batches, owner="bpe"):
            got = [tree.digests(tree.part(t).ids) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"]} | columns(got))

    def leaves(batches):
        tree = held(path)
        for batch in slices(batches, owner="bpe"):
            ids = [tree.encoder.encode(t).tobytes() for t in batch["piece"].to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {name: batch[name] for name in ("doc_id", "row", "leaf", "piece")} | {"ids": pa.array(ids, pa.binary())}
            )

    def together(key, table):
        tree = held(path)
        table = table.sort_by("leaf")
        parts = [
            tree.part(t, np.frombuffer(i, tree.encoder.type))
            for t, i in zip(table["piece"].to_pylist(), table["ids"].to_pylist(), strict=True)
        ]
        return pa.table({"doc_id": table["doc_id"][:1]} | columns([tree.digests(tree.grow(parts).ids)]))

    long = rows.where(F.length("text") > leaf)
    pieces = long.withColumn("row", F.monotonically_increasing_id()).select(
        "doc_id", "row", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % leaf), F.lit(0))).alias("leaf", "piece")
    )
    spread = pieces.repartition("row", "leaf")
    encoded = spread.mapInArrow(leaves, f"doc_id {kind}, row long, leaf int, piece string, ids binary")
    joined = encoded.groupBy("row").applyInArrow(together, f"doc_id {kind}, {OUT}")
    return rows.where(F.length("text") <= leaf).mapInArrow(short, f"doc_id {kind}, {OUT}").unionByName(joined)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids themselves, for use by other jobs."""
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tree = held(path)
        for batch in slices(batches, owner="bpe"):
            ids = [tree.encode(t).tolist() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "ids": pa.array(ids, pa.list_(pa.int32()))})

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")
