"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The last term is the sum of all pairwise interactions <v_i, v_j> x_i x_j, got in time linear in the features.
The fit uses at most ``max_rows`` labelled documents, those with the smallest hash of their id; their features, a
few hundred numbers each, go to the driver, never their texts. Scoring is a map over the documents.

Defined cases: a null text is empty; an empty text has all statistics zero and gets the score of that point;
repeated rows get a score each; without labelled rows, or with labels of one kind, the score is the smoothed share
of label 1; of labels that contradict each other for a document the lowest counts, null labels count as none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, slices, texts

BUCKETS = 1 << 14
RANK = 8
EPOCHS = 12
BATCH = 256
RATE = 0.05
SHRINK = 1e-5
MAX_ROWS = 8_000
CACHED_WORDS = 100_000

#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence marks, 6 symbols, 7 beyond ASCII.
CLASSES = np.zeros(256, np.uint8)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58] = 1, 2, 3
CLASSES[[9, 10, 11, 12, 13, 32]] = 4
CLASSES[[ord(c) for c in ".,;:'\"()-?"]] = 5
CLASSES[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
CLASSES[128:] = 7
EDGES = re.compile(r"^\W+|\W+$")
STATS = 16


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure of a text, each number between 0 and about 1."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not raw.size:
        return [0.0] * STATS
    by = np.bincount(CLASSES[raw], minlength=8) / raw.size
    lines = text.split("\n")
    n = max(1, len(words))
    top = max(counts.values(), default=0) / n
    twice = sum(map(str.__eq__, words, words[1:])) / n
    capitals = sum(w.isupper() and len(w) > 1 for w in counts) / max(1, len(counts))
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:)" for w in counts) / max(1, len(counts))
    repeated = 1 - len(set(lines)) / len(lines)
    return [
        1.0, *by[1:8], min(1.0, raw.size / n / 20), len(counts) / n, top, twice, capitals, marked, repeated,
        np.log1p(raw.size) / 15,
    ]


def features(text: str, seen: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text: hashed words, of unit length together, then the statistics."""
    words = text.split()
    counts = Counter(words)
    at: dict[int, int] = {}
    for word, n in counts.items():
        k = seen.get(word)
        if k is None:
            if len(seen) >= CACHED_WORDS:
                seen.clear()
            bare = EDGES.sub("", word).lower() or word
            k = seen[word] = zlib.crc32(bare.encode()) % BUCKETS
        at[k] = at.get(k, 0) + n
    index = np.fromiter(at, np.int32, len(at))
    value = np.log1p(np.fromiter(at.values(), np.float32, len(at)))
    if value.size:
        value /= np.sqrt((value * value).sum())
    stats = np.array(statistics(text, words, counts), np.float32)
    return (
        np.concatenate([index, np.arange(BUCKETS, BUCKETS + STATS, dtype=np.int32)]),
        np.concatenate([value, stats]).astype(np.float32),
    )


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.factor[index] * value[:, None]
        total = vx.sum(0)
        return float(self.bias + self.weight[index] @ value + 0.5 * (total @ total - (vx * vx).sum()))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Machine:
    """Adaptive gradient descent on log loss in small batches; ``rows`` hold indices, values and label."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + STATS
    ones = sum(y for *_, y in rows)
    bias = float(np.log((ones + 0.5) / (len(rows) - ones + 0.5)))
    model = Machine(bias, np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    if ones in (0, len(rows)):
        model.factor[:] = 0
        return model
    bias_seen, weight_seen, factor_seen = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for low in range(0, len(rows), BATCH):
            batch = [rows[k] for k in order[low : low + BATCH]]
            cut = np.cumsum([0] + [len(i) for i, *_ in batch])
            index = np.concatenate([i for i, *_ in batch])
            value = np.concatenate([v for _, v, _ in batch]).astype(np.float64)
            y = np.array([t for *_, t in batch], float)
            vx = model.factor[index] * value[:, None]
            total = np.add.reduceat(vx, cut[:-1], axis=0)
            margin = (
                model.bias + np.add.reduceat(model.weight[index] * value, cut[:-1])
                + 0.5 * ((total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), cut[:-1]))
            )
            slope = (sigmoid(margin) - y) / len(batch)
            each = np.repeat(slope, np.diff(cut)) * value
            used, place = np.unique(index, return_inverse=True)
            g_weight = np.bincount(place, each) + SHRINK * model.weight[used]
            pull = each[:, None] * (np.repeat(total, np.diff(cut), axis=0) - vx)
            g_factor = np.stack([np.bincount(place, pull[:, f]) for f in range(RANK)], 1) + SHRINK * model.factor[used]
            g_bias = slope.sum()
            bias_seen += g_bias**2
            weight_seen[used] += g_weight**2
            factor_seen[used] += g_factor**2
            model.bias -= RATE * g_bias / np.sqrt(bias_seen)
            model.weight[used] -= RATE * g_weight / np.sqrt(weight_seen[used])
            model.factor[used] -= RATE * g_factor / np.sqrt(factor_seen[used])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Machine:
    """Fit on the labelled documents with the smallest id hashes; ``labels`` is already free of held-out rows."""
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )

    def to_features(batches):
        seen: dict[str, int] = {}
        for batch in slices(batches):
            both = [features(t, seen) for t in batch["text"].to_pylist()]
            index, value = [i.tobytes() for i, _ in both], [v.tobytes() for _, v in both]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "y": batch["y"], "index": pa.array(index, pa.binary()),
                "value": pa.array(value, pa.binary()),
            })

    found = (
        texts(docs).join(F.broadcast(picked), "doc_id").select(F.col("doc_id").cast("string"), "y", "text")
        .mapInArrow(to_features, "doc_id string, y int, index binary, value binary")
    ).collect()
    found.sort(key=lambda r: (r["doc_id"], r["index"], r["value"]))
    return fit_machine([
        (np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32), int(r["y"] > 0)) for r in found
    ])


def scores(df: DataFrame, model: Machine, carry: str, schema: str) -> DataFrame:
    """``carry`` columns and the score of each row's ``text``."""
    names = [c.strip() for c in carry.split(",") if c.strip()]
    bias, weight, factor = model.bias, model.weight.astype(np.float32), model.factor.astype(np.float32)

    def score(batches):
        seen: dict[str, int] = {}
        own = Machine(bias, weight, factor)
        for batch in slices(batches):
            got = [float(sigmoid(own.margin(*features(t, seen)))) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({name: batch[name] for name in names} | {"score": pa.array(got, pa.float64())})

    return df.mapInArrow(score, schema)


def score_documents(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id, score between 0 and 1, predicted 0 or 1."""
    out = scores(texts(docs), model, "doc_id", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, whole and with their own columns; only texts go to Python."""
    model = train(docs, training_labels(labels))
    own = Machine(model.bias, model.weight.astype(np.float32), model.factor.astype(np.float32))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: dict[str, int] = {}
        for part in slices(batches):
            yield pa.array([float(sigmoid(own.margin(*features(t, seen)))) for t in part.to_pylist()], pa.float64())

    return docs.where(score(F.coalesce(docs["text"], F.lit(""))) >= 0.5)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the fold that is held out: crc32 of the id as text, modulo 3, is not 1."""
    return labels.where(id_crc(F.col("doc_id")) % 3 != 1)
