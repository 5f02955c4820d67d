"""Importance resampling towards a target distribution, on hashed word n-grams.

An untrained pre-tokenizer of the tokenizers library, one Split by a regular expression over text in which A-Z are
lowered, returns the words with their offsets. The words are laid out with one space between them, and runs of one to
three words are windows of that buffer, given by a start and an end offset; a window that ends one word later continues
the crc32 of the shorter one. The crc modulo ``BUCKETS`` is the feature's bucket. Splitting takes by far the most time, so
it is done once and the buckets are written, two bytes a feature. One pass over them sums the buckets of all documents and
one those of the target; their smoothed log ratio is the gain of a bucket. Another pass sums the gains of each document.
Weights with Gumbel noise, drawn from a hash of the id, are ranked, and the highest are drawn: a sample without replacement
that is more likely to hold what looks like the target.

Between tasks go at most ``BUCKETS`` counts of each task, later a few numbers of each document. Texts stay where they are
read. A text is worked on in blocks of ``BLOCK`` bytes, cut between words, so a task's memory doesn't grow with it.

Defined cases: a null text and one without words have no features and weight 0; a null id takes part with the noise of
the empty id; repeated rows have a row each and may all be drawn; equal scores go to the smaller id, null first; an
empty target gives every bucket the gain of its smoothing alone; of an empty table nothing is drawn. Other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from .common import kept, released, slices, texts
from .ranks import ranked

BUCKETS = 10_000
GRAMS = 3
SEED = 42
MIN_WORDS = 20
PERCENT = 5
BLOCK = 1 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def splitter() -> Split:
    return Split(Regex(SEPARATORS), behavior="removed")


def blocks(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """Parts of a text of about this size; none ends within a word."""
    low = 0
    while len(data) - low > size:
        cut = SEPARATOR.search(data, low + size)
        if not cut:
            break
        yield data[low : cut.start()]
        low = cut.start()
    yield data[low:]


def window_crcs(words: list[tuple[str, tuple[int, int]]], carried: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """crc32 of all windows that end in these words, by length, and the words that the next block's windows begin with.

    Each character of the words stands for one byte.
    """
    skip = len(carried)
    buffer = b" ".join([*carried, " ".join([w for w, _ in words]).encode("latin-1")])
    ends = list(accumulate([*map(len, carried), *[high - low for _, (low, high) in words]], lambda end, n: end + 1 + n))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    crcs = [crc32(buffer[a:b]) for a, b in zip(starts, ends, strict=True)]
    # a window that ends one word later goes on from the crc of the shorter one
    steps = [buffer[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    found = [np.array(crcs[skip:], np.uint32)]
    for longer in range(1, GRAMS):
        crcs = [*map(crc32, steps[longer - 1 :], crcs)]
        found.append(np.array(crcs[max(skip - longer, 0) :], np.uint32))
    return found, [buffer[a:b] for a, b in zip(starts[1 - GRAMS :], ends[1 - GRAMS :], strict=True)]


def bucket_blocks(text: str, split: Split) -> Iterator[tuple[int, np.ndarray]]:
    """Word count and feature buckets of each block of a text."""
    carried: list[bytes] = []
    # bytes.lower changes A-Z alone; read as Latin-1, a byte is a character, so that offsets count bytes
    for block in blocks(text.encode().lower()):
        words = split.pre_tokenize_str(block.decode("latin-1"))
        if words:
            found, carried = window_crcs(words, carried)
            yield len(words), (np.concatenate(found) % np.uint32(BUCKETS)).astype(np.uint16)


def bucketed(rows: DataFrame, what: str) -> DataFrame:
    """doc_id, n_words and the buckets of all features of every row, two bytes each, written: the only pass over words."""

    def run(batches):
        split = splitter()
        for batch in slices(batches):
            counts, found = [], []
            for text in batch["text"].to_pylist():
                each = [*bucket_blocks(text, split)]
                counts.append(sum(n for n, _ in each))
                found.append(b"".join(b.tobytes() for _, b in each))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_words", "buckets"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return kept(rows.mapInArrow(run, f"doc_id {kind}, n_words long, buckets binary"), what)


def unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (np.frombuffer(b.as_buffer(), np.uint16) for b in batch["buckets"])


def histogram(features: DataFrame) -> np.ndarray:
    """Features in each bucket over all texts: each task adds up its own, so BUCKETS rows a task are shuffled at most."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for buckets in unpacked(batch):
                total += np.bincount(buckets, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int32()), "n": pa.array(total[held], pa.int64())})

    counted = features.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in counted.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    all_raw, all_target = int(raw.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((float(t) + 1) * (all_raw + BUCKETS) / ((float(s) + 1) * (all_target + BUCKETS))))
        for s, t in zip(raw.tolist(), target.tolist(), strict=True)
    ], np.int64)


def weighed(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""

    def score(batches):
        for batch in batches:
            both = np.array([(len(b), gains[b].sum()) for b in unpacked(batch)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_words"], pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "n_words", "n_features", "weight"]
            )

    kind = features.schema["doc_id"].dataType.simpleString()
    return features.mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, min_words: int = MIN_WORDS
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; rank is null where it isn't drawn."""
    features = bucketed(texts(docs), "resampling-features")
    aim = bucketed(target.select(F.lit(0).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "resampling-target")
    found = weighed(features, gains_of(histogram(features), histogram(aim)))
    drawn = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(drawn, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = kept(found.withColumn("score", F.col("weight") + noise), "resampling-scores")
    released(features, aim)
    fit = F.col("n_words") >= min_words
    wanted = percent * scored.where(fit).count() // 100
    placed = ranked(scored, [F.when(fit, 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc()], "resampling-ranks")
    rank = F.when(F.col("position") <= wanted, F.col("position"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
