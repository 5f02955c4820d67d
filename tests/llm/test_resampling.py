"""Importance resampling against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from veilspark.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text):
    words = WORD.findall(low(text))
    runs = [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(docs, target, percent=5, min_words=20):
    raw = collections.Counter(b for _, t in docs for b in features(t)[1])
    aim = collections.Counter(b for t in target for b in features(t)[1])
    big, small = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (big + 10_000) / ((raw[b] + 1) * (small + 10_000)))) for b in raw}
    out = []
    for doc_id, text in docs:
        n, buckets = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        out.append([doc_id, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return collections.Counter((*r[:4], rank.get(id(r))) for r in out)


def rows_of(frame):
    return collections.Counter(tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect())


def some(seed, n):
    rng = random.Random(seed)
    return rng.choice([" ", ", ", "\n", " - "]).join(rng.choice(["Alpha", "beta", "é42", "\U0001f600x", "the", "KK", "ZETA9"]) for _ in range(n))


DOCS = [(k, some(k, k % 47)) for k in range(300)] + [
    (None, some(3, 30)), (None, None), (5, some(5, 5)), (900, ""), (901, " \t.!"), (902, "x" * 5000), (903, some(9, 30_000)), (904, None),
]
TARGET = [some(1000 + k, 20) for k in range(9)] + [None, ""]


def test_resampling_equals_plain_python(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS score", "'p' AS place", "2 AS part", "3 AS rank").repartition(5)
    target = spark.createDataFrame([(str(k), t) for k, t in enumerate(TARGET)], "item_id string, text string")
    got = resampling.resample(docs, target, percent=40)
    want = brute(DOCS, TARGET, percent=40)
    assert rows_of(got) == want and sum(r[4] is not None for r in want) > 50


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some_docs = spark.createDataFrame(DOCS[:60], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    assert rows_of(resampling.resample(some_docs, none)) == brute(DOCS[:60], [])


def test_resampling_takes_ids_of_any_kind_and_repeats(spark):
    docs = spark.createDataFrame([(f"d{k % 7}", some(1, 40)) for k in range(40)], "doc_id string, text string")
    got = resampling.resample(docs, docs, percent=50).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, 21))
    drawn, left = [r for r in got if r["rank"]], [r for r in got if not r["rank"]]
    assert min(r["score"] for r in drawn) >= max(r["score"] for r in left)


@pytest.mark.parametrize("size", [1, 7, 64])
def test_blocks_change_nothing(monkeypatch, size):
    text = some(77, 300) + " " + "y" * 200 + " " + some(78, 40)
    monkeypatch.setattr(resampling, "blocks", lambda data: original(data, size))
    n_words, buckets = 0, []
    for n, b in resampling.bucket_blocks(text, resampling.splitter()):
        n_words += n
        buckets += b.tolist()
    want = features(text)
    assert (n_words, sorted(buckets)) == (want[0], sorted(want[1]))


original = resampling.blocks
