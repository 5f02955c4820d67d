"""Cube-method mixing against plain targets, sums and bounds."""

import collections
import random
import re

import pytest

from veilspark.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(docs, weights=(3, 1, 2), share=1.5, cap=2):
    sizes = collections.Counter()
    for _, text, source in docs:
        sizes[source] += size(text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        above = {s for s in names if s not in full and rest * weight[s] / free > cap * sizes[s]}
        if not above:
            return {s: (sizes[s], cap * sizes[s] if s in full else rest * weight[s] / free) for s in names}
        full |= above


def checked(got, docs, block):
    """Every rule of the mix; two documents of the source may be missing or too many."""
    targets = plain_targets(docs)
    want = collections.Counter((i, s, size(t)) for i, t, s in docs)
    assert collections.Counter((r["doc_id"], r["source"], r["size"]) for r in got) == want
    taken, largest, times = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for r in got:
        source_size, target = targets[r["source"]]
        assert r["source_size"] == source_size and r["target"] == pytest.approx(target)
        assert r["taken"] == r["size"] * r["times"] <= 2 * r["size"]
        ratio = target / source_size if source_size else 0
        assert abs(r["times"] - ratio) < 1 + 1e-6
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        times[r["source"]].append(r["times"])
    for s, (source_size, target) in targets.items():
        assert abs(taken[s] - target) <= 2 * largest[s]
        ratio = target / source_size if source_size else 0
        assert abs(sum(times[s]) - ratio * len(times[s])) <= 2.001
    return taken, targets


def words(rng, n):
    return rng.choice([" ", "\t", "\n ", " x "]).join(["w"] * n)


def corpus(seed, n):
    rng = random.Random(seed)
    names = ["hot"] * 12 + ["b", "a", "é", "\U0001f600", "Z", None]
    return [(k, words(rng, rng.choice([1, 3, 40, 200])), rng.choice(names)) for k in range(n)]


@pytest.mark.parametrize("block", [20_000, 8])
def test_mix_balances_words_and_documents(spark, block):
    docs = corpus(1, 900) + [(None, "null id", "a"), (None, None, "a"), (7, "", "b"), (7, "same id", "b"), (7, "same id", "b"), (8, words(random.Random(2), 9000), "a")]
    docs += [(9, None, "empty"), (10, "", "empty")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS place", "2 AS block", "'x' AS name", "3 AS target")
    got = [r.asDict() for r in mixing.mix(frame.repartition(4), block=block).collect()]
    taken, targets = checked(got, docs, block)
    again = [r.asDict() for r in mixing.mix(frame.repartition(7), block=block).collect()]
    order = lambda rows: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows)
    assert order(got) == order(again)


def test_excess_is_shared_again(spark):
    docs = [(k, words(random.Random(k), n), s) for k, (s, n) in enumerate([("a", 5), ("b", 400), ("c", 10), ("d", 90), ("e", 80), ("f", 70)] * 20)]
    got = [r.asDict() for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()]
    taken, targets = checked(got, docs, 20_000)
    assert taken["a"] == 2 * targets["a"][0] and taken["c"] == 2 * targets["c"][0]
    assert sum(t for _, t in targets.values()) == pytest.approx(1.5 * sum(s for s, _ in targets.values()))


def test_mix_of_nothing_and_of_ids_of_any_kind(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    docs = [(f"d{k}", words(random.Random(k), 3), None) for k in range(9)]
    got = [r.asDict() for r in mixing.mix(spark.createDataFrame(docs, "doc_id string, text string, source string")).collect()]
    checked(got, docs, 20_000)


def test_chances_are_kept_on_average():
    totals = collections.Counter()
    for seed in range(4000):
        flight, found = mixing.Flight(f"s{seed}"), []
        for k, s in enumerate([3, 9, 9, 14, 2, 30, 5]):
            found += flight.add(k, s, 0.3)
        left = {u[0]: u[2] for u in flight.open}
        for k, bit in found:
            totals[k] += bit
        for k, chance in left.items():
            totals[k] += chance
    assert all(abs(totals[k] / 4000 - 0.3) < 0.03 for k in range(7))
