"""Collocations against plain counts."""

import collections
import random
import re

import pytest

from veilspark.llm import phrases


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, least=10, covered=50, top=2000):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in docs:
        for piece in re.split("[.,;:!?\n-\r]", low(text)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for k in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        able = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        hidden = {q for p, a in able.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= covered * f[q]}
        rated = []
        for p, a in able.items():
            if p not in hidden:
                score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), left, right))
        for k, (score, a, phrase, left, right) in enumerate(sorted(rated)[:top]):
            out.add((lang, k + 1, phrase.decode(), -a, left, right, n, -score))
    return out


def corpus(seed, n, words=12):
    rng = random.Random(seed)
    some = [*"abcdefgh", "the", "THE", "é", "\U0001f600", "x-y", "0"][:words]
    gaps = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "!? "]
    made = []
    for k in range(n):
        text = "".join(rng.choice(some) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))
        made.append((rng.choice(["en", "en", "de", None, "und"]), text + rng.choice(["", " strong tea now", " by way of"])))
    return [*made, ("en", None), (None, None), ("en", ""), ("fr", "..."), ("en", ". , \n"), ("en", "kelvin K one " * 12), ("es", "p q r s " * 12)]


def found(spark, docs, parts=4, **settings):
    frame = spark.createDataFrame([(k, t, g) for k, (g, t) in enumerate(docs)], "doc_id long, text string, lang string")
    frame = frame.selectExpr("*", "1 AS n", "'x' AS phrase", "2 AS size", "3 AS part").repartition(parts)
    return {tuple(r) for r in phrases.collocations(frame, **settings).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_equal_plain_counts(spark, seed):
    docs = corpus(seed, 160)
    want = brute(docs)
    assert len(want) > 60 and {len(r[2].split(" ")) for r in want} == {2, 3}
    assert found(spark, docs) == want


def test_the_best_of_each_language(spark):
    docs = corpus(5, 120)
    assert found(spark, docs, top=7) == brute(docs, top=7)


def test_buffers_and_blocks_change_nothing(spark, monkeypatch):
    docs = corpus(3, 40)
    docs.append(("en", "a b c d " * 400 + "w" * 90 + " a b c"))

    def rows(held, block):
        monkeypatch.setattr(phrases, "BLOCK", block)
        streams = collections.Counter()
        buffer = phrases.Buffer()
        ones = phrases.np.full(1024, 2**64 - 1, phrases.np.uint64)

        def count():
            for part in buffer.flush():
                for batch in (*phrases.short_runs(*part), *phrases.long_runs(*part, ones)):
                    for r in batch.to_pylist():
                        streams[r["lang"], r["phrase"]] += r["n"]

        for lang, text in docs:
            for words in phrases.token_blocks(text or ""):
                for start in range(0, len(words), held):
                    buffer.add(lang or "und", words[start : start + held])
                    if buffer.held >= held:
                        count()
        count()
        return +streams

    want = rows(1 << 20, 1 << 20)
    assert want == rows(5, 40) == rows(64, 7)


def test_ranges_of_the_stream_carry_what_others_need(spark):
    docs = [("en", " ".join(["the", w, x]) + ".") for w in "abcdefgh" for x in "ijklmnop" for _ in range(10 + ord(w) % 5)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert found(spark, docs) == brute(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**13, 3 * 10**13, 7 * 10**13)], "a long, l long, r long").select(phrases.score_of("a", "l", "r")).first()
    assert row[0] == 1_000_000 * 10**26 // (21 * 10**26)


def test_empty_table(spark):
    assert found(spark, []) == set()
