"""Buckets of the Jaccard join that are neither small nor too large to compare whole."""

import random

import numpy as np
import pytest
from test_llm import check_join, prose

from veilspark.llm import common, jaccard


def hot_texts(n):
    """n texts that share a line and little else, and n near copies."""
    line, docs = prose(91, 40), []
    docs += [(k, line + " " + prose(1000 + k, 60)) for k in range(n)]
    base, rng = prose(92, 150).split(), random.Random(9)
    for k in range(n):
        text = list(base)
        for _ in range(rng.choice([1, 2, 4])):
            text[rng.randrange(len(text))] = f"w{k}"
        docs.append((5000 + k, " ".join(text)))
    return docs


def rows_below(monkeypatch):
    """How many rows each level has, as they are written."""
    rows = []

    def kept(df, what):
        out = common.kept(df, what)
        if what == "jaccard-level":
            rows.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "kept", kept)
    return rows


def test_buckets_that_can_be_compared_whole_do_not_go_below(spark, monkeypatch):
    rows, docs = rows_below(monkeypatch), hot_texts(150)
    check_join(spark.createDataFrame(docs, "doc_id long, text string"), docs)
    assert sum(rows) == 0


def test_lower_levels_find_the_same_and_grow_with_their_members(spark, monkeypatch):
    rows, sums = rows_below(monkeypatch), []
    monkeypatch.setattr(jaccard, "WHOLE", jaccard.SMALL)
    for n in (150, 300):
        docs = hot_texts(n)
        check_join(spark.createDataFrame(docs, "doc_id long, text string"), docs)
        sums.append(sum(rows))
        rows.clear()
    assert 0 < sums[1] < 3 * sums[0]


@pytest.mark.parametrize("seed", range(4))
def test_spanning_forest_has_the_components_of_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (7, 64), dtype=np.uint8)
    m = 300
    sig = np.where(rng.random((m, 64)) < 0.78, base[rng.integers(0, 7, m)], rng.integers(0, 256, (m, 64), dtype=np.uint8))
    n = rng.integers(80, 125, m).astype(float)
    near = ((sig[:, None, :] == sig[None, :, :]).sum(2) >= jaccard.TIED_BOTH) & (np.minimum.outer(n, n) >= 0.75 * np.maximum.outer(n, n))
    got = jaccard.spanning(sig, n, jaccard.TIED_BOTH)
    assert all(near[a, b] for a, b in got)
    forests = jaccard.Forest(m), jaccard.Forest(m)
    for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        forests[0].tie(int(a), int(b))
    assert all(forests[1].tie(a, b) for a, b in got)
    assert [forests[0].find(k) for k in range(m)] == [forests[1].find(k) for k in range(m)]
