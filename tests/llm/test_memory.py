"""What goes to Python workers, and what they keep."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from veilspark.llm import bpe, common, jaccard, quality

BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def test_accepted_sends_only_texts_to_python(spark):
    docs = spark.createDataFrame([(i, f"some words {i}", "x" * 50) for i in range(20)], "doc_id long, text string, `a b` string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    out = quality.accepted(docs, labels)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    assert out.columns == docs.columns and out.exceptAll(docs).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_each_stage_keeps_batches_small_when_called_by_itself(spark, name, stage):
    before = [spark.conf.get(k) for k in BATCHES]
    docs = spark.createDataFrame([(1, "a few words of text")], "doc_id long, text string")
    try:
        for k in BATCHES:
            spark.conf.set(k, "4000")
        stage(spark, docs, "/root/testdata/sf0.001")
        assert [spark.conf.get(k) for k in BATCHES] == [str(common.BATCH_ROWS)] * 2
    finally:
        for k, v in zip(BATCHES, before, strict=True):
            spark.conf.set(k, v)


def test_worker_drops_the_tokenizer_when_another_operator_begins():
    path = public_tokenizers.path("byte_bpe_50k.json")
    batch = pa.RecordBatch.from_pydict({"text": ["a"] * 3})
    bpe.held(path)
    assert sum(map(len, common.slices([batch], owner="bpe"))) == 3 and bpe.tree_of.cache_info().currsize == 1
    assert sum(map(len, common.slices([batch]))) == 3 and bpe.tree_of.cache_info().currsize == 0


def test_encoder_keeps_a_word_in_one_cache(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "one two, two one \u00e9t\u00e9 two  \u00e9t\u00e9"
    for most in (0, 1, 2, 100):
        monkeypatch.setattr(bpe, "CACHED", most)
        encoder = bpe.Tree(path).encoder
        for _ in range(2):
            assert encoder.encode(text).tolist() == encoder.whole(text).tolist()
        assert len(encoder.pieces) <= most and len(encoder.words) <= most
    assert " one" in encoder.pieces and "\u0120one" not in encoder.words


def test_deduplicated_writes_a_text_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(jaccard, "kept", lambda df, what: written.append((what, df.columns)) or common.kept(df, what))
    rows = [(1, "one two three four five six", 7), (2, "one two three four five six", 8), (3, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid int")
    out = jaccard.deduplicated(docs)
    assert sorted(map(tuple, out.collect())) == [rows[0], rows[2]] and out.columns == docs.columns
    assert ("jaccard-docs", ["row", "uid"]) in written
