"""A corpus pipeline of five stages, from raw documents to token counts and digests.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of ``docs``. A stage
works on all rows that the one before it kept: documents that the quality classifier rejects go, one document of each
group of near duplicates stays, documents that hold a benchmark item go, personal data is replaced in the text, and
the texts are encoded.

Each stage takes nulls in any column, empty and very long texts, ties and repeated rows as its operator's docstring says;
of empty documents each stage makes an empty table of the same columns. Columns of ``docs`` may have any name: a stage
carries its row as one struct. Each stage keeps batches small for the session, also when it is called by itself, as
long texts pass through Python in three stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import bpe, decontam, jaccard, pii, quality
from veilspark.llm.common import ROW_GROUP, shared_folder, small_batches
from veilspark.plans.kit import Registry, table

TOKENIZER = "byte_bpe_50k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("PII", redact),
    ("BPE encoding and decoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.option("parquet.block.size", ROW_GROUP).parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


REGISTRY = Registry({}, {})
REGISTRY.put("pipeline", run, ORACLE_SQL)
