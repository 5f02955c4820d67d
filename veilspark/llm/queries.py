"""Queries of this subpackage: each applies one operator to the whole of its table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.kit import Registry, table
from . import bpe, cws, decontam, jaccard, language, licenses, mixing, phrases, pii, quality, resampling, sharding, token_files
from .common import id_crc, shared_folder, small_batches

REGISTRY = Registry({}, {})


@REGISTRY.add("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.training_labels(table(spark, sf_dir, "labels")))
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", "predicted")


@REGISTRY.add("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc(F.col("doc_id")) % 5 == 0
    found = language.classify(docs, language.learn(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@REGISTRY.add("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@REGISTRY.add("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, pii.fit(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))


@REGISTRY.add("op2_licenses")
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@REGISTRY.add("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@REGISTRY.add("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_index(spark, folder)


@REGISTRY.add("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.compare_neighbours(table(spark, sf_dir, "documents"))


@REGISTRY.add("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@REGISTRY.add("op5_jaccard")
def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.join(table(spark, sf_dir, "documents"))


@REGISTRY.add("op13_resampling")
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@REGISTRY.add("op12_mixing")
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


PHRASES_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
worded AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
sized AS (SELECT lang, w, unnest([1, 2, 3]) AS k FROM worded),
placed AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM placed GROUP BY ALL),
total AS (SELECT lang, cast(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidate AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE k > 1 AND n >= 10),
cut AS (
    SELECT *, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, k)) AS j FROM candidate)),
rated AS (
    SELECT c.lang, c.phrase, c.k, c.a, j, x.n AS l, y.n AS r, (1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n) AS score
    FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = rest),
lowest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
part AS (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM candidate WHERE k = 3),
hidden AS (SELECT DISTINCT c.lang, c.phrase FROM candidate c JOIN part p USING (lang, phrase) WHERE c.k = 2 AND 100 * longer >= 50 * c.a),
placed_best AS (
    SELECT l.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM lowest l ANTI JOIN hidden h USING (lang, phrase))
SELECT b.lang, rank, phrase, a, l, r, t.n, cast(score AS BIGINT) AS score FROM placed_best b JOIN total t USING (lang) WHERE rank <= 2000
"""


@REGISTRY.add("op11_collocations", PHRASES_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return phrases.collocations(table(spark, sf_dir, "documents"))
