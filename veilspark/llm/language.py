"""Language identification by compression.

Each language has a raw-content zstandard dictionary cut from documents of that language. A text is compressed with
each of them, and the language whose dictionary gives the fewest bytes is taken; where the second best is hardly
longer, the row is marked as rejected by margin, and its guess is still given. Dictionaries come from at most
``per_language`` documents and ``DICTIONARY`` bytes a language, chosen by the hash of the id, short documents first.
Classification is a map over the documents, and every text is compressed whole.

Defined cases: a null or empty text, or one without a letter, is ``und`` with score 0; ties go to the language that
sorts first; with no learned language everything is ``und``; repeated rows get a row each.
"""

from __future__ import annotations

import math

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

UNKNOWN = "und"
PER_LANGUAGE = 120
DICTIONARY = 64 * 1024
SHORT = 2 * 1024
LEVEL = 6
#: Bytes saved over the second best, as a share of the text's compressed size, below which a row is rejected.
MARGIN = 0.01


def learn(docs: DataFrame, lang: str = "lang", per_language: int = PER_LANGUAGE) -> dict[str, bytes]:
    """Language -> dictionary content. ``docs`` holds the rows that may be learned from.

    Rows are ranked on ids and lengths only, with a limit per language before the shuffle; the texts of the chosen
    ones, at most ``DICTIONARY`` bytes a language, are then cut from the documents.
    """
    sized = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(lang).alias("lang"), (F.octet_length("text") > SHORT).alias("long")
    )
    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id")
    picked = (
        sized.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
        .groupBy("doc_id", "lang").agg(F.min("place").alias("place"))
    )
    found = (
        docs.select("doc_id", F.col(lang).alias("lang"), F.substring("text", 1, DICTIONARY).alias("sample"))
        .join(F.broadcast(picked), ["doc_id", "lang"])
        .groupBy("lang").agg(F.array_sort(F.collect_set(F.struct("place", "sample"))).alias("rows"))
    )
    out = {}
    for row in found.collect():
        content = b"\n".join(r["sample"].lower().encode() for r in row["rows"])[:DICTIONARY]
        out[row["lang"]] = content
    return out


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score and rejected."""
    names = sorted(dictionaries)

    def predict(batches):
        tools = []
        for name in names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            tools.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False
            ))
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                if not tools or not any(map(str.isalpha, text)):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                raw = text.lower().encode()
                sizes = [len(tool.compress(raw)) for tool in tools]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                second = min((n for k, n in enumerate(sizes) if k != best), default=2 * sizes[best])
                saved = (second - sizes[best]) / max(1, second)
                out.append((names[best], 0.5 + 0.5 * math.tanh(20 * saved), saved < margin))
            langs, scores, rejected = map(list, zip(*out, strict=True)) if out else ([], [], [])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "lang_pred": pa.array(langs, pa.string()),
                "score": pa.array(scores, pa.float64()), "rejected": pa.array(rejected, pa.bool_()),
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
