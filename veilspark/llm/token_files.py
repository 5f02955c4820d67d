"""Token ids in binary blocks, each document compressed on its own with a shared zstandard dictionary.

The file format is a Parquet folder of blocks, so it can be in any store that Spark reaches, and Spark's commit
protocol leaves no halves of lost tasks. A row is a block: ``payload`` holds one zstandard frame a document, and
``doc_ids``, ``offsets`` and ``tokens`` are its index, with the bytes at which frames begin and the ids they hold.
``first`` and ``last`` let a reader skip to the block of a document, ``part`` and ``start`` give the place of its first
id, and ``dictionary`` names the dictionary by its sha256. The dictionary lies in a folder beside the blocks. It is
trained on the serialized ids of at most ``SAMPLE`` short documents, those with the smallest hash of their id; it only
shortens frames, every document is written whole.

Defined cases: a null text is empty and holds the end id alone; repeated rows are documents of their own, ordered by
text; a null id sorts first; with too few documents to train on there is no dictionary and its name is empty; an empty
table gives no blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts
from .tokens import Encoder

BLOCK_TOKENS = 1 << 20
SAMPLE = 2_000
SHORT = 2_048
DICTIONARY = 32 * 1024
LEVEL = 3


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path, "white")


def with_end(encoder: Encoder, text: str, end: int) -> np.ndarray:
    return np.append(encoder.encode(text), np.array([end], encoder.type))


def dictionary_of(docs: DataFrame, path: str, end: int) -> bytes:
    """Train on the ids of a bounded sample; empty if there is too little of it."""
    picked = (
        docs.where(F.octet_length("text").between(1, SHORT)).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE)
    )

    def serialize(batches):
        encoder = encoder_of(path)
        for batch in batches:
            ids = [with_end(encoder, t, end).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"ids": pa.array(ids, pa.binary())})

    samples = sorted(bytes(r["ids"]) for r in picked.select("text").mapInArrow(serialize, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def name_of(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest() if dictionary else ""


def loaded(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write(docs: DataFrame, folder: str, path: str, end: int = 2) -> None:
    """Write ``folder``/blocks and ``folder``/dictionary, documents in ascending order of their id."""
    spark = docs.sparkSession
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    dictionary = dictionary_of(rows, path, end)
    name = name_of(dictionary)
    spark.createDataFrame([(name, bytearray(dictionary))], "name string, content binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    def blocks(batches):
        encoder = encoder_of(path)
        tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=loaded(dictionary))
        part, start, number, held = TaskContext.get().partitionId(), 0, 0, 0
        ids, counts, frames = [], [], []

        def block():
            offsets = np.cumsum([0] + [len(f) for f in frames])
            value = lambda k: pa.array([ids[k]], id_type)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "start": pa.array([start], pa.int64()),
                "first": value(0), "last": value(-1), "doc_ids": pa.array([ids], pa.list_(id_type)),
                "offsets": pa.array([offsets.tolist()], pa.list_(pa.int64())), "tokens": pa.array([counts], pa.list_(pa.int64())),
                "width": pa.array([encoder.type.itemsize], pa.int32()), "dictionary": pa.array([name], pa.string()),
                "payload": pa.array([b"".join(frames)], pa.binary()),
            })

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                got = with_end(encoder, text, end)
                ids.append(doc_id)
                counts.append(len(got))
                frames.append(tool.compress(got.tobytes()))
                held += len(got)
                if held >= BLOCK_TOKENS:
                    yield block()
                    start, number, held = start + held, number + 1, 0
                    ids, counts, frames = [], [], []
        if ids:
            yield block()

    schema = (
        f"part int, block int, start long, first {kind}, last {kind}, doc_ids array<{kind}>, offsets array<long>, "
        "tokens array<long>, width int, dictionary string, payload binary"
    )
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, schema).write.parquet(f"{folder}/blocks")


def dictionaries(spark: SparkSession, folder: str) -> dict[str, bytes]:
    return {r["name"]: bytes(r["content"]) for r in spark.read.parquet(f"{folder}/dictionary").collect()}


def frames_of(batch: pa.RecordBatch, known: dict[str, bytes]):
    """(row of the batch, doc index, ids) of every document, from the blocks' own bytes."""
    for row in range(batch.num_rows):
        name, width = batch["dictionary"][row].as_py(), batch["width"][row].as_py()
        if name not in known or name_of(known[name]) != name:
            raise ValueError(f"dictionary {name} is missing or was changed")
        tool = zstandard.ZstdDecompressor(dict_data=loaded(known[name]))
        payload, offsets = memoryview(batch["payload"][row].as_buffer()), batch["offsets"][row].as_py()
        for k, (low, high) in enumerate(zip(offsets, offsets[1:], strict=False)):
            yield row, k, np.frombuffer(tool.decompress(payload[low:high]), f"<u{width}")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    known = dictionaries(spark, folder)
    # one number for each partition of the writing job
    totals = blocks.select("part", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before, passed = [], 0
    for row in sorted(totals.collect(), key=lambda r: r["part"]):
        before.append((row["part"], passed))
        passed += row["n"]
    before = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    kind = blocks.schema["first"].dataType.simpleString()

    def decode(batches):
        for batch in batches:
            starts, counts, sums, doc_ids = [], [], [], []
            for row, docs in groupby(frames_of(batch, known), key=lambda x: x[0]):
                at = batch["start"][row].as_py() + batch["before"][row].as_py()
                doc_ids.append(batch["doc_ids"][row].values)
                for _, _, ids in docs:
                    starts.append(at)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    at += len(ids)
            if doc_ids:
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.concat_arrays(doc_ids), "start": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
                })

    return blocks.join(before, "part").mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, folder: str, doc_id) -> list[np.ndarray]:
    """The ids of a document's rows: its blocks by their bounds, its frames by their offsets, no others decompressed."""
    known = dictionaries(spark, folder)
    out = []
    blocks = spark.read.parquet(f"{folder}/blocks")
    near = blocks.where((F.col("first").isNull() | (F.col("first") <= doc_id)) & (F.col("last") >= doc_id))
    for row in near.orderBy("part", "block").collect():
        tool = zstandard.ZstdDecompressor(dict_data=loaded(known[row["dictionary"]]))
        for k, found in enumerate(row["doc_ids"]):
            if found == doc_id:
                frame = bytes(row["payload"][row["offsets"][k] : row["offsets"][k + 1]])
                out.append(np.frombuffer(tool.decompress(frame), f"<u{row['width']}"))
    return out
