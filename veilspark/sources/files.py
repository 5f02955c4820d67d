"""Files as rows: listing, size and binary checks, decoding, skip notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as path_fn
from ..policy import Policy

NOTICE_COLUMNS = ("rule_id", "severity", "kind", "file", "line", "column", "message")
# files beyond this are not worth one row of content; Spark rows end at 2 GB
READ_LIMIT = 1 << 30


def read_files(spark: SparkSession, root: str, policy: Policy = Policy()) -> DataFrame:
    """``path, length, content`` of a directory tree, paths relative to the root.

    The path filter runs on the listing. Large files are listed by a scan of
    their own that has no content column, so they are never opened: the size
    test is pushed into both scans.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), base, -1)
    limit = min(policy.max_file_size_bytes, READ_LIMIT)
    small = raw.where(F.col("length") <= limit).select("path", "length", "content")
    large = raw.where(F.col("length") > limit).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large).withColumn("path", rel).where(
        path_fn.path_allowed(F.col("path"), policy.include, policy.exclude))


def size_notice(size: Column, limit: int) -> Column:
    return F.when(size > limit, "scan.file_too_large")


def is_binary(content: Column, window: int) -> Column:
    """A NUL byte in the first bytes, unless a UTF-16 mark explains it."""
    head = F.substring(content, 1, window)
    return F.contains(F.hex(head), F.lit("00")) & F.hex(head).rlike(r"\A(?:..)*?00") & utf16_charset(content).isNull()


def utf16_charset(content: Column) -> Column:
    """Charset named by a byte order mark; UTF-32 marks do not count."""
    mark = F.hex(F.substring(content, 1, 4))
    return (
        F.when(mark == "FFFE0000", F.lit(None).cast("string"))
        .when(mark.startswith("FFFE"), "UTF-16LE")
        .when(mark.startswith("FEFF"), "UTF-16BE")
    )


def decode(content: Column) -> Column:
    """Text of a file and whether something was lost on the way.

    UTF-16 by its mark, else UTF-8 with invalid bytes replaced.
    """
    charset = utf16_charset(content)
    body = F.substring(content, 3, 2**31 - 1)
    utf8 = F.call_function("is_valid_utf8", content.cast("string"))
    text = (
        F.when(charset == "UTF-16LE", F.decode(body, "UTF-16LE"))
        .when(charset == "UTF-16BE", F.decode(body, "UTF-16BE"))
        .otherwise(F.call_function("make_valid_utf8", content.cast("string")))
    )
    return F.struct(text.alias("text"), (charset.isNull() & ~utf8).alias("lossy"))


def classify(files: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Add ``notice`` (why a file is not scanned as it is), ``text`` and ``lossy``."""
    decoded = decode(F.col("content"))
    notice = (
        F.when(F.col("length") > policy.max_file_size_bytes, "scan.file_too_large")
        .when(F.col("content").isNull(), "scan.file_read_error")
        .when(is_binary(F.col("content"), policy.binary_detection_bytes), "scan.binary_skipped")
    )
    staged = files.withColumn("notice", notice)
    text = F.when(F.col("notice").isNull(), decoded)
    return staged.select("path", "length", "notice", text.alias("d")).select(
        "path", "length",
        F.coalesce("notice", F.when(F.col("d.lossy"), "scan.non_utf8_lossy")).alias("notice"),
        F.col("d.text").alias("text"),
    )


def documents(classified: DataFrame) -> DataFrame:
    """Files that can be scanned, as documents."""
    return classified.where(F.col("text").isNotNull()).select("path", "text")


# --- fixed values: what the notices say ------------------------------------------
MESSAGES = {
    "scan.file_too_large": "file skipped: larger than the size limit",
    "scan.file_read_error": "file skipped: it could not be read",
    "scan.binary_skipped": "file skipped: it looks like binary data",
    "scan.document_text_empty": "document holds no extractable text",
    "scan.non_utf8_lossy": "file is not valid UTF-8; invalid bytes were replaced before scanning",
    "scan.walk_error": "directory entry could not be read",
}


def notices(classified: DataFrame) -> DataFrame:
    """Info findings about files that were skipped or changed on reading."""
    message = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
    return classified.where(F.col("notice").isNotNull()).select(
        F.col("notice").alias("rule_id"), F.lit("info").alias("severity"), F.lit("ignore").alias("kind"),
        F.col("path").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column"),
        message[F.col("notice")].alias("message"),
    )


NOT_INSPECTED = ("scan.file_too_large", "scan.file_read_error", "scan.binary_skipped", "scan.walk_error")


def not_inspected(noticed: DataFrame) -> DataFrame:
    """Whether some file was skipped, which voids a check for leftovers."""
    return noticed.agg(F.coalesce(F.bool_or(F.col("rule_id").isin(*NOT_INSPECTED)), F.lit(False)).alias("not_inspected"))


def with_tracked(walked: DataFrame, tracked: DataFrame) -> DataFrame:
    """Add tracked files that ignore rules hid, none of them twice: the walked row wins, of several the least."""
    both = walked.withColumn("__origin", F.lit(0)).unionByName(tracked.withColumn("__origin", F.lit(1)))
    rest = [c for c in walked.columns if c != "identity"]
    chosen = both.groupBy("identity").agg(F.min(F.struct("__origin", *rest)).alias("__row"))
    return chosen.select(*(F.col("identity") if c == "identity" else F.col("__row")[c].alias(c) for c in walked.columns))


def printable_runs(text: Column) -> Column:
    """Runs of six or more printable characters, one per line."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"([ -~\t]{6,})"), F.lit(1)), "\n")


def nul_text(content: Column) -> Column:
    """Text of NUL-separated or UTF-16-like bytes; other binaries keep their printable runs."""
    as_hex = F.hex(content)
    wide_le = as_hex.rlike(r"\A(?:[0-9A-F]{2}00)+\z")
    wide_be = as_hex.rlike(r"\A(?:00[0-9A-F]{2})+\z")
    plain = F.decode(content, "ISO-8859-1")
    separated = ~plain.rlike(r"[\x01-\x08\x0E-\x1F\x7F-\xFF]")
    return (
        F.when(utf16_charset(content).isNotNull(), decode(content)["text"])
        .when(wide_le, F.decode(content, "UTF-16LE"))
        .when(wide_be, F.decode(content, "UTF-16BE"))
        .when(separated, F.replace(plain, F.lit("\x00"), F.lit("\n")))
        .otherwise(printable_runs(plain))
    )
