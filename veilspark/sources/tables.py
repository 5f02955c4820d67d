"""Delimited files and Office documents as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: bounds on one Office document ----------------------------------
MAX_ENTRIES = 10_000
MIN_ENTRY_BYTES, MAX_ENTRY_BYTES = 4 << 20, 32 << 20
MIN_TOTAL_BYTES, MAX_TOTAL_BYTES = 16 << 20, 256 << 20


def delimiter_for(path: str) -> str:
    return "\t" if path.lower().endswith(".tsv") else ","


def read_delimited(spark: SparkSession, path: str, *, header: bool = True, columns: list[str] | None = None,
                   sep: str | None = None) -> DataFrame:
    """A CSV or TSV table with text columns. Quoted fields may span lines.

    Give ``columns`` for tables whose rows differ in width: shorter rows get
    nulls. Without a header columns are named by position.
    """
    reader = (
        spark.read.option("sep", sep or delimiter_for(path)).option("multiLine", "true").option("quote", '"')
        .option("escape", '"').option("mode", "PERMISSIVE").option("header", str(header).lower())
        .option("nullValue", "\x00").option("emptyValue", "")
    )
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    out = reader.csv(path)
    if columns:
        return out
    # the reader gives null for an empty field; without ragged rows that is the only source of nulls
    out = out.na.fill("")
    return out if header else out.toDF(*(str(i) for i in range(len(out.columns))))


def write_delimited(df: DataFrame, path: str, *, header: bool = True, sep: str = ",", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", str(header).lower()).option("sep", sep).option("quote", '"').option(
        "escape", '"').option("emptyValue", "").csv(path)


def csv_fields(line: Column, sep: str = ",") -> Column:
    """Fields of one delimited record, as many as it has; quotes doubled inside quotes."""
    # each match begins with a separator, so that an empty first field is one as well
    pattern = rf'{sep}(?:"((?:[^"]|"")*+)"|([^{sep}]*+))'
    whole = F.concat(F.lit(sep), line)
    quoted = F.regexp_extract_all(whole, F.lit(pattern), F.lit(1))
    plain = F.regexp_extract_all(whole, F.lit(pattern), F.lit(2))
    return F.transform(quoted, lambda q, i: F.when(q != "", F.replace(q, F.lit('""'), F.lit('"'))).otherwise(F.get(plain, i)))


def office_text(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Text parts of docx, xlsx and pptx files: ``path, entry, text``.

    Containers are ZIP archives of XML, which Spark cannot read; each file is
    opened by the task that holds its row and yields one row per part. Entries
    and bytes per file are bounded, and a file over a bound says so.
    """
    limits = (MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_TOTAL_BYTES)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        wanted = re.compile(
            r"\A(?:word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)|xl/(?:sharedStrings|worksheets/[^/]+|comments\d*)"
            r"|ppt/(?:slides|notesSlides)/[^/]+)\.xml\Z")
        max_entries, max_entry, max_total = limits

        def text_of(xml: bytes) -> str:
            if b"<!DOCTYPE" in xml[:4096] or b"<!ENTITY" in xml:
                return ""
            blocks, line = [], []
            for event, node in ElementTree.iterparse(io.BytesIO(xml), events=("end",)):
                tag = node.tag.rsplit("}", 1)[-1]
                if tag in ("t", "v") and node.text:
                    line.append(node.text)
                elif tag in ("p", "si", "row") and line:
                    blocks.append("".join(line) if tag != "row" else "\t".join(line))
                    line = []
            if line:
                blocks.append("".join(line))
            return "\n".join(blocks)

        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as archive:
                        entries = [e for e in archive.infolist() if wanted.match(e.filename)]
                        if len(archive.infolist()) > max_entries or sum(e.file_size for e in entries) > max_total or any(
                                e.file_size > max_entry for e in entries):
                            rows.append((name, None, None, "scan.file_too_large"))
                            continue
                        made = [(name, e.filename, text_of(archive.read(e)), None) for e in entries]
                        if not any(m[2] for m in made):
                            rows.append((name, None, None, "scan.document_text_empty"))
                        rows += [m for m in made if m[2]]
                except (zipfile.BadZipFile, ElementTree.ParseError, RuntimeError):
                    rows.append((name, None, None, "scan.file_read_error"))
            yield pd.DataFrame(rows, columns=["path", "entry", "text", "notice"])

    chosen = files.select(F.col(path).alias("path"), F.col(content).alias("content"))
    return chosen.mapInPandas(parts, "path string, entry string, text string, notice string")


def office_documents(parts: DataFrame) -> DataFrame:
    """Parts as documents labelled ``path:entry``."""
    return parts.where("text IS NOT NULL").select(F.concat_ws(":", "path", "entry").alias("path"), "text")
