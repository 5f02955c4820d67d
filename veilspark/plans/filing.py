"""Queries for file sources, over files whose content is derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scan
from ..policy import Policy
from ..rules.table import builtin
from ..sources import delimited, files, tables
from ..streaming.jobs import shared_folder
from .kit import DOC_PATH, REGISTRY, derived, for_oracle

RAW = f"SELECT doc_id, {DOC_PATH} AS path, coalesce(text, '') AS text FROM {{documents}}"
POLICY = Policy(max_file_size_bytes=8000)
RULES = [r for r in builtin() if r.rule_id in ("pii.email", "pii.ipv4")]


def _content(spark, sf_dir):
    """Files as bytes: plain, UTF-16 with a mark, with a NUL byte, and with a broken byte."""
    rows = derived(spark, sf_dir, RAW)
    text = F.col("text")
    kind = F.col("doc_id") % 5
    data = (
        F.when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(kind == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
        .when(kind == 3, F.concat(F.encode(F.lit("ab"), "UTF-8"), F.unhex(F.lit("00")), F.encode(text, "UTF-8")))
        .when(kind == 4, F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("FF"))))
        .otherwise(F.encode(text, "UTF-8"))
    )
    return rows.select("doc_id", "path", data.alias("content")).withColumn("length", F.octet_length("content").cast("long"))


UTF16 = "2 + 2 * (length(coalesce(text, '')) + length(regexp_replace(coalesce(text, ''), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"
BYTES = f"CASE doc_id % 5 WHEN 1 THEN {UTF16} WHEN 2 THEN {UTF16} WHEN 3 THEN strlen(coalesce(text, '')) + 3 WHEN 4 THEN strlen(coalesce(text, '')) + 1 ELSE strlen(coalesce(text, '')) END"


@REGISTRY.add("src_file_decode", "SELECT path, md5(CASE doc_id % 5 WHEN 3 THEN concat('ab', chr(0), text) WHEN 4 THEN concat(text, '�') ELSE text END) AS digest FROM (" + for_oracle(RAW) + ")")
def src_file_decode(spark, sf_dir):
    rows = _content(spark, sf_dir)
    return rows.select("path", F.md5(files.decode(F.col("content"))["text"].cast("binary")).alias("digest"))


@REGISTRY.add("flt_binary", f"SELECT path FROM ({for_oracle(RAW)}) WHERE doc_id % 5 = 3")
def flt_binary(spark, sf_dir):
    return _content(spark, sf_dir).where(files.is_binary(F.col("content"), 8192)).select("path")


@REGISTRY.add("det_skip_notices", f"""WITH f AS (SELECT path, doc_id, {BYTES} AS size FROM ({for_oracle(RAW)}))
SELECT path AS file, CASE WHEN size > 8000 THEN 'scan.file_too_large' WHEN doc_id % 5 = 3 THEN 'scan.binary_skipped' ELSE 'scan.non_utf8_lossy' END AS rule_id
FROM f WHERE size > 8000 OR doc_id % 5 IN (3, 4)""")
def det_skip_notices(spark, sf_dir):
    rows = _content(spark, sf_dir)
    return files.notices(files.classify(rows, POLICY)).select("file", "rule_id")


@REGISTRY.add("src_files")
def src_files(spark, sf_dir):
    """The table files themselves as a directory tree: all are binary or too large."""
    listed = files.read_files(spark, sf_dir, Policy(exclude=()))
    return files.notices(files.classify(listed)).select("file", "rule_id")


_NUL = "SELECT doc_id, coalesce(text, '') AS text FROM {documents}"


@REGISTRY.add("src_nul_text", f"""SELECT doc_id, md5(CASE WHEN regexp_full_match(text, '[ -~[:space:]]*') THEN text ELSE array_to_string(regexp_extract_all(text, '[ -~' || chr(9) || ']{{6,}}'), chr(10)) END) AS digest,
md5(array_to_string(regexp_extract_all(text, '[ -~' || chr(9) || ']{{6,}}'), chr(10))) AS runs, md5(text) AS wide FROM ({for_oracle(_NUL)})""")
def src_nul_text(spark, sf_dir):
    """Whole texts whose lines end in NUL, the same behind bytes of no text, and in two bytes a character with a mark."""
    rows = derived(spark, sf_dir, _NUL)
    nul = F.unhex(F.hex(F.encode(F.replace("text", F.lit("\n"), F.lit("\x00")), "UTF-8")))
    binary = F.concat(F.unhex(F.lit("0102FE")), nul, F.unhex(F.lit("03FF")))
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    digest = lambda c: F.md5(files.nul_text(c).cast("binary"))
    return rows.select("doc_id", digest(nul).alias("digest"), digest(binary).alias("runs"), digest(wide).alias("wide"))


_NOTED = """SELECT c_custkey AS id, concat('x ', chr(34), c_name, chr(34), ', y', CASE WHEN c_custkey % 3 = 0 THEN concat(chr(10), 'second, ', chr(34), chr(10), c_mktsegment) ELSE '' END) AS note,
CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS segment FROM {customer}"""


@REGISTRY.add("src_delimited", f"SELECT id, 3 AS fields, note, segment FROM ({for_oracle(_NOTED)})")
def src_delimited(spark, sf_dir):
    """The table written as one file with quotes and line breaks in its fields, and read back in splits."""
    folder = shared_folder(spark)
    tables.write_delimited(derived(spark, sf_dir, _NOTED).coalesce(1), folder, header=False)
    fields = delimited.read_records(spark, folder).select("fields")
    at = lambda k: F.get("fields", F.lit(k))
    return fields.select(at(0).cast("long").alias("id"), F.size("fields").alias("fields"), at(1).alias("note"), at(2).alias("segment"))


@REGISTRY.add("src_office_text")
def src_office_text(spark, sf_dir):
    """Documents packed as minimal docx files in the tasks, then read back."""
    rows = derived(spark, sf_dir, RAW).select("path", "text")

    def pack(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        for batch in batches:
            out = []
            for text in batch["text"]:
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as archive:
                    body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
                    archive.writestr("word/document.xml", f'<w:d xmlns:w="w">{body}</w:d>')
                out.append(buffer.getvalue())
            yield batch.assign(content=out)[["path", "content"]]

    packed = rows.mapInPandas(pack, "path string, content binary")
    parts = tables.office_documents(tables.office_text(packed))
    found = scan.scan(parts, carry=[], rules=RULES)
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.add("src_policy", "SELECT count(*) AS documents, 2 AS allowlist, 1 AS custom FROM documents WHERE strlen(coalesce(text, '')) <= 2000")
def src_policy(spark, sf_dir):
    policy = Policy.from_dict({
        "scan": {"max_file_size_bytes": 2000}, "rules": {"internal_terms": True},
        "custom_rules": [{"id": "t", "pattern": "x+", "severity": "low"}],
        "allowlist": [{"rule_id": "pii.email"}, {"path": "src/**", "owner": "me"}],
    })
    docs = derived(spark, sf_dir, RAW).where(F.octet_length("text") <= policy.max_file_size_bytes)
    return docs.agg(F.count(F.lit(1)).alias("documents")).select(
        "documents", F.lit(len(policy.allowlist)).alias("allowlist"), F.lit(len(policy.active_custom_rules())).alias("custom"))


@REGISTRY.add("flt_only_known", f"""WITH f AS (SELECT path, doc_id, {BYTES} AS size FROM ({for_oracle(RAW)}))
SELECT bool_or(size > 8000 OR doc_id % 5 = 3) AS not_inspected FROM f""")
def flt_only_known(spark, sf_dir):
    """A leftover check is void when any file was not looked at."""
    rows = _content(spark, sf_dir)
    return files.not_inspected(files.notices(files.classify(rows, POLICY)))
