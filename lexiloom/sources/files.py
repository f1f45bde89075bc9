"""Reading documents of several formats, with an error row instead of a failure for what can't be read."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T

#: Extensions that are accepted, and those whose content is plain text.
ACCEPTED, PLAIN = ("txt", "pdf", "docx", "doc", "md", "csv"), ("txt", "md", "csv")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(name: Column) -> Column:
    """The lower-case letters after the last point of a file name; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file, each followed by a blank line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in tree.iter(f"{_WORD}p"):
        out.append("".join(t.text or "" if t.tag == f"{_WORD}t" else "\t" if t.tag == f"{_WORD}tab" else "\n" if t.tag == f"{_WORD}br" else "" for t in p.iter()))
    return "\n\n".join(out)


def pdf_text(content: bytes) -> str:
    """Pages joined by blank lines; needs the optional library pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("PDF files need the optional library pypdf") from e
    return "\n\n".join(" ".join((page.extract_text() or "").split("\n")) for page in PdfReader(io.BytesIO(content)).pages)


def parse(name: str, content: bytes) -> tuple[str | None, str | None]:
    """(text, None) or (None, error) of one file."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    try:
        if ext in PLAIN:
            return content.decode("utf-8", "replace").lstrip("﻿").strip(), None
        if ext == "docx":
            return docx_text(content).strip(), None
        if ext == "pdf":
            return pdf_text(content).strip(), None
        if ext == "doc":
            return None, "Legacy .doc files can't be read; save the file as DOCX"
        return None, f"Unsupported file type: {ext}"
    except Exception as e:  # an unreadable file is a row, not a failed job
        return None, f"{type(e).__name__}: {e}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name, ext, size, text, error of every file under a path or glob; files of no bytes, which the scan leaves out, have an
    error row too."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for i in range(batch.num_rows):
                name, content = batch.column("name")[i].as_py(), batch.column("content")[i].as_py()
                text, error = parse(name, content)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([name.rsplit(".", 1)[-1].lower() if "." in name else ""]), batch.column("length").slice(i, 1), pa.array([text], pa.string()), pa.array([error], pa.string())], ["name", "ext", "size", "text", "error"])

    schema = "name string, ext string, size long, text string, error string"
    return rows.mapInArrow(run, schema).union(_empty_files(spark, path, schema))


def _empty_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Error rows of the files of no bytes, from the listing that the scan makes as well."""
    sc, rows = spark.sparkContext, []
    pattern = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = pattern.getFileSystem(sc._jsc.hadoopConfiguration())
    for status in fs.globStatus(pattern) or ():
        files = fs.listFiles(status.getPath(), True)
        while files.hasNext():
            file = files.next()
            name = file.getPath().getName()
            if not file.getLen() and name[:1] not in "._":
                rows.append((name, name.rsplit(".", 1)[-1].lower() if "." in name else "", 0, None, "File is empty"))
    return spark.createDataFrame(rows, schema)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """name, size, text of plain text files, whole and trimmed, without a Python worker."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    return rows.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"), T.trimmed(F.col("value")).alias("text"))


def validated(files: DataFrame) -> DataFrame:
    """file_id, valid, reason of each row of parsed_files: the extension (of the name, if ext is null) must be accepted and the
    size above 0; a null size counts as 0."""
    ext = F.lower(F.coalesce("ext", extension(F.col("name")), F.lit("")))
    reason = F.when(~ext.isin(*ACCEPTED), F.concat(F.lit("Unsupported file type: "), ext)).when(F.coalesce("size", F.lit(0)) == 0, "File is empty")
    return files.select("file_id", reason.isNull().alias("valid"), F.coalesce(reason, F.lit("")).alias("reason")).distinct()


def dispatched(files: DataFrame) -> DataFrame:
    """ext, n, parsed, failed, chars of parsed_files: by kind of file, what became of it. Repeated rows count once, by their
    latest receipt."""
    latest = files.groupBy("file_id").agg(F.max(F.struct("received_at", "name", "ext", "text", "error")).alias("r")).select("file_id", "r.*")
    ext = F.lower(F.coalesce("ext", extension(F.col("name")), F.lit("")))
    return latest.groupBy(ext.alias("ext")).agg(F.count("*").alias("n"), F.count("text").alias("parsed"), F.count("error").alias("failed"), F.coalesce(F.sum(F.length(T.trimmed(F.col("text")))), F.lit(0)).cast("long").alias("chars"))


def session_inputs(files: DataFrame, least: int = 50) -> DataFrame:
    """file_id, n_chars of the texts that are long enough to analyse when trimmed."""
    n = F.length(T.trimmed(F.col("text")))
    return files.filter(n >= least).select("file_id", n.cast("long").alias("n_chars")).distinct()


def corpus(files: DataFrame, removed: list[str] | None = None) -> DataFrame:
    """name, file_id: one file for each name (the first received, then the smallest id), without the removed names."""
    rows = files.filter("name is not null")
    if removed:
        rows = rows.filter(~F.col("name").isin(removed))
    return rows.groupBy("name").agg(F.min(F.struct("received_at", "file_id")).alias("f")).select("name", F.col("f.file_id").alias("file_id"))


def size_text(size: Column) -> Column:
    """1023 B, 1.5 KB, 2.0 MB; null counts as 0."""
    s = F.coalesce(size, F.lit(0)).cast("double")
    one = lambda x: F.format_string("%.1f", T.rounded(x, 1))
    return F.when(s < 1024, F.concat(s.cast("long").cast("string"), F.lit(" B"))).when(s < 1048576, F.concat(one(s / 1024), F.lit(" KB"))).otherwise(F.concat(one(s / 1048576), F.lit(" MB")))


def file_sizes(files: DataFrame) -> DataFrame:
    return files.select("file_id", size_text(F.col("size")).alias("size_text")).distinct()
