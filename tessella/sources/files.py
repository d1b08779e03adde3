"""File sources and sinks (S1-S9, K1, K6, K7): folders of texts as tables with explicit names and error columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.latex import strip_latex
from tessella.functions.text import content_hash, drop_cids, header_fields, label, lines, strip

POSTING_SUFFIXES = (".txt", ".md")
RESUME_SUFFIXES = (".pdf", ".tex", ".txt")


class SourceError(ValueError):
    """A whole-run fault of a source: a folder that is missing or has no usable file."""


def _files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, file_name, stem, suffix, content): the folder's own files by suffix without regard to case."""
    try:
        raw = spark.read.format("binaryFile").load(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise SourceError(f"no such folder: {folder}") from e
        raise
    named = raw.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
    parts = named.withColumn("suffix", F.lower(F.regexp_extract("file_name", r"(\.[^.]+)$", 1))).withColumn("stem", F.regexp_replace("file_name", r"\.[^.]+$", ""))
    return parts.where(F.col("suffix").isin(*suffixes))


def read_postings(spark: SparkSession, folder: str) -> DataFrame:
    """S1, S2, P1, P2, P3, A21, T-10: one row per posting that is not blank; line ends as LF before hashing."""
    rows = _files(spark, folder, POSTING_SUFFIXES).select(F.col("stem").alias("slug"), "path", "file_name", _decoded().alias("text")).where(F.length(strip("text")) > 0)
    if rows.isEmpty():
        raise SourceError(f"no posting in {folder}")
    return postings_of(rows)


def read_jobs(spark: SparkSession, names: list[str]) -> DataFrame:
    """(job_id, text) of the files that are named, or of standard input for ``-``. A blank one is an error."""
    import sys

    parts = []
    if "-" in names:
        parts.append(spark.createDataFrame([("stdin", sys.stdin.read())], "job_id string, text string"))
    if files := [n for n in names if n != "-"]:
        try:
            raw = spark.read.format("binaryFile").load(files)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise SourceError(f"no such file: {', '.join(files)}") from e
            raise
        parts.append(raw.select(F.element_at(F.split("path", "/"), -1).alias("job_id"), _decoded().alias("text")))
    rows = reduce(DataFrame.unionByName, parts)
    if blank := [r["job_id"] for r in rows.where(F.length(strip("text")) == 0).select("job_id").collect()]:
        raise SourceError(f"empty: {', '.join(blank)}")
    return rows


def _decoded() -> Column:
    """The content as text: by its byte order mark (UTF-16 either way, UTF-8), else UTF-8 if it is that, else Windows-1252."""
    mark = F.hex(F.substring("content", 1, 2))
    wide = mark.isin("FFFE", "FEFF")
    text = F.when(wide, F.decode("content", "UTF-16")).when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "windows-1252"))
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")


def postings_of(rows: DataFrame, slug: str = "slug", text: str = "text") -> DataFrame:
    """Posting fields for any table with a slug and a text."""
    fields = rows.withColumn("_lines", lines(text)).withColumn("_f", header_fields("_lines", slug)).drop("_lines")
    return fields.select("*", "_f.title", "_f.company", "_f.location", label("_f.title", "_f.company").alias("label"), content_hash(text).alias("content_hash")).drop("_f")


def read_pdf(content: bytes) -> str:
    """Page texts joined by line ends. The parser is optional and imported here only."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return "\n".join(page.extract_text() or "" for page in pdf.pages)


def extract_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, text, error). A file that fails is a row with an error; if all fail, ``SourceError``."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            errors: list[str | None] = []
            for suffix, content in zip(batch.column("suffix").to_pylist(), batch.column("content").to_pylist()):
                try:
                    text = read_pdf(content) if suffix == ".pdf" else (content or b"").decode("utf-8-sig", "replace").replace("\r\n", "\n").replace("\r", "\n")
                    text = strip_latex(text) if suffix == ".tex" else text
                    if not text.strip():
                        raise ValueError("no text; a scanned document needs character recognition first")
                    texts.append(text)
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:300])
            yield pa.RecordBatch.from_arrays([batch.column("file_name"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["file_name", "text", "error"])

    rows = _files(spark, folder, RESUME_SUFFIXES).select("file_name", "suffix", "content").mapInArrow(extract, "file_name string, text string, error string")
    rows = rows.withColumn("text", drop_cids("text"))
    if rows.where("error IS NULL").isEmpty():
        raise SourceError(f"no readable document in {folder}")
    return rows


def latex_texts(sources: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with LaTeX sources as plain text; a null source stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([None if t is None else strip_latex(t) for t in batch.column(text).to_pylist()], pa.string())], [key, text])

    return sources.select(key, text).mapInArrow(run, f"{key} {dict(sources.dtypes)[key]}, {text} string")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Chunks (chunk_id, section, text) of a rendered profile; generated comment lines are dropped."""
    return profile_chunks(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))


def profile_chunks(profile: DataFrame, text: str = "text") -> DataFrame:
    """Entries of a profile in their order; the section is the last heading before (default GENERAL)."""
    from pyspark.sql import Window

    rows = profile.select(F.posexplode_outer(lines(text)).alias("line_no", "raw")).select("line_no", strip("raw").alias("line")).where((F.length("line") > 0) & ~F.col("line").startswith("# "))
    heading = F.nullif(F.regexp_extract("line", r"^==\s*(.+?)\s*==$", 1), F.lit(""))
    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)  # one profile: a document's lines
    marked = rows.withColumn("heading", heading).withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(w), F.lit("GENERAL")))
    kept = marked.where(F.col("heading").isNull()).select("line_no", "section", strip(F.regexp_replace("line", "^- ", "")).alias("text")).where(F.length("text") > 0)
    return kept.select((F.row_number().over(Window.orderBy("line_no")) - 1).alias("chunk_id"), "section", "text")


def append_ledger(calls: DataFrame, path: str) -> None:
    """K6: usage rows appended as JSON lines, costs rounded to 8 places."""
    calls.withColumn("cost_usd", F.round("cost_usd", 8)).write.mode("append").json(path)
