"""Documents from files: plain text, HTML, PDF and DOCX by extension, manifests, and summaries.

Files are read as bytes by the executors (one row a file) and decoded there; nothing passes through the driver.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.model import LoadError


class _Text(HTMLParser):
    """Stripped text nodes, one a line; comments and declarations are none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[str] = []

    def flush(self) -> None:
        if text := "".join(self.open).strip():
            self.parts.append(text)
        self.open = []

    def handle_starttag(self, tag, attrs):
        self.flush()

    def handle_endtag(self, tag):
        self.flush()

    def handle_startendtag(self, tag, attrs):
        self.flush()

    def handle_comment(self, data):
        self.flush()

    def handle_data(self, data):
        self.open.append(data)


def text_of_html(html: str) -> str:
    p = _Text()
    p.feed(html)
    p.close()
    p.flush()
    return "\n".join(p.parts)


def html_text(html: Column) -> Column:
    """Text of an HTML column."""
    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else text_of_html(t))

    return udf(html)


def decoded(raw: bytes) -> str:
    """UTF-8 (a byte order mark stays), or Latin-1 where the bytes are none."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def text_of_docx(raw: bytes) -> str:
    """Paragraphs of the body, one a line."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p") if body is not None else []:
        marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
        out.append("".join((t.text or "") if t.tag == f"{_W}t" else marks.get(t.tag, "") for t in p.iter()))
    return "\n".join(out)


def text_of_pdf(raw: bytes) -> str:
    try:
        import pdfplumber
    except ImportError as e:
        raise LoadError("PDF files need the pdfplumber library") from e
    with pdfplumber.open(io.BytesIO(raw)) as pdf:
        return "\n".join(t for t in (page.extract_text() for page in pdf.pages) if t)


LOADERS = {
    "txt": decoded, "text": decoded, "html": lambda b: text_of_html(decoded(b)), "htm": lambda b: text_of_html(decoded(b)), "docx": text_of_docx, "pdf": text_of_pdf,
}


def load_text(path: str, raw: bytes) -> str:
    """The text of one file's bytes; other extensions are plain text."""
    name = path.rsplit("/", 1)[-1]
    return LOADERS.get(name.rsplit(".", 1)[-1].lower() if "." in name else "", decoded)(raw)


def load_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, title, text, n_chars) for each file; the title is the file's name without its extension."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [load_text(p, bytes(c)) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "text": text})

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(read, "path string, text string")
    title = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    return files.select("path", title.alias("title"), "text", F.length("text").alias("n_chars"))


def load_manifest(spark: SparkSession, csv_path: str, base_dir: str | None = None) -> DataFrame:
    """(doc_id, title, text, author, genre, known) by a manifest of rows ``file,author[,genre]`` without a header.

    Paths are relative to base_dir, or to the manifest's folder. A row without an author is an unknown document; blank rows do not count.
    ``doc_id`` numbers the rows that count, from 0. Raises LoadError where a file is missing.
    """
    base = (base_dir or posixpath.dirname(csv_path) or ".").rstrip("/")
    with_rows = spark.read.csv(csv_path, schema="file string, author string, genre string", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    clean = lambda c: F.when(F.trim(c) != "", F.trim(c))
    rows = with_rows.select(*[clean(F.col(c)).alias(c) for c in ("file", "author", "genre")]).where("file IS NOT NULL").collect()  # a manifest lists files; it is no corpus
    if not rows:
        return spark.createDataFrame([], "doc_id long, title string, text string, author string, genre string, known boolean")
    listed = [(i, r[0] if "://" in r[0] or r[0].startswith("/") else f"{base}/{r[0]}", r[1], r[2]) for i, r in enumerate(rows)]
    plain = F.regexp_replace("path", "^file:/+", "/")
    try:
        files = load_documents(spark, *sorted({r[1] for r in listed}))
    except Exception as e:
        raise LoadError(f"a file of {csv_path} is missing") from e
    m = spark.createDataFrame([(i, posixpath.normpath(p) if "://" not in p else p, a, g) for i, p, a, g in listed], "doc_id long, path string, author string, genre string")
    got = m.join(files.withColumn("path", plain), "path")
    return got.select("doc_id", "title", "text", "author", "genre", F.col("author").isNotNull().alias("known"))


def summary(docs: DataFrame) -> DataFrame:
    """(author, n_docs, first_doc_id, preview): documents by author (null: unknown) and the first 60 characters of the first."""
    first = F.row_number().over(W.partitionBy("author").orderBy("doc_id"))
    n = F.count("*").over(W.partitionBy("author"))
    preview = F.substring(F.col("text"), 1, 60)
    return docs.select("author", "doc_id", preview.alias("preview"), n.alias("n_docs"), first.alias("r")).where("r = 1").select("author", "n_docs", F.col("doc_id").alias("first_doc_id"), "preview")


def corpus_counts(corpora: DataFrame, members: DataFrame) -> DataFrame:
    """``corpora`` (corpus_id, ...) with document_count, the rows of ``members`` (corpus_id, doc_id) that name each; 0 without any."""
    n = members.where("corpus_id IS NOT NULL").groupBy("corpus_id").agg(F.count("*").alias("document_count"))
    return corpora.join(n, "corpus_id", "left").fillna(0, ["document_count"])


def page(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a listing: ``limit`` rows after the first ``offset`` of that order, which should leave no ties."""
    if limit < 0 or offset < 0:
        raise LoadError("limit and offset must not be negative")
    return rows.orderBy(*order).offset(offset).limit(limit)


def import_sample_corpus(spark: SparkSession, manifest_path: str, corpus_id: str, target: str, base_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Copies one corpus of the catalogue to Parquet at ``target``, a folder for each role; returns its known and unknown documents, read from the copy."""
    sample_corpus(spark, manifest_path, corpus_id, base_dir).withColumn("role", F.when(F.col("known"), "known").otherwise("unknown")).write.partitionBy("role").mode("errorifexists").parquet(target)
    got = spark.read.parquet(target)
    return tuple(got.where(F.col("role") == role).drop("role") for role in ("known", "unknown"))


def sample_corpora(spark: SparkSession, manifest_path: str) -> DataFrame:
    """(id, name, description, n_known, n_unknown, n_authors) of a JSON catalogue of corpora."""
    schema = "id string, name string, description string, known array<struct<file:string,author:string>>, unknown array<struct<file:string,true_author:string>>"
    c = spark.read.json(manifest_path, schema=schema, multiLine=True)
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    return c.select("id", "name", "description", size("known").alias("n_known"), size("unknown").alias("n_unknown"), F.size(F.array_distinct("known.author")).alias("n_authors"))


def sample_corpus(spark: SparkSession, manifest_path: str, corpus_id: str, base_dir: str | None = None) -> DataFrame:
    """(doc_id, title, text, author, genre, known, true_author) of one corpus of the catalogue; the true author NONE is null."""
    schema = "id string, known array<struct<file:string,author:string>>, unknown array<struct<file:string,true_author:string>>"
    found = spark.read.json(manifest_path, schema=schema, multiLine=True).where(F.col("id") == corpus_id).collect()
    if not found:
        raise LoadError(f"no corpus named {corpus_id}")
    base = (base_dir or posixpath.dirname(manifest_path)).rstrip("/")
    rows = [(r["file"], r["author"], None, True) for r in found[0]["known"] or []] + [(r["file"], None, None if r["true_author"] == "NONE" else r["true_author"], False) for r in found[0]["unknown"] or []]
    m = spark.createDataFrame([(i, posixpath.normpath(f"{base}/{f}"), a, t, k) for i, (f, a, t, k) in enumerate(rows)], "doc_id long, path string, author string, true_author string, known boolean")
    files = load_documents(spark, *sorted({posixpath.normpath(f"{base}/{f}") for f, *_ in rows})).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return m.join(files, "path").select("doc_id", "title", "text", "author", F.lit(None).cast("string").alias("genre"), "known", "true_author")
