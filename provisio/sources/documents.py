"""Documents from files: text, base64 and binary landing folders, JSON lines; a pluggable extractor for PDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.functions.text import strip

PAGE_CHARS, SCANNED_SHARE = 50, 0.5


def decoded(content: str) -> Column:
    """Bytes as text: UTF-8, bad bytes replaced."""
    return F.expr(f"make_valid_utf8(cast({content} AS string))")


def is_pdf(filename: Column, content: Column | None = None, content_type: Column | None = None) -> Column:
    """By content type, suffix or, where content is given, magic bytes."""
    out = F.lower(filename).endswith(".pdf")
    if content is not None:
        out = out | (F.substring(content, 1, 4) == F.lit(bytearray(b"%PDF")))
    if content_type is not None:
        out = out | (F.lower(content_type) == "application/pdf")
    return out


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """filename, content, content_hash of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.sha2("content", 256).alias("content_hash"))


def parse_text(files: DataFrame) -> DataFrame:
    """files with text (UTF-8, bad bytes replaced), title (the file's name) and page_count 1."""
    return files.withColumn("text", decoded("content")).withColumn("title", F.coalesce(F.nullif("filename", F.lit("")), F.lit("Text Input"))).withColumn("page_count", F.lit(1))


def parse_base64(files: DataFrame, column: str = "content_base64") -> DataFrame:
    """files with content and, where it is no PDF, its stripped text; what is not valid UTF-8 has a null text and status error."""
    content = files.withColumn("content", F.unbase64(column))
    text = F.expr("try_validate_utf8(cast(content AS string))")
    pdf = is_pdf(F.col("filename"), F.col("content"))
    return content.withColumn("text", F.when(~pdf, strip(text))).withColumn("status", F.when(pdf, "pdf").when(F.col("text").isNull(), "error").otherwise("ok"))


def parse_pdf(files: DataFrame, pages: Callable[[bytes], list[str]]) -> DataFrame:
    """filename, text, page_count, is_scanned: pages (bytes to page texts) is the extractor to plug in, called on executors, one file at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [pages(bytes(c)) for c in batch["content"]]
            poor = [sum(len(p.strip()) < PAGE_CHARS for p in t) for t in texts]
            yield pd.DataFrame({"filename": batch["filename"], "text": ["\n".join(t) for t in texts], "page_count": [len(t) for t in texts], "is_scanned": [n > SCANNED_SHARE * len(t) for n, t in zip(poor, texts, strict=True)]})

    return files.select("filename", "content").mapInPandas(run, "filename string, text string, page_count int, is_scanned boolean")


def read_golden(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema."""
    return spark.read.schema(schema).json(path)
