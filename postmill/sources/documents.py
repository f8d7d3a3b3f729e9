"""Uploaded documents to text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.sources.pdf import pdf_text


def is_pdf(path: str, content_type: str | None = None) -> bool:
    return path.lower().endswith(".pdf") or content_type == "application/pdf"


@F.arrow_udf(T.StringType())
def _pdfs(content: pa.Array) -> pa.Array:
    return pa.array([None if c is None else pdf_text(c) for c in content.to_pylist()], pa.string())


def read_documents(spark: SparkSession, path: str, content_type: str | None = None) -> DataFrame:
    """(path, text) of files: PDF files by their suffix or the content type they were sent with, others as UTF-8."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    pdf = F.lower("path").endswith(".pdf") | F.lit(content_type == "application/pdf")
    plain = files.where(~pdf).select("path", F.decode("content", "UTF-8").alias("text"))
    return plain.unionByName(files.where(pdf).select("path", _pdfs("content").alias("text")))
