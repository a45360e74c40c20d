"""Incremental ingestion of documents as they arrive (an extension): lines and markers over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.lines import line_scan


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def marker_stream(docs: DataFrame) -> DataFrame:
    """(doc_id, line_seq, q_num, is_strong): stateless, so each micro-batch is done once its files are read."""
    return line_scan(docs).select("doc_id", "line_seq", T.marker(F.col("text")).alias("m")).where("m is not null").select("doc_id", "line_seq", "m.*")


def append_lines(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends to Parquet; with its checkpoint each file is taken in once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
