"""Sinks: answer sheets as CSV or JSON, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vellum.operators.answers import sheet_json


def answer_csv(sheet: DataFrame, path: str) -> None:
    """file,question,answer with a header, in a folder for each doc."""
    sheet.repartition("doc_id").sortWithinPartitions("doc_id", "file").write.mode("overwrite").partitionBy("doc_id").csv(path, header=True)


def answer_json(sheet: DataFrame, path: str) -> None:
    sheet_json(sheet).write.mode("overwrite").partitionBy("doc_id").text(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
