"""Sources: binary documents, manifests, cached keys, model output; parsers plug in as row functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.lines import iterate

LINE_SCHEMA = "doc_id string, page int, line_seq int, y_top double, y_bottom double, x_left double, x_right double, text string, status string, error string"


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, head, length, content): files as they are; head is their first bytes."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.substring("content", 1, 8).alias("head"), "length", "content")


def parsed_lines(files: DataFrame, parse: Callable) -> DataFrame:
    """Lines by a parser (row to dicts), one file at a time; a file that fails is a row with status and error."""
    columns = [c.split()[0] for c in LINE_SCHEMA.split(", ")]

    def run(batches):
        for pdf in iterate(batches, parse):
            yield pdf.reindex(columns=columns)

    return files.mapInPandas(run, LINE_SCHEMA)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, seq, stored, original) of JSON lines with these fields; blank lines are skipped."""
    return spark.read.schema("session_id string, seq int, stored string, original string").json(path)


def cached_key(rows: DataFrame) -> DataFrame:
    """(doc_id, num, letter) of cached JSON maps (doc_id, json); a bad file is an empty key, a key that is no number is dropped."""
    read = rows.select("doc_id", F.explode(F.from_json("json", "map<string,string>")).alias("k", "letter"))
    return read.select("doc_id", F.col("k").try_cast("int").alias("num"), "letter").where("num is not null")


def joined_text(lines: DataFrame) -> DataFrame:
    """(doc_id, text): a doc's lines in order, joined by newlines."""
    order = F.array_sort(F.collect_list(F.struct("page", "line_seq", "text")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(order, lambda x: x["text"]), "\n").alias("text"))


def model_items(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Items of a vision model's JSON (doc_id, json): segments on pages first to last, 0 to 100 percent, end after start; blank numbers and empty items go."""
    shape = "array<struct<q_num:string,is_solution:boolean,segments:array<struct<page:int,y_start:double,y_end:double,x_start:double,x_end:double>>>>"
    read = rows.select("doc_id", F.posexplode(F.from_json(T.strip_fences(F.col("json")), shape)).alias("item_seq", "i"))
    good = F.filter("i.segments", lambda s: s["page"].between(first, last) & (s["y_start"] >= 0) & (s["y_end"] <= 100) & (s["y_end"] > s["y_start"]))
    return read.select("doc_id", "item_seq", T.strip(F.col("i.q_num")).alias("q_num"), F.coalesce("i.is_solution", F.lit(False)).alias("is_solution"), good.alias("segments")).where("q_num != '' and size(segments) > 0")


def name_list(spark: SparkSession, names: list[str], session: str = "inline") -> DataFrame:
    """(session_id, seq, original) of the names that aren't blank."""
    rows = [(session, i, n) for i, n in enumerate(x for x in names if x and x.strip())]
    return spark.createDataFrame(rows, "session_id string, seq int, original string")
