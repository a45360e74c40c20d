"""Labelled rows for fitting: which may be learned from, bounded samples of them, and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import narrow

#: Labelled ids up to this many (some 50 MB in memory) are sent to the texts; with more, the texts are shuffled to them.
SENT_LABELS = 1 << 20


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo `divisor`; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def training(labels: DataFrame, name: str, divisor: int, held_out: int) -> DataFrame:
    """(doc_id, y) of rows with a label 0 or 1 that aren't held out; a doc_id with both labels has the larger."""
    y = F.col(f"`{name}`").cast("int")
    return labels.select("doc_id", y.alias("y")).where(F.col("y").isin(0, 1) & (remainder(divisor) != held_out)).groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_texts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """docs (doc_id, text) that are labelled, with y."""
    small = train.limit(SENT_LABELS + 1).count() <= SENT_LABELS
    return narrow(docs, "doc_id", "text").join(train.hint("broadcast" if small else "shuffle_hash"), "doc_id")


def sample(train: DataFrame, most: dict[int, int]) -> DataFrame:
    """At most most[y] rows of each label, those with the smallest hash of doc_id."""
    parts = [train.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in most.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def bounded_sample(docs: DataFrame, labels: DataFrame, name: str, divisor: int, held_out: int, most: dict[int, int], most_bytes: int) -> DataFrame:
    """(doc_id, text, y): texts of at most most[y] ids of each label and of most_bytes in all of each, in order of a hash of doc_id.

    An id whose texts alone go beyond what is left is passed over. Sizes of at most that many ids come to the driver.
    """
    docs = narrow(docs, "doc_id", "text")
    joined = docs.join(F.broadcast(sample(training(labels, name, divisor, held_out), most)), "doc_id")
    sizes = joined.groupBy("doc_id", "y").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"))
    held, kept, out = dict.fromkeys(most, 0), [], 0
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if held[r.y] + r.n <= most_bytes:
            held[r.y] += r.n
            kept.append((r.doc_id, r.y))
        else:
            out += 1
    if not out:
        return joined
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.join(F.broadcast(docs.sparkSession.createDataFrame(kept, f"doc_id {kind}, y int")), "doc_id")
