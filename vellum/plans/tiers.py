"""Tier choice: a doc takes the cheap result if it is dense and unbroken enough, else the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.session import cut


def gates(items: DataFrame, pages: DataFrame, least: float = 0.5, dense: float = 0.75, coverage: float = 0.8) -> DataFrame:
    """(doc_id, n_items, n_pages, sufficient, confident) for each doc of `pages` (doc_id, n_pages)."""
    num = F.when(~F.col("is_solution"), T.first_number(F.col("q_num")))
    agg = items.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.count(num).alias("c"), F.countDistinct(num).alias("d"), (F.max(num) - F.min(num) + 1).alias("span"))
    j = pages.join(agg, "doc_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    density = F.col("n_items") / F.col("n_pages")
    ok = F.col("n_pages") > 0
    run = (F.coalesce("c", F.lit(0)) < 3) | (F.col("d") / F.col("span") >= coverage)
    return j.select("doc_id", "n_items", "n_pages", F.when(ok, density >= least).otherwise(False).alias("sufficient"), F.when(ok & (F.col("n_items") > 0), (density >= max(least, dense)) & run).otherwise(False).alias("confident"))


def repair_pages(items: DataFrame, weak: DataFrame, repaired: DataFrame) -> DataFrame:
    """Items that touch no weak page (doc_id, page), and the repaired ones that do."""
    pages = F.transform("segments", lambda s: s["page"])
    bad = weak.groupBy("doc_id").agg(F.collect_set("page").alias("_weak"))

    def split(df: DataFrame, touching: bool) -> DataFrame:
        touch = F.coalesce(F.arrays_overlap(pages, F.col("_weak")), F.lit(False))
        return df.join(bad, "doc_id", "left").where(touch if touching else ~touch).drop("_weak")

    return split(items, False).unionByName(split(repaired, True))


def run_tiers(docs: DataFrame, tiers: list[tuple[str, Callable[[DataFrame], DataFrame]]], accept: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Items with `method`: each tier sees only docs that no tier before was accepted for.

    accept(items, docs) gives the doc_ids (column doc_id) that are done. A tier's items are kept by checkpoint(), so that
    a costly tier is not run again for the filter of the next.
    """
    out, left = None, docs
    for i, (name, tier) in enumerate(tiers):
        items = cut(tier(left))
        done = accept(items, left).select("doc_id").distinct() if i < len(tiers) - 1 else left.select("doc_id").distinct()
        kept = items.join(done, "doc_id", "left_semi").withColumn("method", F.lit(name))
        out = kept if out is None else out.unionByName(kept)
        left = left.join(done, "doc_id", "left_anti")
    return out
