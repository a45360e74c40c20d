"""Connected components: each task ties its own edges first; few that are left are tied in one task, many by alternating large and small stars.

With many edges these stay distributed; lineage is cut by checkpoint().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Edges that a task ties at once: some 4 MB. The rounds of stars cost thousands of tasks, of which the driver keeps a record each.
AT_ONCE = 1 << 18


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each row's least known fellow, itself labelled by itself) after tying rows a to rows b."""
    while len(a):
        x, y = label[a], label[b]
        go = x != y
        if not go.any():
            break
        a, b, x, y = a[go], b[go], x[go], y[go]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            new = label[label]
            if (new == label).all():
                break
            label = new
    return label



def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (large: those above it; small: those below it, and itself) are tied to the least of them and itself."""
    both = edges.union(edges.select("b", "a")) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(least, "a")
    if large:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).where("a != b")


def _tied(batches, at_once: int, roots: bool):
    """(a, b): the nodes of each run of at_once edges or a batch more, with the least node that the run's edges reach; `roots`: those nodes too."""

    def tie(parts):
        a, b = (np.concatenate([x.column(c).to_numpy() for x in parts]) for c in "ab")
        node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = unite(np.arange(len(node)), at[: len(a)], at[len(a) :])
        go = np.arange(len(node)) if roots else np.flatnonzero(label != np.arange(len(node)))
        return pa.record_batch([pa.array(node[go]), pa.array(node[label[go]])], ["a", "b"])

    parts, held = [], 0
    for batch in batches:
        parts.append(batch)
        held += batch.num_rows
        if held >= at_once:
            yield tie(parts)
            parts, held = [], 0
    if held:
        yield tie(parts)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (columns a, b of one ordered type); root: the least node that it reaches.

    What each task's own edges tie is settled there. If no more than AT_ONCE edges are left, one task ties them. Else, a
    round costs a few shuffles of the edges; the number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    if isinstance(edges.schema["a"].dataType, IntegralType):
        most = AT_ONCE
        edges = edges.mapInArrow(lambda x: _tied(x, most, False), edges.schema).checkpoint()
        if edges.count() <= most:
            return edges.coalesce(1).mapInArrow(lambda x: _tied(x, most + 1, True), edges.schema).toDF("node", "root")
    edges = edges.distinct().checkpoint()
    state = None
    while True:
        edges = _stars(_stars(edges, True).distinct(), False).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    # every edge now ties a node to its root; roots are added
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
