"""Lines and markers: scans, reading order, sections, assignment, suppression of false markers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import LIMITS
from vellum.functions import text as T


def line_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, line_seq, text): the lines of each text that aren't blank, stripped; line_seq counts all lines from 0."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_seq", "raw"))
    return lines.select("doc_id", "line_seq", T.strip(F.col("raw")).alias("text")).where("text != ''")


def words_to_lines(words: DataFrame) -> DataFrame:
    """Recognised words (doc_id, page, block_num, par_num, line_num, word_num, top, left, width, height, conf, text) as lines with their boxes."""
    good = words.where((F.col("conf") >= 0) & (T.strip(F.col("text")) != ""))
    order = F.array_sort(F.collect_list(F.struct("word_num", "left", F.trim("text").alias("text"))))
    return good.groupBy("doc_id", "page", "block_num", "par_num", "line_num").agg(
        F.array_join(F.transform(order, lambda w: w["text"]), " ").alias("text"),
        F.min("top").alias("y_top"), F.greatest(F.max(F.col("top") + F.col("height")), F.min("top") + 1).alias("y_bottom"),
        F.min("left").alias("x_left"), F.greatest(F.max(F.col("left") + F.col("width")), F.min("left") + 1).alias("x_right"),
    )


def page_confidence(words: DataFrame) -> DataFrame:
    """(doc_id, page, conf): the mean confidence of words that aren't blank and have one; none: 0."""
    counts = F.when((T.strip(F.col("text")) != "") & (F.col("conf") >= 0), F.col("conf"))
    return words.groupBy("doc_id", "page").agg(F.coalesce(F.avg(counts), F.lit(0.0)).alias("conf"))


def weak_pages(confidence: DataFrame, least: float) -> DataFrame:
    return confidence.where((F.col("conf") > 0) & (F.col("conf") < least))


def sticky_section(lines: DataFrame, header: Column, order: list[str]) -> DataFrame:
    """Marks what follows the first solutions header of a doc as solution; that header goes, later ones stay lines."""
    seen = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    flagged = lines.withColumn("_header", header)
    flagged = flagged.withColumn("is_solution", F.coalesce(F.max("_header").over(seen), F.lit(False)))
    return flagged.where(~(F.col("_header") & ~F.col("is_solution"))).drop("_header")


def strong_first(markers: DataFrame) -> DataFrame:
    """Where a doc's side has a strong marker, only strong ones."""
    side = Window.partitionBy("doc_id", "is_solution")
    return markers.withColumn("_any", F.max("is_strong").over(side)).where(F.col("is_strong") | ~F.col("_any")).drop("_any")


def assign(markers: DataFrame, lines: DataFrame, order: list[str]) -> DataFrame:
    """Lines with the marker that comes last at or before them in reading order, as q_num and marker_seq; lines before the first go."""
    a = markers.select("doc_id", *order, F.lit(0).alias("_kind"), F.struct("marker_seq", "q_num").alias("_m"), F.lit(None).cast("struct<x:int>").alias("_l"))
    rest = [c for c in lines.columns if c not in ("doc_id", *order)]
    a = a.drop("_l").withColumns({c: F.lit(None).cast(lines.schema[c].dataType) for c in rest})
    b = lines.withColumn("_kind", F.lit(1)).withColumn("_m", F.lit(None).cast(a.schema["_m"].dataType))
    w = Window.partitionBy("doc_id").orderBy(*order, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_at", F.last("_m", ignorenulls=True).over(w))
    return both.where("_kind = 1 and _at is not null").select(*lines.columns, "_at.marker_seq", "_at.q_num")


def segment_bounds(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """The box around each group's lines."""
    return assigned.groupBy(*keys).agg(F.min("y_top").alias("y_top"), F.max("y_bottom").alias("y_bottom"), F.min("x_left").alias("x_left"), F.max("x_right").alias("x_right"), F.count("*").alias("n_lines"))


def margin_clusters(values: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """(keys, cluster, margin, last, n): runs of x whose steps are at most `gap`; margin is the least."""
    w = Window.partitionBy(*keys).orderBy("x")
    stepped = values.withColumn("_new", F.coalesce((F.col("x") - F.lag("x").over(w) > gap).cast("int"), F.lit(0)))
    numbered = stepped.withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "cluster").agg(F.min("x").alias("margin"), F.max("x").alias("last"), F.count("*").alias("n"))


def drop_numbered_options(markers: DataFrame, limits=LIMITS) -> DataFrame:
    """Drops weak markers indented past the margin of their column, where numbers too large for an option set a margin."""
    keys = ["doc_id", "page", "is_solution"]
    anchors = markers.where(~F.col("is_strong") & (T.first_number(F.col("q_num")) >= limits.anchor_number)).select(*keys, F.col("x_left").alias("x"))
    margins = margin_clusters(anchors, keys, limits.margin_gap).groupBy(*keys).agg(F.array_sort(F.collect_list("margin")).alias("_margins"))
    x, m = F.col("x_left"), F.col("_margins")
    own = F.coalesce(F.array_max(F.filter(m, lambda v: x >= v - limits.option_indent)), m[0])
    kept = F.col("is_strong") | m.isNull() | (x <= own + limits.option_indent)
    return markers.join(margins, keys, "left").where(kept).drop("_margins")


def drop_key_cells(markers: DataFrame, lines: DataFrame, limits=LIMITS) -> DataFrame:
    """Drops markers on rows that hold several answer-key cells."""
    rows = lines.where(T.is_key_cell(F.col("text"))).groupBy("doc_id", "page", F.bround(F.col("y_top") / limits.key_bucket).cast("long").alias("_row")).agg(F.count("*").alias("n"), F.min("y_top").alias("_top"), F.max("y_bottom").alias("_bottom")).where(F.col("n") >= limits.key_cells)
    bands = rows.select("doc_id", "page", "_top", "_bottom")
    on = [markers.doc_id == bands.doc_id, markers.page == bands.page, markers.y_top.between(bands._top - limits.key_band, bands._bottom + limits.key_band)]
    return markers.join(bands, on, "left_anti")


def dedup_consecutive(markers: DataFrame, limits=LIMITS) -> DataFrame:
    """Keeps a marker unless the last kept one of the doc has its number, side and page and is under `dedup_y` away.

    A chain is judged against the last row kept, not the row before, so a doc's markers are folded in order.
    """
    schema = markers.schema

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        keep, last = [], None
        for r in pdf.sort_values(["page", "y_top", "marker_seq"]).itertuples():
            if last is None or (r.page, r.q_num, r.is_solution) != (last.page, last.q_num, last.is_solution) or abs(r.y_top - last.y_top) >= limits.dedup_y:
                keep.append(r.Index)
                last = r
        return pdf.loc[keep]

    return markers.groupBy("doc_id").applyInPandas(fold, schema)


def wanted_numbers(known: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(doc_id, is_solution, num) worth looking for: the key's numbers that no question has, or, without a key, the few holes of a run.

    known (doc_id, is_solution, num). A run has three numbers or more; its holes count if they are at most three or a third
    of its span.
    """
    sides = known.groupBy("doc_id", "is_solution").agg(F.collect_set("num").alias("have"), F.min("num").alias("low"), F.max("num").alias("high"))
    if expected is not None:
        keys = expected.groupBy("doc_id").agg(F.collect_set(F.col("num").cast("int")).alias("key"))
        sides = sides.join(keys.withColumn("is_solution", F.lit(False)), ["doc_id", "is_solution"], "full").withColumn("have", F.coalesce("have", F.array().cast("array<int>")))
    else:
        sides = sides.withColumn("key", F.lit(None).cast("array<int>"))
    holes = F.when(F.size("have") >= 3, F.array_except(F.sequence("low", "high"), "have")).otherwise(F.array().cast("array<int>"))
    few = F.when(F.size(holes) <= F.greatest(F.lit(3), F.floor((F.col("high") - F.col("low")) / 3)), holes)
    return sides.select("doc_id", "is_solution", F.explode(F.when(F.size("key") > 0, F.array_except("key", "have")).otherwise(few)).alias("num"))


def recover_markers(markers: DataFrame, lines: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Markers whose number was misread: for each missing number the first line between its neighbours that reads as it.

    `expected` (doc_id, num) names the questions that an answer key has. Candidates, the lines that read as a wanted
    number, come from a join; a doc's side folds only these, in an expression, as a marker found is a neighbour for the
    next number. A number without a known one beside it is bounded by the nearest known on each side. Markers without a number
    and texts that are null take no part; an empty table gives an empty one.
    """
    doc = F.col("doc_id").cast("string").alias("doc_id")
    place = F.struct("page", F.col("y_top").cast("double").alias("y"))
    known = markers.select(doc, "is_solution", T.first_number(F.col("q_num")).alias("num"), "marker_seq", place.alias("place")).where("num is not null")
    known = known.groupBy("doc_id", "is_solution", "num").agg(F.min_by("place", "marker_seq").alias("place"))
    wanted = wanted_numbers(known.select("doc_id", "is_solution", "num"), None if expected is None else expected.select(doc, "num"))
    spot = "struct<page:int,y:double>"
    line = "struct<line_seq:int,page:int,y:double,x_left:double,x_right:double>"
    fields = F.struct(*[F.col(c) for c in ("line_seq", "page", "y_top", "x_left", "x_right")]).cast(line)
    body = lines.select(doc, fields.alias("line"), F.explode(T.readings(F.col("text"))).alias("num"))
    spots = body.join(wanted, ["doc_id", "num"]).groupBy("doc_id", "is_solution", "num").agg(F.sort_array(F.collect_list("line")).alias("spots"))
    open_ = spots.groupBy("doc_id", "is_solution").agg(F.sort_array(F.collect_list(F.struct("num", "spots"))).alias("open"))
    places = known.groupBy("doc_id", "is_solution").agg(F.map_from_entries(F.collect_list(F.struct("num", F.col("place").cast(spot)))).alias("at"))
    state = f"struct<at:map<int,{spot}>,out:array<struct<num:int,line:{line}>>>"

    def let(value: F.Column, body) -> F.Column:
        return F.transform(F.array(value), body)[0]

    def step(acc: F.Column, g: F.Column) -> F.Column:
        n, at = g["num"], acc["at"]

        def taken(bounds: F.Column) -> F.Column:
            def here(s: F.Column) -> F.Column:
                place = F.struct(s["page"].alias("page"), s["y"].alias("y"))
                return (bounds["low"].isNull() | (place > bounds["low"])) & (bounds["high"].isNull() | (place < bounds["high"]))

            found = F.when(bounds["low"].isNotNull() | bounds["high"].isNotNull(), F.get(F.filter(g["spots"], here), F.lit(0)))
            more = lambda x: F.struct(F.map_concat(at, F.create_map(n, F.struct(x["page"].alias("page"), x["y"].alias("y")).cast(spot))).alias("at"), F.concat(acc["out"], F.array(F.struct(n.alias("num"), x.alias("line")))).alias("out")).cast(state)
            return let(found, lambda x: F.when(x.isNull(), acc).otherwise(more(x)))

        beside = F.struct(F.try_element_at(at, n - 1).alias("low"), F.try_element_at(at, n + 1).alias("high"))
        nearest = F.struct(F.try_element_at(at, F.array_max(F.filter(F.map_keys(at), lambda k: k < n))).alias("low"), F.try_element_at(at, F.array_min(F.filter(F.map_keys(at), lambda k: k > n))).alias("high"))
        return let(F.when(beside["low"].isNull() & beside["high"].isNull(), nearest).otherwise(beside), taken)

    begin = F.struct(F.col("at"), F.array().alias("out")).cast(state)
    found = open_.join(places, ["doc_id", "is_solution"]).select("doc_id", "is_solution", F.aggregate("open", begin, step, lambda acc: acc["out"]).alias("out"))
    return found.select("doc_id", "is_solution", F.inline("out")).select("doc_id", "line.page", F.col("line.y").alias("y_top"), F.col("num").cast("string").alias("q_num"), "is_solution", "line.x_left", "line.x_right", F.lit(False).alias("is_strong"))


def batches(pages: DataFrame, size: int = 4, overlap: int = 1) -> DataFrame:
    """(doc_id, batch, first, last): hopping windows of pages 1 to n_pages of each doc."""
    step = size - overlap if size > overlap else size
    starts = F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1, F.lit(step)))
    return pages.where("n_pages > 0").select("doc_id", "n_pages", starts.alias("_s")).select("doc_id", (F.col("_s") / step).cast("int").alias("batch"), (F.col("_s") + 1).alias("first"), F.least(F.col("_s") + size, F.col("n_pages")).alias("last"))


def running_ceiling(files: DataFrame, limit: int) -> DataFrame:
    """Files (session_id, seq, bytes) up to the first with which the running sum passes the limit."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("total", F.sum("bytes").over(w)).where(F.col("total") <= limit)


def iterate(batches_: Iterator[pd.DataFrame], parse) -> Iterator[pd.DataFrame]:
    """mapInPandas body for a source adapter: parse(row) gives rows, and never fails the job."""
    for pdf in batches_:
        out = []
        for r in pdf.itertuples():
            try:
                out += [{**x, "status": "ok", "error": ""} for x in parse(r)]
            except Exception as e:  # the status column carries it
                out.append({"doc_id": r.doc_id, "status": "failed", "error": str(e)[:200]})
        yield pd.DataFrame(out)


def page_percent(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, y0, y1, x0, x1) in percent of the page: lines (y_top, y_bottom, x_left, x_right, text) that aren't blank, on pages with a size."""
    sized = pages.where("width > 0 and height > 0").select("doc_id", "page", "width", "height")
    of = lambda v, whole: (F.col(v) / F.col(whole) * 100.0)
    return lines.where(T.strip(F.col("text")) != "").join(sized, ["doc_id", "page"]).select("doc_id", "page", of("y_top", "height").alias("y0"), of("y_bottom", "height").alias("y1"), of("x_left", "width").alias("x0"), of("x_right", "width").alias("x1"))
