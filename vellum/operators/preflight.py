"""Checks of a document before print: sizes, fonts, resolution, colour, text layer; source validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.geometry import size_label

#: Named page sizes in points.
SIZES = {"a3": (841.89, 1190.55), "a4": (595.28, 841.89), "a5": (419.53, 595.28), "letter": (612.0, 792.0), "legal": (612.0, 1008.0), "square": (612.0, 612.0)}


def mode_size(pages: DataFrame) -> DataFrame:
    """(doc_id, width, height): the commonest size to the nearest point, the larger of equals, as its first page has it."""
    w, h = F.bround("width").cast("int"), F.bround("height").cast("int")
    groups = pages.groupBy("doc_id", w.alias("w"), h.alias("h")).agg(F.count("*").alias("n"), F.min(F.struct("page", "width", "height")).alias("first"))
    rank = Window.partitionBy("doc_id").orderBy(F.desc("n"), F.desc(F.col("w") * F.col("h")), F.col("first.page"))
    return groups.withColumn("_r", F.row_number().over(rank)).where("_r = 1").select("doc_id", "first.width", "first.height")


def largest_page(pages: DataFrame) -> DataFrame:
    """(doc_id, width, height) of the page with the largest area, the first of equals."""
    rank = Window.partitionBy("doc_id").orderBy(F.desc(F.col("width") * F.col("height")), "page")
    return pages.withColumn("_r", F.row_number().over(rank)).where("_r = 1").select("doc_id", "width", "height")


def target_size(pages: DataFrame, spec: str) -> DataFrame:
    """(doc_id, width, height) for auto, max, a named size turned as most pages are, or custom:WxH in millimetres; else the mode."""
    s = (spec or "auto").strip().lower()
    if s == "max":
        return largest_page(pages)
    if s in SIZES:
        w, h = SIZES[s]
        wide = F.sum((F.col("width") > F.col("height")).cast("int")) > F.count("*") / 2
        turn = F.lit(False) if s == "square" else wide
        return pages.groupBy("doc_id").agg(F.when(turn, h).otherwise(w).alias("width"), F.when(turn, w).otherwise(h).alias("height"))
    if s.startswith("custom:"):
        try:
            w, h = (float(x) * 72.0 / 25.4 for x in s[7:].split("x")[:2])
        except ValueError:
            w = h = 0.0
        if w > 0 and h > 0:
            return pages.select("doc_id").distinct().select("doc_id", F.lit(w).alias("width"), F.lit(h).alias("height"))
    return mode_size(pages)


def first_fonts(fonts: DataFrame) -> DataFrame:
    """Fonts of a doc, each xref and name once, as its first page has it."""
    rank = Window.partitionBy("doc_id", "xref", "basefont").orderBy("page")
    return fonts.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def dpi_bands(images: DataFrame, low: float = 72.0, fair: float = 150.0) -> DataFrame:
    """(doc_id, n, n_low, n_fair, min_dpi) of images with a dpi above zero."""
    d = F.col("dpi")
    return images.where(d > 0).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum((d < low).cast("int")).alias("n_low"), F.sum(((d >= low) & (d < fair)).cast("int")).alias("n_fair"), F.min(d).alias("min_dpi"))


def verdicts(checks: DataFrame) -> DataFrame:
    """(doc_id, verdict): the worst status of a doc's checks, of pass, warn and fail."""
    rank = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return checks.groupBy("doc_id").agg(rank.alias("r")).select("doc_id", F.when(F.col("r") == 2, "fail").when(F.col("r") == 1, "warn").otherwise("pass").alias("verdict"))


def has_text(pages: DataFrame, first: int = 3, more_than: int = 100) -> DataFrame:
    """(doc_id, searchable): whether the first pages hold more characters than that, white space around each page aside."""
    n = F.sum(F.when(F.col("page") <= first, F.length(T.strip(F.col("text")))).otherwise(0))
    return pages.groupBy("doc_id").agg((n > more_than).alias("searchable"))


def rejects(files: DataFrame, max_bytes: int, max_pages: int) -> DataFrame:
    """Files (doc_id, head binary, length, n_pages) with the reason they are refused, or null: too_large, not_pdf, no_pages, too_many_pages."""
    reason: Column = F.when(F.col("length") > max_bytes, "too_large").when(~F.coalesce(F.substring("head", 1, 4).cast("string") == "%PDF", F.lit(False)), "not_pdf").when(F.col("n_pages") < 1, "no_pages").when(F.col("n_pages") > max_pages, "too_many_pages")
    return files.withColumn("reason", reason)


def placement(pages: DataFrame, target: DataFrame, stretch: bool = False, tol: float = 1.0) -> DataFrame:
    """(doc_id, page, x0, y0, x1, y1, moved): where a page's content lies on the target size, centred and to scale unless stretched."""
    t = target.select("doc_id", F.col("width").alias("tw"), F.col("height").alias("th"))
    j = pages.join(t, "doc_id")
    k = F.least(F.col("tw") / F.col("width"), F.col("th") / F.col("height"))
    w, h = (F.col("tw"), F.col("th")) if stretch else (F.col("width") * k, F.col("height") * k)
    same = (F.abs(F.col("width") - F.col("tw")) <= tol) & (F.abs(F.col("height") - F.col("th")) <= tol)
    return j.select("doc_id", "page", ((F.col("tw") - w) / 2).alias("x0"), ((F.col("th") - h) / 2).alias("y0"), ((F.col("tw") + w) / 2).alias("x1"), ((F.col("th") + h) / 2).alias("y1"), (~same).alias("moved"))


def report(files: DataFrame, fonts: DataFrame, images: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, check_id, status, n, worst, names): six checks of each of files (doc_id, encrypted); status ok, info, warn or fail.

    fonts (doc_id, page, xref, basefont, embedded), images (doc_id, dpi, colorspace), pages (doc_id, page, width, height,
    text). n counts what the status is about, worst is the least dpi of it, names the first few fonts or sizes. Nulls: a
    file isn't encrypted, a font isn't embedded, an image has no dpi and no colour space. Docs that only the other tables
    have are left out. One row for each doc meets the next table, whatever its number of pages.
    """
    loose = ~F.coalesce("embedded", F.lit(False))
    few = lambda c, n: F.array_join(F.slice(F.array_sort(F.collect_set(c)), 1, n), ", ")
    f = first_fonts(fonts).groupBy("doc_id").agg(F.count("*").alias("n_fonts"), F.count_if(loose).alias("n_loose"), few(F.when(loose, F.col("basefont")), 6).alias("loose"))
    d = F.when(F.col("dpi") > 0, F.col("dpi"))
    rgb = F.lower(F.coalesce("colorspace", F.lit(""))).contains("rgb")
    i = images.groupBy("doc_id").agg(F.count("*").alias("n_images"), F.count_if(d < 72).alias("n_low"), F.count_if((d >= 72) & (d < 150)).alias("n_fair"), F.min(d).alias("least"), F.count_if(rgb).alias("n_rgb"))
    size = size_label(F.col("width"), F.col("height"))
    p = pages.groupBy("doc_id").agg(F.count_distinct(size).alias("n_sizes"), few(size, 4).alias("sizes"))
    wide = files.select("doc_id", F.coalesce("encrypted", F.lit(False)).alias("encrypted"))
    for t in (f, i, p, has_text(pages, 5, 50)):
        wide = wide.join(t, "doc_id", "left")
    wide = wide.fillna(0, ["n_fonts", "n_loose", "n_images", "n_low", "n_fair", "n_rgb", "n_sizes"]).fillna("", ["loose", "sizes"]).fillna(False, ["searchable"])

    def check(name: str, status: Column, n: Column, worst: Column | None = None, names: Column | None = None) -> Column:
        worst, names = F.lit(None) if worst is None else worst, F.lit("") if names is None else names
        return F.struct(F.lit(name).alias("check_id"), status.alias("status"), n.cast("long").alias("n"), worst.cast("double").alias("worst"), names.alias("names"))

    c = F.col
    poor = (c("n_low") > 0) | (c("n_fair") > 0)
    rows = F.array(
        check("encryption", F.when(c("encrypted"), "fail").otherwise("ok"), c("encrypted").cast("int")),
        check("fonts_embedded", F.when(c("n_loose") > 0, "fail").when(c("n_fonts") > 0, "ok").otherwise("info"), F.when(c("n_loose") > 0, c("n_loose")).otherwise(c("n_fonts")), names=c("loose")),
        check("image_dpi", F.when(c("n_low") > 0, "fail").when(c("n_fair") > 0, "warn").when(c("n_images") > 0, "ok").otherwise("info"), F.when(c("n_low") > 0, c("n_low")).when(c("n_fair") > 0, c("n_fair")).otherwise(c("n_images")), F.when(poor, c("least"))),
        check("colorspace", F.when(c("n_rgb") > 0, "warn").otherwise("ok"), c("n_rgb")),
        check("page_sizes", F.when(c("n_sizes") > 1, "warn").otherwise("ok"), c("n_sizes"), names=c("sizes")),
        check("text_layer", F.when(c("searchable"), "ok").otherwise("info"), c("searchable").cast("int")),
    )
    return wide.select("doc_id", F.inline(rows))
