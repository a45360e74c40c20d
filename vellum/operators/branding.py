"""Branding strips, figure filters, rules, fonts: predicates over scanned shapes, and the furniture of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.furniture import decorative_rules, merge_bands

#: Hosts of links, and phrases, that stand for an app or a site. Those of a publisher are parameters.
HOSTS = ("play.google.com", "apps.apple.com", "itunes.apple.com", "onelink.me", "bit.ly", "linktr.ee")
PHRASES = r"android\s*app|ios\s*app|download\s*app|play\s*store|app\s*store"
STRIP = r"(?i)^(?:page\s*)?\d{1,3}\s*(?:/|of)\s*\d{1,3}$"


def is_branding_text(text: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether the line has an app phrase or one of the publisher's patterns, anywhere."""
    return F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join([PHRASES, *more]))


def is_branding_uri(uri: Column, more: tuple[str, ...] = ()) -> Column:
    u = F.lower(F.coalesce(uri, F.lit("")))
    return F.exists(F.array(*map(F.lit, (*HOSTS, *more))), lambda h: F.contains(u, h))


def is_margin_strip(text: Column, top: Column, bottom: Column) -> Column:
    """Whether a page-number strip lies in the top 8 or from 80 percent down."""
    return T.strip(text).rlike(STRIP) & ((top <= 8.0) | (bottom >= 80.0))


def figure_images(images: DataFrame) -> DataFrame:
    """Images (doc_id, page, x0, y0, x1, y1, width, height) that aren't specks or in a margin."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    margin = (F.col("y1") / F.col("height") <= 0.07) | (F.col("y0") / F.col("height") >= 0.93)
    return images.where((w > 0) & (h > 0) & (w * h / (F.col("width") * F.col("height")) >= 0.0008) & ~margin)


def figure_clusters(clusters: DataFrame, lines: DataFrame) -> DataFrame:
    """Drawing clusters (doc_id, page, cluster_seq, box, width, height) of a figure's size that wrap little text.

    Over three lines inside, or text over 18 percent of the area, make it no figure.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sized = clusters.where((w >= 0.04 * F.col("width")) & (h >= 0.03 * F.col("height")) & ~((w >= 0.96 * F.col("width")) & (h >= 0.92 * F.col("height"))))
    c, t = sized.alias("c"), lines.alias("t")
    ix, iy = F.least("c.x1", "t.x1") - F.greatest("c.x0", "t.x0"), F.least("c.y1", "t.y1") - F.greatest("c.y0", "t.y0")
    inside = c.join(t, (F.col("c.doc_id") == F.col("t.doc_id")) & (F.col("c.page") == F.col("t.page")) & (ix > 0) & (iy > 0))
    area = (F.col("c.x1") - F.col("c.x0")) * (F.col("c.y1") - F.col("c.y0"))
    text = inside.groupBy("c.doc_id", "c.cluster_seq").agg(F.count("*").alias("_n"), (F.sum(ix * iy) / F.max(area)).alias("_share")).where("_n > 3 or _share > 0.18")
    return sized.join(text.select("doc_id", "cluster_seq"), ["doc_id", "cluster_seq"], "left_anti")


def outside_bands(figures: DataFrame, bands: DataFrame) -> DataFrame:
    """Figures that no branding band (doc_id, page, y0, y1) comes near, give or take 2 percent of the page's height."""
    f, b = figures.alias("f"), bands.alias("b")
    near = (F.col("f.y0") < F.col("b.y1") + 0.02 * F.col("f.height")) & (F.col("f.y1") > F.col("b.y0") - 0.02 * F.col("f.height"))
    return f.join(b, (F.col("f.doc_id") == F.col("b.doc_id")) & (F.col("f.page") == F.col("b.page")) & near, "left_anti")


def long_rules(strokes: DataFrame) -> DataFrame:
    """Strokes (doc_id, page, box, width, height) thin one way, at most 4 percent, and long the other, 18 percent or more; `horizontal` says which."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    v = (w <= 0.04 * F.col("width")) & (h >= 0.18 * F.col("height"))
    hor = (h <= 0.04 * F.col("height")) & (w >= 0.18 * F.col("width"))
    return strokes.where(((w > 0) | (h > 0)) & (v | hor)).withColumn("horizontal", hor)


def collect(links: DataFrame, lines: DataFrame, images: DataFrame, strokes: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, page, x0, y0, x1, y1) of a document's furniture: branding links and lines, page strips, images beside branding, decorative rules.

    All have doc_id, page, x0, y0, x1, y1, width, height; links a uri, lines a text.
    """
    box = ["doc_id", "page", "x0", "y0", "x1", "y1"]
    branded = links.where(is_branding_uri(F.col("uri")))
    at = [F.col(c) / F.col("height") * 100.0 for c in ("y0", "y1")]
    brand = is_branding_text(F.col("text"))
    furn = lines.where(T.strip(F.col("text")) != "").withColumn("_f", brand | is_margin_strip(F.col("text"), *at))
    scaled = branded.select("doc_id", "page", F.col("y0").alias("y0"), F.col("y1").alias("y1"))
    bands = merge_bands(scaled).union(furn.where(brand).select("doc_id", "page", "y0", "y1"))
    low = images.where(F.col("y1") - F.col("y0") < 0.6 * F.col("height"))
    beside = low.exceptAll(outside_bands(low, bands))
    rules = long_rules(strokes)
    kept = decorative_rules(rules.where("horizontal").select(*box), furn.where("not _f").select(*box), boxes.select(*box)).union(
        decorative_rules(rules.where("not horizontal").select(*box), furn.limit(0).select(*box), boxes.select(*box)))
    return branded.select(*box).union(furn.where("_f").select(*box)).union(beside.select(*box)).union(kept)


#: Built-in faces by serif, bold and italic.
FACES = {(0, 0, 0): "helv", (0, 1, 0): "hebo", (0, 0, 1): "heit", (0, 1, 1): "hebo", (1, 0, 0): "tiro", (1, 1, 0): "tibo", (1, 0, 1): "tiit", (1, 1, 1): "tibi"}


def font_alias(font: Column, flags: Column, aliases: dict[str, str] | None = None) -> Column:
    """The built-in face for a font: by name without subset prefix, else by style bits (2 italic, 4 serif, 16 bold)."""
    name = F.regexp_replace(F.lower(T.strip(font)), r"^[^+]*\+", "")
    out = F
    for k, v in (aliases or {}).items():
        out = out.when(name == k, v)
    for (serif, bold, italic), face in FACES.items():
        out = out.when((F.coalesce(flags, F.lit(0)).bitwiseAND(22)) == 2 * italic + 4 * serif + 16 * bold, face)
    return out


def packed_colour(colour: Column) -> Column:
    """The lower 24 bits; what is no number is 0."""
    return F.coalesce(colour.try_cast("long"), F.lit(0)).bitwiseAND(0xFFFFFF)


def editable_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, id, page, text, x0, y0, x1, y1, size, bold, italic): spans (doc_id, page, block, line, span, ...) that aren't blank.

    The id names page, block, line and span; bit 16 of flags is bold, bit 2 italic, null is neither. Places and sizes have two decimals.
    """
    ident = F.concat(*[x for k, c in (("p", "page"), ("_b", "block"), ("_l", "line"), ("_s", "span")) for x in (F.lit(k), F.col(c).cast("string"))])
    flag = lambda bit: F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(F.lit(bit)) != 0
    return spans.where(T.strip(F.col("text")) != "").select("doc_id", ident.alias("id"), "page", "text", *[F.bround(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1", "size")], flag(16).alias("bold"), flag(2).alias("italic"))
