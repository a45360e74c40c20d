"""Batch renames, archives and compression rungs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T


def _suffixed(df: DataFrame, name: str) -> DataFrame:
    """Later rows of a session with the same name get _2, _3 ...; a name so made is not itself taken into account."""
    r = F.row_number().over(Window.partitionBy("session_id", name).orderBy("seq"))
    split = T.split_extension(F.col(name))
    ext = F.when(split["ext"] != "", F.concat(F.lit("."), split["ext"])).otherwise("")
    return df.withColumn("_r", r).withColumn(name, F.when(F.col("_r") > 1, F.concat(split["stem"], F.lit("_"), F.col("_r").cast("string"), ext)).otherwise(F.col(name))).drop("_r")


def plan_renames(files: DataFrame, pattern: str, start: int = 1, padding: int = 0) -> DataFrame:
    """Adds output_name to (session_id, seq, original): numbers run by seq within a session."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    numbered = files.withColumn("_n", (n + (start - 1)).cast("long"))
    return _suffixed(numbered.withColumn("output_name", T.renamed(F.col("original"), pattern, F.col("_n"), padding)), "output_name").drop("_n")


#: Output formats and their extensions.
FORMATS = {"png": "png", "jpg": "jpg", "jpeg": "jpg", "webp": "webp"}


def plan_outputs(files: DataFrame, pattern: str = "#", start: int = 1, padding: int = 0, stems: DataFrame | None = None, output_format: str = "original") -> DataFrame:
    """Adds output_name with the format's extension; `stems` (session_id, seq, stem) name files themselves where a session has one for each.

    A session whose stems don't match its files one to one is named by the pattern.
    """
    named = plan_renames(files, pattern, start, padding).withColumn("_stem", T.split_extension(F.col("output_name"))["stem"])
    if stems is not None:
        n = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
        counts = files.groupBy("session_id").count().join(stems.groupBy("session_id").agg(F.count("*").alias("_s")), "session_id").where("count = _s").select("session_id", F.lit(True).alias("_own"))
        own = T.strip(F.regexp_replace(F.coalesce("stem", F.lit("")), T.UNSAFE, "_"))
        named = named.withColumn("_n", n + (start - 1)).join(stems, ["session_id", "seq"], "left").join(counts, "session_id", "left")
        named = named.withColumn("_stem", F.when(F.col("_own"), F.when(own == "", F.col("_n").cast("string")).otherwise(own)).otherwise(F.col("_stem"))).drop("_n", "_own", "stem")
    forced = FORMATS.get((output_format or "original").strip().lower())
    ext = F.lit(forced) if forced else T.split_extension(F.col("original"))["ext"]
    out = named.withColumn("output_name", F.concat("_stem", F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))).drop("_stem")
    return _suffixed(out, "output_name")


def archive_manifest(files: DataFrame) -> DataFrame:
    """(job_id, archive, file) rows of (job_id, file, is_solution, is_sidecar).

    Every image is in the combined archive and in that of its side. Sidecars belong to the questions: they are in their
    archive and the combined one if the job has a question, else in none; never in the solutions, whatever is_solution
    says of them. An empty table gives an empty one.
    """
    side = F.coalesce("is_sidecar", F.lit(False))
    asked = files.where(~side & ~F.col("is_solution")).select("job_id").distinct()
    images = files.where(~side).select("job_id", F.when(F.col("is_solution"), "solutions").otherwise("questions").alias("archive"), "file")
    extra = files.where(side).join(asked, "job_id", "left_semi").select("job_id", F.lit("questions").alias("archive"), "file")
    all_ = images.union(extra)
    return all_.union(all_.select("job_id", F.lit("combined"), "file"))


#: What each level of compression aims at.
LEVELS = {"light": (200, 85), "balanced": (150, 72), "strong": (100, 55), "extreme": (72, 40)}


def compressed(files: DataFrame) -> DataFrame:
    """files (level, original_size, made_size) with dpi and quality of the level (else of balanced), size and kept_original.

    The smaller of the two is handed back: the original where compression didn't shrink it.
    """
    level = F.create_map(*[x for k, (d, q) in LEVELS.items() for x in (F.lit(k), F.struct(F.lit(d).alias("dpi"), F.lit(q).alias("quality")))])
    preset = F.coalesce(F.try_element_at(level, F.lower(F.coalesce("level", F.lit("")))), F.try_element_at(level, F.lit("balanced")))
    kept = F.col("made_size") >= F.col("original_size")
    return files.withColumn("_p", preset).select(*files.columns, "_p.dpi", "_p.quality", F.when(kept, F.col("original_size")).otherwise(F.col("made_size")).alias("size"), kept.alias("kept_original"))


def page_images(docs: DataFrame) -> DataFrame:
    """(doc_id, page, name): the image name of each page of docs (doc_id, stem, n_pages), numbers as wide as the last one and two digits at least."""
    each = docs.where("n_pages > 0").select("doc_id", "stem", "n_pages", F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias("page"))
    wide = F.greatest(F.lit(2), F.length(F.col("n_pages").cast("string")))
    number = F.col("page").cast("string")
    return each.select("doc_id", "page", F.concat("stem", F.lit("_p"), F.repeat(F.lit("0"), F.greatest(F.lit(0), wide - F.length(number))), number, F.lit(".png")).alias("name"))


def key_pages(docs: DataFrame, most: int = 6) -> DataFrame:
    """(doc_id, page): the last `most` pages of docs (doc_id, n_pages), where answer keys stand; a doc without pages has none."""
    n = F.col("n_pages").cast("int")
    return docs.where("n_pages > 0").select("doc_id", F.explode(F.sequence(F.greatest(F.lit(1), n - (most - 1)), n)).alias("page"))


def choose_rung(attempts: DataFrame, target: int) -> DataFrame:
    """(doc_id, rung, size, target_met): the first rung at most `target` large, else the smallest, the first of equals."""
    fits = F.min(F.when(F.col("size") <= target, F.struct("rung", "size")))
    small = F.min(F.struct("size", "rung"))
    return attempts.groupBy("doc_id").agg(fits.alias("f"), small.alias("s")).select("doc_id", F.coalesce("f.rung", "s.rung").alias("rung"), F.coalesce("f.size", "s.size").alias("size"), F.col("f").isNotNull().alias("target_met"))


def expired(jobs: DataFrame, now, seconds: int = 1800) -> DataFrame:
    """Jobs (job_id, mtime in seconds) that are older than `seconds`."""
    return jobs.where(F.lit(now) - F.col("mtime") > seconds)


#: The extensions that may be renamed.
IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tif", "tiff")


def allowed(files: DataFrame, name: str = "original") -> DataFrame:
    """Files whose name has an image's extension; a null name has none."""
    return files.where(T.split_extension(F.col(name))["ext"].isin(*IMAGES))
