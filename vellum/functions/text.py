"""String rules as Spark columns: markers, headers, option labels, answer pairs, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standalone headers that open a solutions section, letters and digits only.
SOLUTION_HEADERS = (
    "solution", "solutions", "answer", "answers", "answerkey", "answerskey", "answersolution", "answersolutions",
    "answerssolutions", "answerandsolution", "answerandsolutions", "answersandsolutions", "hintssolution",
    "hintssolutions", "hintandsolution", "hintsandsolutions", "detailedsolution", "detailedsolutions", "explanation",
    "explanations", "solutionsexplanations", "answerexplanation", "answerexplanations", "key", "keysolution",
    "keysolutions", "solutionkey", "hints", "hint", "hintsolution", "answerwithsolution", "answerswithsolutions",
    "answerwithexplanation", "answerswithexplanations", "solutionandanswer", "solutionsandanswers",
)

#: Patterns, as Java reads them.
STRONG_MARKER = r"(?iU)^q(?:ues(?:tion)?)?[.\s]?\s*(?:no[.\s:]*)?\s*[-:]?\s*(\d{1,3})\b"
WEAK_MARKER = r"(?U)^(\d{1,3})\s*[.)](?:\s|$)|^(\d{1,3})\s*\.\s*\("
SECTION = r"(?i)^(?:part|section)\s*[-–—:.]?\s*(?:[IVXLCDM]+|[A-Z]|\d{1,2})\b|^this\s+section\s+contains\b"
OPTION_START = r"^\(?\s*[A-Da-d]\s*[.)]"
KEY_CELL = r"(?U)^\d{1,3}\s*[.):\-]?\s*\(?\s*[A-Ea-e1-5]\s*\)?$"
FOLIO = r"(?i)^(?:\d{1,4}|\d{1,4}\s*/\s*\d{1,4}|page\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|[-–—]\s*\d{1,4}\s*[-–—])$"
OPTION_LABEL = r"(?U)(?<![A-Za-z0-9])\(?\s*([A-Da-d])\s*[.)]"
KEY_PAIR = r"(?iU)(?:^|[\s,;|])(?:Q\.?\s*)?(\d{1,3})\s*[.)\-:]?\s*\(?\s*([A-D])\s*\)?(?=$|[\s,;|])"
LABELLED_ANSWER = r"(?iU)\b(?:ans(?:wer)?|correct\s*(?:option|answer|choice)?|sol(?:ution)?|key|option)\b\s*(?:is|:|-|=|\.|\))*\s*\(?\s*([A-D])\s*\)?(?![A-Za-z])"
UNSAFE = r'[\\/:*?"<>|]+'

#: Letters that recognition takes for digits.
MISREAD, MEANT = "OoQDIli|!ZzEASsGbTBgq", "000011111223455667899"


def strip(text: Column) -> Column:
    """Without white space of any kind around it; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|(?U)\s+$", "")


def alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def first_number(text: Column) -> Column:
    """The first run of digits as an int, null if there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"\d+", 0).try_cast("int")


def _number(digits: Column) -> Column:
    """Without leading zeros; all zeros are one zero."""
    cut = F.regexp_replace(digits, "^0+", "")
    return F.when(cut == "", "0").otherwise(cut)


def marker(text: Column, style: str = "auto") -> Column:
    """struct(q_num, is_strong) of the question marker that opens the line, or null; style: auto, q or numbered."""
    t = strip(text)
    strong, weak = F.regexp_extract(t, STRONG_MARKER, 1), F.concat(F.regexp_extract(t, WEAK_MARKER, 1), F.regexp_extract(t, WEAK_MARKER, 2))
    out = F.when(strong != "", F.struct(_number(strong).alias("q_num"), F.lit(True).alias("is_strong"))) if style != "numbered" else F
    if style == "q":
        return out
    return out.when(weak != "", F.struct(_number(weak).alias("q_num"), F.lit(False).alias("is_strong")))


def is_solution_header(text: Column) -> Column:
    t = strip(text)
    return (F.length(t) <= 40) & alnum(t).isin(*SOLUTION_HEADERS)


def is_section_header(text: Column) -> Column:
    t = strip(text)
    return (F.length(t) <= 60) & t.rlike(SECTION)


def starts_with_option(text: Column) -> Column:
    return strip(text).rlike(OPTION_START)


def is_key_cell(text: Column) -> Column:
    return strip(text).rlike(KEY_CELL)


def is_folio(text: Column) -> Column:
    t = strip(text)
    return (F.length(t) <= 20) & t.rlike(FOLIO)


def is_marker_line(text: Column) -> Column:
    return marker(text).isNotNull() | is_solution_header(text)


def option_letters(text: Column) -> Column:
    """The option letters labelled in the text, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(OPTION_LABEL), F.lit(1))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, F.upper))), "")


def key_pairs(text: Column) -> Column:
    """array<struct<num, letter>> of the answer-key pairs in the text, in order; numbers 1 to 999."""
    t = F.coalesce(text, F.lit(""))
    nums = F.transform(F.regexp_extract_all(t, F.lit(KEY_PAIR), F.lit(1)), lambda x: x.try_cast("int"))
    found = F.transform(F.regexp_extract_all(t, F.lit(KEY_PAIR), F.lit(2)), F.upper)
    pairs = F.zip_with(nums, found, lambda n, a: F.struct(n.alias("num"), a.alias("letter")))
    return F.filter(pairs, lambda p: (p["num"] >= 1) & (p["num"] <= 999))


def labelled_answer(text: Column) -> Column:
    """The option letter after the first answer label, null if there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), LABELLED_ANSWER, 1)
    return F.when(found != "", F.upper(found))


def misread_number(token: Column) -> Column:
    """The token read as a number of at most three digits, letters taken for digits put right; null otherwise."""
    t = F.regexp_replace(strip(token), r"^[.)\-:]+|[.)\-:]+$", "")
    digits = F.translate(t, MISREAD, MEANT)
    return F.when(digits.rlike(r"^\d{1,3}$"), digits.try_cast("int"))


def readings(text: Column) -> Column:
    """The different numbers that the line's first token, or what is before a separator in it, reads as."""
    head = F.split(strip(text), r"(?U)\s+")[0]
    tries = [head, *[F.when(F.contains(head, F.lit(s)), F.split_part(head, F.lit(s), F.lit(1))) for s in (".", ")")]]
    return F.array_distinct(F.filter(F.array(*map(misread_number, tries)), lambda n: n > 0))


def matches_number(text: Column, expected: Column) -> Column:
    """Whether the line's first token, or what is before a separator in it, reads as the expected number."""
    return F.coalesce(F.array_contains(readings(text), expected), F.lit(False))


def split_extension(name: Column) -> Column:
    """struct(stem, ext) of a file name: ext in lower case without the dot; a name that begins with its only dot has none."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/]*$", 0)
    cut = F.regexp_extract(base, r"^(.+)\.([^.]*)$", 1)
    return F.struct(F.when(cut != "", cut).otherwise(base).alias("stem"), F.when(cut != "", F.lower(F.regexp_extract(base, r"^(.+)\.([^.]*)$", 2))).otherwise("").alias("ext"))


def renamed(name: Column, pattern: str, number: Column, padding: int = 0) -> Column:
    """The name that a pattern gives: # is the number, else it is appended; the extension stays; unsafe characters become _."""
    base = (pattern or "").strip() or "#"
    digits = F.format_string(f"%0{padding}d", number) if padding > 0 else number.cast("string")
    stem = F.replace(F.lit(base), F.lit("#"), digits) if "#" in base else F.concat(F.lit(base), digits)
    stem = strip(F.regexp_replace(stem, UNSAFE, "_"))
    ext = split_extension(name)["ext"]
    return F.concat(F.when(stem == "", digits).otherwise(stem), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))


def output_file(q_num: Column, is_solution: Column, start: int = 1, ext: str = "png", question: str = "Q", solution: str = "S") -> Column:
    """prefix, three-digit number shifted by start - 1 and not under zero, extension."""
    n = F.greatest(F.coalesce(first_number(q_num), F.lit(0)) + (start - 1), F.lit(0))
    return F.format_string(f"%s%03d.{'jpg' if ext.lower() in ('jpg', 'jpeg') else 'png'}", F.when(is_solution, solution).otherwise(question), n)


def page_ranges(spec: Column, max_page: Column | None = None) -> Column:
    """The sorted pages that "1-5, 8, 10 to 12" names; reversed ranges are turned; a bad part raises an error.

    Pages under 1 or beyond max_page are left out before a range is laid out, so that numbers may be of any length.
    """
    top = max_page if max_page is not None else F.lit(2**31 - 2)
    norm = F.regexp_replace(F.coalesce(spec, F.lit("")), r"(?i)\bto\b", "-")
    parts = F.filter(F.transform(F.split(norm, ","), strip), lambda p: p != "")

    def pages(p: Column) -> Column:
        ends = F.split(F.when(p.rlike(r"^\d+$"), F.concat(p, F.lit("-"), p)).otherwise(p), r"\s*-\s*")
        a, b = (F.when(F.length(d) > 10, F.lit(10**10)).otherwise(d.try_cast("long")) for d in (F.regexp_replace(ends[i], "^0+(?=.)", "") for i in (0, 1)))
        low, high = F.greatest(F.least(a, b), F.lit(1)).try_cast("int"), F.least(F.greatest(a, b), top.cast("long")).cast("int")
        bad = F.raise_error(F.concat(F.lit("Invalid page range: "), p)).cast("array<int>")
        return F.when(p.rlike(r"^\d+(?:\s*-\s*\d+)?$"), F.when(low <= high, F.sequence(low, F.when(low <= high, high).otherwise(low))).otherwise(F.array().cast("array<int>"))).otherwise(bad)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))


def strip_fences(text: Column) -> Column:
    """What stands between the first { or [ and the last } or ]: JSON without the fences that models put around it."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)[{\[].*[}\]]", 0)
