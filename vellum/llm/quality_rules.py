"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import SPACES, narrow

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages.
STOP_WORDS = (
    *("the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "for", "on", "was", "a", "as", "are", "this", "from", "by", "an", "or", "at", "not"),
    *("le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "pas", "sur", "au", "est", "par", "avec"),
    *("der", "die", "das", "und", "ist", "von", "den", "dem", "im", "zu", "mit", "ein", "eine", "für", "auf", "nicht", "sich"),
    *("el", "los", "las", "y", "una", "del", "por", "con", "para", "se", "su", "al", "lo", "es", "no"),
)


@dataclass(frozen=True)
class Rule:
    """The document fails if its `measure` is under `least` or over `most`."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Length, symbol, stop-word and line ratios.
RULES = (
    Rule("mean_word_chars", 2.5, 12.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.45),
)


def _repeat_words(words: Column) -> Column:
    """How many words stand in a three-word window that the text has twice or more.

    Windows are held as 64-bit hashes. If all differ, the count is zero; else their places are sorted by hash, those
    equal to a neighbour are kept in order, and each covers three words less what the next one covers too.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]),
    )

    def covered(keys: Column) -> Column:
        places = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(at: Column) -> Column:
            hit = F.filter(
                at,
                lambda x, j: (x["h"] == F.get(at, j - 1)["h"]) | (x["h"] == F.get(at, j + 1)["h"]),
            )
            starts = F.sort_array(F.transform(hit, lambda x: x["i"]))
            return _let(starts, lambda s: F.aggregate(
                F.transform(s, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - x, F.lit(3)))),
                F.lit(0), lambda a, b: a + b,
            ))

        return _let(places, repeated)

    found = _let(windows, lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(covered(keys)))
    return F.when(F.size(words) >= 4, found).otherwise(F.lit(0)).cast("long")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def measures(docs: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios that rules use; null text: no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    stop = F.size(F.filter("words", lambda w: w.isin(*stop_words)))
    counted = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        stop.alias("n_stop"),
    )
    words, n_lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("lines.n"), F.lit(1))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.dup").cast("long").alias("n_dup_lines"), "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_stop") / words).alias("stop_word_ratio"),
        (F.col("lines.dup") / n_lines).alias("dup_line_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean: no rule fails."""
    fails = F.lit(False)
    for r in rules:
        if r.least is not None:
            fails = fails | (F.col(r.measure) < r.least)
        if r.most is not None:
            fails = fails | (F.col(r.measure) > r.most)
    return ~fails


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row.

    A null or empty text has no words and fails the base. Repeated rows are judged each for itself; other columns are
    ignored; an empty table gives an empty one.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = measures(narrow(docs, "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & compile_rules(rules)).alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows, with all their columns, that no rule rejects: judged in the same projection, without a join.

    The verdict passes through inline(), lest the optimizer unfold the whole table of thresholds into the filter.
    """
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), F.col("text"))
    judged = judge(named, rules).select(F.inline(F.array(F.struct(F.col("doc_id").alias("row"), "kept"))))
    return judged.where("kept").select("row.*")


def _oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """judge() over the table documents, for DuckDB."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    fails = [f"{r.measure} < {r.least}" for r in rules if r.least is not None] + [f"{r.measure} > {r.most}" for r in rules if r.most is not None]
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\x0c\r]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS l
  FROM documents),
t AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS n FROM t),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY k),
m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop, len(l) AS n_lines
  FROM d LEFT JOIN r USING (k)),
x AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word,
    n_stop / greatest(n_words, 1) AS stop_word_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(fails)}) AS kept
FROM x
"""


ORACLE_SQL = _oracle()
