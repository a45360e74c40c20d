"""The registered queries of the layout operators, and DuckDB SQL for the same rows.

Inputs are relations made from the driver's tables by SQL that both engines read; {name} is a table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import answers, branding, columns, dedup, furniture, lines, naming, preflight, review
from vellum.plans import regions, tiers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def query(oracle: str | None = None, **inputs: str):
    """Registers fn(*inputs) under its name; the oracle sees each input as a CTE of the parameter's name."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(**{k: read(spark, sf_dir, v) for k, v in inputs.items()})

        QUERIES[fn.__name__] = run
        if oracle:
            ORACLES[fn.__name__] = "WITH RECURSIVE " + ", ".join(f"{k} AS ({duck(v)})" for k, v in inputs.items()) + " " + oracle.strip()
        return fn

    return register


ORDERED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)"
#: Lines of text that hold markers, options and key pairs, from lineitem.
TEXT = f"""
SELECT l_orderkey AS doc_id, CAST({ORDERED} AS INT) AS line_seq, CAST(1 + l_suppkey % 3 AS INT) AS page, l_returnflag = 'R' AS is_solution,
  CASE l_partkey % 7 WHEN 0 THEN concat('Q', l_linenumber, '. What is ', l_partkey, '?') WHEN 1 THEN concat(' ', l_linenumber, ') Of ', l_suppkey, ' (A) one (B) two')
    WHEN 2 THEN concat('0', l_linenumber, '. (b) ', l_linenumber + 1, '. (c)') WHEN 3 THEN concat('Question No. ', l_linenumber, ' c) x D. y')
    WHEN 4 THEN concat(l_linenumber, '-B ', l_linenumber + 1, '-A ', l_linenumber + 2, '-D') WHEN 5 THEN concat('Ans. (', substring('ABCD', CAST(1 + l_suppkey % 4 AS INT), 1), ') so')
    ELSE concat('Answer Key: ', l_linenumber) END AS text
FROM {{lineitem}}"""
#: Boxes in page percent, from lineitem.
BOXES = f"""
SELECT doc_id, item_seq, q_num, is_solution, page, y_start, CASE WHEN y_start + high > 100 THEN CAST(100 AS DOUBLE) ELSE y_start + high END AS y_end, x_start, x_end FROM (
  SELECT l_orderkey AS doc_id, CAST({ORDERED} AS INT) AS item_seq, CAST(l_linenumber AS STRING) AS q_num, l_returnflag = 'R' AS is_solution, CAST(1 + l_suppkey % 2 AS INT) AS page,
    CAST(l_partkey % 90 AS DOUBLE) AS y_start, l_quantity / 2 + 2 AS high, CASE l_suppkey % 3 WHEN 1 THEN CAST(50 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x_start, CASE l_suppkey % 3 WHEN 0 THEN CAST(50 AS DOUBLE) ELSE CAST(100 AS DOUBLE) END AS x_end
  FROM {{lineitem}}) b"""
#: Lines in page percent, three to a row of lineitem.
BOX_LINES = """
SELECT l_orderkey AS doc_id, CAST(1 + (l_suppkey + k) % 2 AS INT) AS page, CAST((l_partkey * 7 + k * 31) % 97 AS DOUBLE) AS y0, CAST((l_partkey * 7 + k * 31) % 97 + 2 + l_suppkey % 3 AS DOUBLE) AS y1,
  CAST((l_suppkey * 13 + k * 50) % 80 AS DOUBLE) AS x0, CAST((l_suppkey * 13 + k * 50) % 80 + 20 AS DOUBLE) AS x1
FROM {lineitem} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks"""
#: Numbers of items with outliers, from lineitem.
NUMBERS = f"""
SELECT l_suppkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS INT) AS item_seq,
  CAST(CASE WHEN l_partkey % 40 = 0 THEN 200 + 17 * l_linenumber ELSE l_linenumber + l_orderkey % 9 END AS STRING) AS q_num, l_returnflag = 'R' AS is_solution FROM {{lineitem}}"""
CONVERSATION = "SELECT conv_id AS doc_id, CAST(turn AS INT) AS turn, role, text FROM {conversations}"


def with_segments(boxes: DataFrame) -> DataFrame:
    return boxes.select("doc_id", "item_seq", "q_num", "is_solution", F.array(F.struct("page", "y_start", "y_end", "x_start", "x_end")).alias("segments"))


MARKS = r"""
, t AS (SELECT *, trim(text) AS s FROM lines), m AS (
  SELECT *, regexp_extract(s, '(?i)^q(?:ues(?:tion)?)?[.\s]?\s*(?:no[.\s:]*)?\s*[-:]?\s*(\d{1,3})\b', 1) AS strong,
    regexp_extract(s, '^(\d{1,3})\s*[.)](?:\s|$)', 1) || CASE WHEN regexp_matches(s, '^\d{1,3}\s*[.)](?:\s|$)') THEN '' ELSE regexp_extract(s, '^(\d{1,3})\s*\.\s*\(', 1) END AS weak FROM t),
n AS (SELECT doc_id, page, line_seq, is_solution, strong <> '' AS is_strong, ltrim(CASE WHEN strong <> '' THEN strong ELSE weak END, '0') AS d FROM m WHERE strong <> '' OR weak <> ''),
marks AS (SELECT * REPLACE (CASE WHEN d = '' THEN '0' ELSE d END AS d), bool_or(is_strong) OVER (PARTITION BY doc_id, is_solution) AS any_strong FROM n)"""


def markers_of(lines_: DataFrame) -> DataFrame:
    return lines_.withColumn("m", T.marker(F.col("text"))).where("m is not null").select("doc_id", "page", "line_seq", "is_solution", "m.q_num", "m.is_strong")


@query(MARKS + " SELECT doc_id, page, line_seq, is_solution, d AS q_num, is_strong FROM marks WHERE is_strong OR NOT any_strong", lines=TEXT)
def marker_detect(lines: DataFrame) -> DataFrame:
    from vellum.operators.lines import strong_first

    return strong_first(markers_of(lines)).select("doc_id", "page", "line_seq", "is_solution", "q_num", "is_strong")


@query(r""", l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_seq FROM docs)
SELECT doc_id, line_seq::INT AS line_seq, trim(raw, ' ' || chr(9) || chr(13)) AS text, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS exact, regexp_replace(lower(raw), '[^a-z]', '', 'g') AS loose
FROM l WHERE trim(raw, ' ' || chr(9) || chr(13)) <> ''""", docs="SELECT doc_id, text FROM {documents}")
def line_scan(docs: DataFrame) -> DataFrame:
    out = lines.line_scan(docs)
    return out.select("doc_id", "line_seq", "text", T.alnum(F.col("text")).alias("exact"), T.letters(F.col("text")).alias("loose"))


@query(r""", f AS (SELECT doc_id, line_seq, list_sort(list_distinct(list_transform(regexp_extract_all('¦' || regexp_replace(text, '([^A-Za-z0-9])', '\1¦', 'g'), '¦(?:\(¦)?(?:\s¦)*([A-Da-d])(?:\s¦)*[.)]', 1), lambda x: upper(x)))) AS o FROM lines)
SELECT doc_id, line_seq, array_to_string(o, '') AS letters FROM f WHERE len(o) > 0""", lines=TEXT)
def option_letters(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "line_seq", T.option_letters(F.col("text")).alias("letters")).where("letters != ''")


PAIRS = r""", s AS (SELECT doc_id, line_seq, regexp_replace(text, '([\s,;|])', '¦\1', 'g') || '¦' AS s FROM lines),
x AS (SELECT doc_id, line_seq, regexp_extract_all(s, '(?i)(?:^|[\s,;|])(?:Q\.?(?:¦\s)*)?(\d{1,3})(?:¦\s)*[.)\-:]?(?:¦\s)*\(?(?:¦\s)*([A-D])(?:¦\s)*\)?¦', 1) AS n,
  regexp_extract_all(s, '(?i)(?:^|[\s,;|])(?:Q\.?(?:¦\s)*)?(\d{1,3})(?:¦\s)*[.)\-:]?(?:¦\s)*\(?(?:¦\s)*([A-D])(?:¦\s)*\)?¦', 2) AS a FROM s),
p AS (SELECT doc_id, line_seq, unnest(n)::INT AS num, upper(unnest(a)) AS letter, unnest(range(len(n))) AS i FROM x),
k AS (SELECT doc_id, num, first(letter ORDER BY line_seq, i) AS letter, count(*) AS c FROM p WHERE num BETWEEN 1 AND 999 GROUP BY doc_id, num),
g AS (SELECT doc_id FROM k GROUP BY doc_id HAVING sum(c) >= 4 AND count(*) >= 4 AND count(*) / (max(num) - min(num) + 1) >= 0.7)"""


@query(PAIRS + " SELECT doc_id, num, letter FROM k WHERE doc_id IN (SELECT doc_id FROM g)", lines=TEXT)
def answer_key(lines: DataFrame) -> DataFrame:
    return answers.answer_key(lines, ["line_seq"])


@query(PAIRS + " SELECT doc_id, unnest(range(min(num), max(num) + 1))::INT AS num FROM k WHERE doc_id IN (SELECT doc_id FROM g) GROUP BY doc_id", lines=TEXT)
def expected_numbers(lines: DataFrame) -> DataFrame:
    return answers.expected_numbers(answers.answer_key(lines, ["line_seq"]))


@query(r""", x AS (SELECT doc_id, line_seq, regexp_extract(text, '(?i)\b(?:ans(?:wer)?|correct\s*(?:option|answer|choice)?|sol(?:ution)?|key|option)\b\s*(?:is|:|-|=|\.|\))*\s*\(?\s*([A-D])\s*\)?(?:[^A-Za-z]|$)', 1) AS a FROM lines)
SELECT doc_id, line_seq, upper(a) AS letter FROM x WHERE a <> ''""", lines=TEXT)
def labelled_answers(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "line_seq", T.labelled_answer(F.col("text")).alias("letter")).where("letter is not null")


@query(r"""SELECT doc_id, line_seq, length(trim(text)) <= 40 AND regexp_replace(lower(trim(text)), '[^a-z0-9]', '', 'g') IN ('solution', 'answer', 'answerkey', 'key', 'hints') AS header,
 regexp_matches(trim(text), '^\(?\s*[A-Da-d]\s*[.)]') AS option, regexp_matches(trim(text), '^\d{1,3}\s*[.):\-]?\s*\(?\s*[A-Ea-e1-5]\s*\)?$') AS cell,
 length(trim(text)) <= 20 AND regexp_matches(trim(text), '(?i)^(?:\d{1,4}|\d{1,4}\s*/\s*\d{1,4}|page\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|[-–—]\s*\d{1,4}\s*[-–—])$') AS folio,
 length(trim(text)) <= 60 AND regexp_matches(trim(text), '(?i)^(?:part|section)\s*[-–—:.]?\s*(?:[IVXLCDM]+|[A-Z]|\d{1,2})\b|^this\s+section\s+contains\b') AS section FROM lines""",
    lines="""SELECT l_orderkey AS doc_id, l_linenumber AS line_seq, CASE l_partkey % 9 WHEN 0 THEN 'Answer Key:' WHEN 1 THEN concat('PART-II (', l_suppkey, ')') WHEN 2 THEN concat('Section ', l_linenumber) WHEN 3 THEN concat('page ', l_linenumber, ' of 9')
  WHEN 4 THEN concat(l_linenumber, '. (', 1 + l_suppkey % 6, ')') WHEN 5 THEN concat('(', substring('ABCDE', CAST(1 + l_suppkey % 5 AS INT), 1), ') choice') WHEN 6 THEN concat('- ', l_suppkey, ' -') WHEN 7 THEN 'This section contains four' ELSE concat('the solution of ', l_partkey) END AS text FROM {lineitem}""")
def line_predicates(lines: DataFrame) -> DataFrame:
    t = F.col("text")
    return lines.select("doc_id", "line_seq", T.is_solution_header(t).alias("header"), T.starts_with_option(t).alias("option"), T.is_key_cell(t).alias("cell"), T.is_folio(t).alias("folio"), T.is_section_header(t).alias("section"))


FURNITURE_LINES = """SELECT l.doc_id, l.page, l.line_seq, l.text, CAST(10 * l.line_seq AS DOUBLE) AS y_top, CAST(10 * l.line_seq + 8 AS DOUBLE) AS y_bottom FROM (
  SELECT CAST(c_nationkey AS STRING) AS doc_id, c_custkey AS page, k AS line_seq, CASE k WHEN 0 THEN concat('Running Title ', c_nationkey) WHEN 1 THEN concat('Body ', c_custkey % 11) WHEN 2 THEN c_name WHEN 3 THEN c_mktsegment WHEN 98 THEN concat(c_custkey % 100, '/', 99) ELSE concat('Site ', c_custkey % 3) END AS text
  FROM {customer} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 9 UNION ALL SELECT 98) ks) l"""


@query(r""", z AS (SELECT *, count(DISTINCT page) OVER (PARTITION BY doc_id) AS n_pages, y_top / 1000 * 100 AS top, y_bottom / 1000 * 100 AS bottom, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS exact, regexp_replace(lower(text), '[^a-z]', '', 'g') AS loose FROM lines),
e AS (SELECT doc_id, exact, count(DISTINCT page) AS p, max(top) - min(top) <= 3 AND (count(DISTINCT page) >= greatest(2, round_even(max(n_pages) * 0.5, 0)) OR count(DISTINCT page) >= 3 AND bool_and(top <= 15 OR bottom >= 85)) AS f FROM z WHERE exact <> '' GROUP BY ALL),
o AS (SELECT doc_id, loose, max(top) - min(top) <= 3 AND (count(DISTINCT page) >= greatest(2, round_even(max(n_pages) * 0.5, 0)) OR count(DISTINCT page) >= 3 AND bool_and(top <= 15 OR bottom >= 85)) AS f FROM z WHERE loose <> '' GROUP BY ALL)
SELECT z.doc_id, z.page, z.line_seq, CASE WHEN n_pages < 2 THEN FALSE WHEN (top <= 15 OR bottom >= 85) AND regexp_matches(text, '^\d{1,4}\s*/\s*\d{1,4}$') THEN TRUE WHEN coalesce(e.f, FALSE) OR coalesce(o.f, FALSE) THEN top <= 15 OR bottom >= 85 ELSE coalesce(e.p >= 2, FALSE) AND (top <= 6 OR bottom >= 90) END AS furniture
FROM z LEFT JOIN e USING (doc_id, exact) LEFT JOIN o USING (doc_id, loose)""".replace("count(DISTINCT page) OVER (PARTITION BY doc_id) AS n_pages", "(SELECT count(DISTINCT page) FROM lines m WHERE m.doc_id = lines.doc_id) AS n_pages"), lines=FURNITURE_LINES)
def repeat_furniture(lines: DataFrame) -> DataFrame:
    pages = lines.select("doc_id", "page").distinct().withColumn("height", F.lit(1000.0))
    return furniture.find_furniture(lines, pages).select("doc_id", "page", "line_seq", "furniture")


@query(""", x AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS m FROM turns)
SELECT doc_id, m AS marker_seq, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM x WHERE role <> 'user' AND m IS NOT NULL GROUP BY ALL""", turns=CONVERSATION)
def marker_assign(turns: DataFrame) -> DataFrame:
    marks = turns.where("role = 'user'").select("doc_id", "turn", F.col("turn").alias("marker_seq"), F.col("turn").cast("string").alias("q_num"))
    at = lines.assign(marks, turns.where("role != 'user'"), ["turn"])
    return at.groupBy("doc_id", "marker_seq").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query(""", x AS (SELECT *, coalesce(max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS is_solution FROM turns)
SELECT doc_id, turn, role, is_solution FROM x WHERE NOT (role = 'assistant' AND NOT is_solution)""", turns=CONVERSATION)
def sticky_section(turns: DataFrame) -> DataFrame:
    return lines.sticky_section(turns, F.col("role") == "assistant", ["turn"]).select("doc_id", "turn", "role", "is_solution")


@query(""", g AS (SELECT doc_id, is_solution, count(*) AS c, min(q_num::INT) AS a, max(q_num::INT) AS b, list_distinct(list(q_num::INT)) AS nums FROM items GROUP BY ALL),
x AS (SELECT *, list_filter(range(a, b + 1), lambda v: NOT list_contains(nums, v::INT)) AS missing FROM g WHERE c >= 3)
SELECT doc_id, is_solution, array_to_string(missing, ',') AS missing FROM x WHERE len(missing) > 0 AND len(missing) <= greatest(5, (b - a) // 2)""", items=BOXES)
def number_gaps(items: DataFrame) -> DataFrame:
    return review.number_gaps(items).withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


@query(""", d AS (SELECT DISTINCT doc_id, is_solution, q_num::INT AS n FROM items), u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, is_solution ORDER BY n) AS r, n - lag(n) OVER (PARTITION BY doc_id, is_solution ORDER BY n) AS gap FROM d),
c AS (SELECT *, min(gap) OVER (PARTITION BY doc_id, is_solution ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS least FROM u)
SELECT doc_id, item_seq, q_num, is_solution FROM items WHERE (doc_id, is_solution, q_num::INT) NOT IN (SELECT doc_id, is_solution, n FROM c WHERE r >= 5 AND least >= 10)""", items=NUMBERS)
def phantom_drop(items: DataFrame) -> DataFrame:
    return review.drop_phantoms(items)


@query("""SELECT i.doc_id, format('Q{:03d}.png', i.q_num::INT + 4) AS file, i.q_num AS question, coalesce(k.letter, '') AS answer
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, q_num ORDER BY item_seq) AS r FROM items WHERE NOT is_solution) i LEFT JOIN key k ON i.doc_id = k.doc_id AND i.q_num::INT = k.num WHERE r = 1""",
    items=NUMBERS, key="SELECT DISTINCT l_suppkey AS doc_id, l_linenumber * 2 AS num, substring('ABCD', CAST(1 + (l_suppkey + l_linenumber) % 4 AS INT), 1) AS letter FROM {lineitem}")
def answer_sheet(items: DataFrame, key: DataFrame) -> DataFrame:
    return answers.answer_sheet(items, key, start=5)


OVERLAP = """, o AS (SELECT DISTINCT a.doc_id, a.is_solution, a.q_num FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.is_solution = b.is_solution AND a.page = b.page AND a.item_seq <> b.item_seq
  AND least(a.x_end, b.x_end) - greatest(a.x_start, b.x_start) > 0 AND least(a.y_end, b.y_end) - greatest(a.y_start, b.y_start) >= 6)"""


@query(OVERLAP + " SELECT * FROM o", boxes=BOXES)
def box_overlap(boxes: DataFrame) -> DataFrame:
    return review.overlapping(with_segments(boxes))


BARE = """, bare AS (SELECT DISTINCT t.* , row_number() OVER () AS k FROM lines t), u AS (SELECT * FROM bare t WHERE NOT EXISTS (SELECT 1 FROM boxes s WHERE s.doc_id = t.doc_id AND s.page = t.page AND (t.x0 + t.x1) / 2 BETWEEN s.x_start AND s.x_end AND (t.y0 + t.y1) / 2 BETWEEN s.y_start - 1.5 AND s.y_end + 1.5)),
ob AS (SELECT o.doc_id, o.is_solution, o.q_num, o.page, o.y_start, o.y_end, o.x_start, o.x_end, least(94, coalesce(min(s.y_start) FILTER (s.y_start >= o.y_end), 94)) AS until, count(s.doc_id) FILTER (s.y_start < o.y_start) AS above
  FROM (SELECT DISTINCT doc_id, is_solution, q_num, page, y_start, y_end, x_start, x_end FROM boxes) o LEFT JOIN boxes s ON o.doc_id = s.doc_id AND o.page = s.page AND NOT (o.is_solution = s.is_solution AND o.q_num = s.q_num) AND (s.x_start + s.x_end) / 2 BETWEEN o.x_start AND o.x_end GROUP BY ALL),
tl AS (SELECT DISTINCT doc_id, is_solution, q_num FROM (SELECT o.doc_id, o.is_solution, o.q_num, o.page, o.y_start, o.y_end, o.x_start, o.x_end, min(u.y0) AS first, sum(u.y1 - u.y0) AS band FROM ob o JOIN u ON o.doc_id = u.doc_id AND o.page = u.page AND (u.x0 + u.x1) / 2 BETWEEN o.x_start AND o.x_end AND (u.y0 + u.y1) / 2 > o.y_end AND (u.y0 + u.y1) / 2 >= 6 AND (u.y0 + u.y1) / 2 <= o.until GROUP BY ALL) WHERE first - y_end <= 14 AND band >= 8),
hd AS (SELECT DISTINCT doc_id, is_solution, q_num FROM (SELECT o.doc_id, o.is_solution, o.q_num, o.page, o.y_start, o.y_end, o.x_start, o.x_end, arg_max(u.y1, u.y0 * 1000 + u.y1) AS last, sum(u.y1 - u.y0) AS band FROM ob o JOIN u ON o.doc_id = u.doc_id AND o.page = u.page AND (u.x0 + u.x1) / 2 BETWEEN o.x_start AND o.x_end AND (u.y0 + u.y1) / 2 < o.y_start AND (u.y0 + u.y1) / 2 BETWEEN 6 AND 94 WHERE o.above = 0 GROUP BY ALL) WHERE y_start - last <= 14 AND band >= 2)"""


@query(BARE + " SELECT doc_id, is_solution, q_num, 'tail' AS kind FROM tl UNION ALL SELECT doc_id, is_solution, q_num, 'head' FROM hd", boxes=BOXES, lines=BOX_LINES)
def uncovered_lines(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    items = with_segments(boxes)
    return review.undercovered(items, lines).withColumn("kind", F.lit("tail")).union(review.uncovered_heads(items, lines).withColumn("kind", F.lit("head")))


@query(BARE + """, op AS (SELECT u.doc_id, u.page, sum(u.y1 - u.y0) AS band FROM u WHERE (y0 + y1) / 2 BETWEEN 6 AND 94 AND NOT EXISTS (SELECT 1 FROM boxes s WHERE s.doc_id = u.doc_id AND s.page = u.page AND (u.x0 + u.x1) / 2 BETWEEN s.x_start AND s.x_end
  AND (u.y0 - s.y_end BETWEEN -1.5 AND 14 OR s.y_start - u.y1 BETWEEN -1.5 AND 14)) GROUP BY ALL) SELECT doc_id, page FROM op WHERE band >= 6""", boxes=BOXES, lines=BOX_LINES)
def orphan_pages(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    return review.orphan_pages(with_segments(boxes), lines)


@query(BARE.replace(", bare", OVERLAP + ", bare", 1) + """, m AS (SELECT *, y_end - y_start AS e, median(y_end - y_start) OVER (PARTITION BY doc_id, is_solution) AS med, row_number() OVER (PARTITION BY doc_id, is_solution, q_num::INT ORDER BY item_seq) AS r FROM boxes)
SELECT m.doc_id, m.item_seq, CASE WHEN r > 1 THEN 'duplicate' WHEN y_end >= 92 AND e <= 35 THEN 'page_edge' WHEN med > 0 AND e < 0.45 * med AND e < 50 THEN 'short' WHEN med > 0 AND e > 1.9 * med AND e >= 45 THEN 'tall' WHEN e < 4 THEN 'tiny'
 WHEN tl.doc_id IS NOT NULL THEN 'tail' WHEN hd.doc_id IS NOT NULL THEN 'head' WHEN o.doc_id IS NOT NULL THEN 'overlap' END AS flag
FROM m LEFT JOIN tl USING (doc_id, is_solution, q_num) LEFT JOIN hd USING (doc_id, is_solution, q_num) LEFT JOIN o USING (doc_id, is_solution, q_num)""", boxes=BOXES, lines=BOX_LINES)
def review_flags(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    return review.flags(with_segments(boxes), lines).select("doc_id", "item_seq", "flag")


@query(""", x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, is_solution, q_num::INT ORDER BY y_end - y_start DESC, item_seq) AS r, min(item_seq) OVER (PARTITION BY doc_id, is_solution, q_num::INT) AS place FROM boxes)
SELECT doc_id, item_seq, place FROM x WHERE r = 1""", boxes=BOXES)
def best_per_file(boxes: DataFrame) -> DataFrame:
    return dedup.best_per_file(with_segments(boxes)).select("doc_id", "item_seq", "place")


@query(""", i AS (SELECT a.doc_id, a.item_seq AS a, b.item_seq AS b, (least(a.x_end, b.x_end) - greatest(a.x_start, b.x_start)) * (least(a.y_end, b.y_end) - greatest(a.y_start, b.y_start)) AS x, (a.x_end - a.x_start) * (a.y_end - a.y_start) + (b.x_end - b.x_start) * (b.y_end - b.y_start) AS t
  FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.is_solution = b.is_solution AND a.page = b.page AND a.item_seq < b.item_seq AND least(a.x_end, b.x_end) > greatest(a.x_start, b.x_start) AND least(a.y_end, b.y_end) > greatest(a.y_start, b.y_start))
SELECT doc_id, a, b FROM i WHERE x / (t - x) >= 0.3""", boxes=BOXES)
def iou_pairs(boxes: DataFrame) -> DataFrame:
    return dedup.overlap_pairs(with_segments(boxes), 0.3)


#: A fold in SQL: `kept` holds what stays of a doc's items so far; `hit` is the first of these that the next item overlaps.
@query("""SELECT k.doc_id, k.item_seq, k.q_num, k.is_solution FROM (
  WITH RECURSIVE o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY item_seq) AS i, {'doc_id': doc_id, 'item_seq': item_seq, 'q_num': q_num, 'is_solution': is_solution, 'page': page, 'y0': y_start, 'y1': y_end, 'x0': x_start, 'x1': x_end} AS s FROM boxes),
  f AS (SELECT doc_id, i, [s] AS kept FROM o WHERE i = 1
    UNION ALL SELECT doc_id, i, CASE WHEN hit IS NULL THEN list_append(kept, s) WHEN s.y1 - s.y0 > kept[hit].y1 - kept[hit].y0 THEN list_concat(list_append(kept[1:hit - 1], s), kept[hit + 1:]) ELSE kept END
    FROM (SELECT o.doc_id, o.i, o.s, f.kept, list_filter(range(1, len(f.kept) + 1), lambda n: f.kept[n].page = o.s.page AND f.kept[n].is_solution = o.s.is_solution AND
        greatest(0, least(f.kept[n].x1, o.s.x1) - greatest(f.kept[n].x0, o.s.x0)) * greatest(0, least(f.kept[n].y1, o.s.y1) - greatest(f.kept[n].y0, o.s.y0))
        >= 0.3 * ((f.kept[n].x1 - f.kept[n].x0) * (f.kept[n].y1 - f.kept[n].y0) + (o.s.x1 - o.s.x0) * (o.s.y1 - o.s.y0)
          - greatest(0, least(f.kept[n].x1, o.s.x1) - greatest(f.kept[n].x0, o.s.x0)) * greatest(0, least(f.kept[n].y1, o.s.y1) - greatest(f.kept[n].y0, o.s.y0))))[1] AS hit FROM o JOIN f ON o.doc_id = f.doc_id AND o.i = f.i + 1))
  SELECT unnest(kept) AS k FROM (SELECT arg_max(kept, i) AS kept FROM f GROUP BY doc_id))""", boxes=BOXES)
def greedy_overlap(boxes: DataFrame) -> DataFrame:
    return dedup.dedup_overlaps(with_segments(boxes), 0.3).select("doc_id", "item_seq", "q_num", "is_solution")


@query(""", s AS (SELECT doc_id, is_solution, page, x, coalesce(x - lag(x) OVER w > 6, FALSE) AS new FROM values_ WINDOW w AS (PARTITION BY doc_id, is_solution, page ORDER BY x)),
c AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, is_solution, page ORDER BY x) AS g FROM s) SELECT doc_id, is_solution, page, min(x) AS margin, max(x) AS last, count(*) AS n FROM c GROUP BY doc_id, is_solution, page, g""",
    values_="SELECT user_id % 50 AS doc_id, event_type = 'click' AS is_solution, CAST(event_id % 4 AS INT) AS page, CAST(floor(value) % 400 AS DOUBLE) AS x FROM {events}")
def margin_cluster(values_: DataFrame) -> DataFrame:
    return lines.margin_clusters(values_, ["doc_id", "is_solution", "page"], 6.0).select("doc_id", "is_solution", "page", "margin", "last", "n")


MARKER_BOXES = f"""SELECT l_suppkey AS doc_id, CAST(1 + l_orderkey % 5 AS INT) AS page, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS INT) AS marker_seq, l_returnflag = 'R' AS is_solution, FALSE AS is_strong,
 CAST(l_linenumber + 3 * (l_orderkey % 3) AS STRING) AS q_num, CAST(40 + (l_partkey % 3) * 7 + (l_orderkey % 2) * 300 AS DOUBLE) AS x_left, CAST(l_partkey % 700 AS DOUBLE) AS y_top FROM {{lineitem}}"""


@query(""", a AS (SELECT doc_id, page, is_solution, x_left AS x FROM marks WHERE q_num::INT >= 6), s AS (SELECT *, coalesce(x - lag(x) OVER w > 6, FALSE)::INT AS new FROM a WINDOW w AS (PARTITION BY doc_id, page, is_solution ORDER BY x)), c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page, is_solution ORDER BY x) AS g FROM s),
m AS (SELECT doc_id, page, is_solution, list_sort(list(m)) AS ms FROM (SELECT doc_id, page, is_solution, g, min(x) AS m FROM c GROUP BY ALL) GROUP BY ALL)
SELECT k.doc_id, k.marker_seq FROM marks k LEFT JOIN m USING (doc_id, page, is_solution) WHERE ms IS NULL OR x_left <= coalesce(list_max(list_filter(ms, lambda v: x_left >= v - 9)), ms[1]) + 9""", marks=MARKER_BOXES)
def numbered_options(marks: DataFrame) -> DataFrame:
    return lines.drop_numbered_options(marks).select("doc_id", "marker_seq")


@query(""", s AS (SELECT doc_id, page, x_left, coalesce(x_left - lag(x_left) OVER w > 72, FALSE)::INT AS new FROM marks WINDOW w AS (PARTITION BY doc_id, page ORDER BY x_left)), c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY x_left) AS g FROM s),
b AS (SELECT doc_id, page, min(x_left) AS m FROM c GROUP BY doc_id, page, g HAVING count(*) >= 2), t AS (SELECT *, row_number() OVER w AS i, lead(m) OVER w AS nx, count(*) OVER (PARTITION BY doc_id, page) AS n FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY m))
SELECT doc_id, page, CASE WHEN i = 1 THEN 0 ELSE m - 6 END::DOUBLE AS x0, coalesce(nx - 6, 600)::DOUBLE AS x1 FROM t WHERE n >= 2""", marks=MARKER_BOXES)
def marker_columns(marks: DataFrame) -> DataFrame:
    pages = marks.select("doc_id", "page").distinct().withColumn("width", F.lit(600.0))
    return columns.from_markers(marks, pages).select("doc_id", "page", F.inline("columns"))


@query(""", c AS (SELECT doc_id, page, unnest(range(greatest(0, (least(x0, x1) / 0.5)::BIGINT), least(199, floor(greatest(x0, x1) / 0.5)::BIGINT) + 1)) AS bin FROM lines) SELECT doc_id, page, bin::INT AS bin, count(*)::INT AS n FROM c GROUP BY ALL""", lines=BOX_LINES)
def column_histogram(lines: DataFrame) -> DataFrame:
    return columns.coverage(lines.select("doc_id", "page", F.col("x0").alias("x_left"), F.col("x1").alias("x_right"), F.lit(100.0).alias("width")))


@query(""", c AS (SELECT doc_id, page, unnest(range((x0 / 0.5)::BIGINT, least(199, floor(x1 / 0.5)::BIGINT) + 1)) AS bin FROM lines), h AS (SELECT doc_id, page, bin, count(*) AS n FROM c GROUP BY ALL), d AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY doc_id, page) AS peak FROM h) WHERE n > greatest(1, peak * 0.18)),
s AS (SELECT *, coalesce(bin - lag(bin) OVER (PARTITION BY doc_id, page ORDER BY bin) - 1 >= 6, FALSE)::INT AS new FROM d), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY bin) AS g FROM s)
SELECT doc_id, page, min(bin)::INT AS first, max(bin)::INT AS last FROM g GROUP BY doc_id, page, g""", lines=BOX_LINES)
def column_cores(lines: DataFrame) -> DataFrame:
    return columns.cores(columns.coverage(lines.select("doc_id", "page", F.col("x0").alias("x_left"), F.col("x1").alias("x_right"), F.lit(100.0).alias("width"))))


@query(None, lines=BOX_LINES)
def column_detect(lines: DataFrame) -> DataFrame:
    pages = lines.select("doc_id", "page").distinct().withColumn("width", F.lit(100.0))
    return columns.detect(lines.select("doc_id", "page", F.col("x0").alias("x_left"), F.col("x1").alias("x_right")), pages).select("doc_id", "page", F.inline("columns"))


@query("SELECT doc_id, (s // 3)::INT AS batch, (s + 1)::INT AS first, least(s + 4, n_pages)::INT AS last FROM (SELECT doc_id, n_pages, unnest(range(0, n_pages, 3)) AS s FROM pages)", pages="SELECT page_id AS doc_id, CAST(1 + length(html) % 40 AS INT) AS n_pages FROM {pages}")
def batch_windows(pages: DataFrame) -> DataFrame:
    return lines.batches(pages)


@query(r""", n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) + 9 AS n, regexp_extract(original, '[^/]*$', 0) AS base FROM files), e AS (SELECT *, CASE WHEN regexp_matches(base, '^.+\.[^.]*$') THEN lower(regexp_extract(base, '\.([^.]*)$', 1)) ELSE '' END AS ext FROM n),
m AS (SELECT *, 'img_' || CASE WHEN n < 1000 THEN lpad((n // 2)::VARCHAR, 3, '0') ELSE (n // 2)::VARCHAR END AS stem FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, stem, ext ORDER BY seq) AS r FROM m)
SELECT session_id, seq, stem || CASE WHEN r > 1 THEN '_' || r ELSE '' END || CASE WHEN ext <> '' THEN '.' || ext ELSE '' END AS output_name FROM r""", files="SELECT CAST(p_size AS STRING) AS session_id, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS INT) AS seq, concat('a/b/', p_name, CASE p_partkey % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.tar.JPG' WHEN 2 THEN '' ELSE '.' END) AS original FROM {part}")
def rename_collisions(files: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("seq")) + 9
    base = F.format_string("img_%03d", F.floor(n / 2).cast("int"))
    ext = T.split_extension(F.col("original"))["ext"]
    named = files.withColumn("output_name", F.concat(base, F.when(ext != "", F.concat(F.lit("."), ext)).otherwise("")))
    return naming._suffixed(named, "output_name").select("session_id", "seq", "output_name")


@query(r""", n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) + 4 AS n, regexp_extract(original, '[^/]*$', 0) AS base FROM files)
SELECT session_id, seq, 'IMG_' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') || '_x' || CASE WHEN regexp_matches(base, '^.+\.[^.]+$') THEN '.' || lower(regexp_extract(base, '\.([^.]*)$', 1)) ELSE '' END AS output_name FROM n""", files="SELECT CAST(page_id % 7 AS STRING) AS session_id, CAST(page_id AS INT) AS seq, url AS original FROM {pages}")
def rename_plan(files: DataFrame) -> DataFrame:
    return naming.plan_renames(files, "IMG:#_x", 5, 4).select("session_id", "seq", "output_name")


SIZES = "SELECT l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS page, CAST(500 + l_partkey % 5 * 20 AS DOUBLE) + l_discount AS width, CAST(700 + l_suppkey % 4 * 30 AS DOUBLE) + l_tax AS height FROM {lineitem}"


@query(""", g AS (SELECT doc_id, round_even(width, 0)::INT AS w, round_even(height, 0)::INT AS h, count(*) AS n, arg_min(width, page * 100000 + width * 100 + height) AS width, min(page) AS p FROM pages GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w * h DESC, p) AS r FROM g)
SELECT doc_id, w, h, n FROM x WHERE r = 1""", pages=SIZES)
def modal_size(pages: DataFrame) -> DataFrame:
    mode = preflight.mode_size(pages).select("doc_id", F.bround("width").cast("int").alias("w"), F.bround("height").cast("int").alias("h"))
    counts = pages.groupBy("doc_id", F.bround("width").cast("int").alias("w"), F.bround("height").cast("int").alias("h")).agg(F.count("*").alias("n"))
    return mode.join(counts, ["doc_id", "w", "h"]).select("doc_id", "w", "h", "n")


@query("""SELECT doc_id, page, round_even(width * 25.4 / 72, 0)::INT || '×' || round_even(height * 25.4 / 72, 0)::INT || ' mm' || CASE WHEN abs(w - 210) <= 2 AND abs(h - 297) <= 2 OR abs(w - 297) <= 2 AND abs(h - 210) <= 2 THEN ' (A4)' WHEN abs(w - 297) <= 2 AND abs(h - 420) <= 2 OR abs(w - 420) <= 2 AND abs(h - 297) <= 2 THEN ' (A3)' WHEN abs(w - 216) <= 2 AND abs(h - 279) <= 2 OR abs(w - 279) <= 2 AND abs(h - 216) <= 2 THEN ' (Letter)'
 WHEN abs(w - 216) <= 2 AND abs(h - 356) <= 2 OR abs(w - 356) <= 2 AND abs(h - 216) <= 2 THEN ' (Legal)' WHEN abs(w - 148) <= 2 AND abs(h - 210) <= 2 OR abs(w - 210) <= 2 AND abs(h - 148) <= 2 THEN ' (A5)' ELSE '' END AS label
FROM (SELECT *, round_even(width * 25.4 / 72, 0) AS w, round_even(height * 25.4 / 72, 0) AS h FROM pages)""", pages="SELECT p_partkey AS doc_id, p_size AS page, CAST(594 + p_partkey % 3 * 9 AS DOUBLE) AS width, CAST(791 + p_partkey % 4 * 50 / 2 AS DOUBLE) AS height FROM {part}")
def size_labels(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", G.size_label(F.col("width"), F.col("height")).alias("label"))


@query(""", a AS (SELECT doc_id, count(*) AS n, count(CASE WHEN NOT is_solution THEN 1 END) AS c, count(DISTINCT CASE WHEN NOT is_solution THEN q_num::INT END) AS d, max(CASE WHEN NOT is_solution THEN q_num::INT END) - min(CASE WHEN NOT is_solution THEN q_num::INT END) + 1 AS span FROM items GROUP BY ALL)
SELECT p.doc_id, coalesce(n, 0) AS n_items, n_pages, coalesce(n, 0) / n_pages >= 0.5 AS sufficient, coalesce(n, 0) > 0 AND coalesce(n, 0) / n_pages >= 0.75 AND (coalesce(c, 0) < 3 OR d / span >= 0.8) AS confident FROM pages p LEFT JOIN a USING (doc_id)""",
    items=BOXES, pages="SELECT o_orderkey AS doc_id, CAST(1 + o_custkey % 8 AS INT) AS n_pages FROM {orders}")
def confidence_gate(items: DataFrame, pages: DataFrame) -> DataFrame:
    return tiers.gates(items, pages)


@query("""SELECT event_id AS doc_id, 'k' AS name, json_extract(props, '$.k')::INT AS num FROM events WHERE json_extract(props, '$.k') IS NOT NULL""", rows="SELECT event_id AS doc_id, props AS json FROM {events}")
def json_coerce(rows: DataFrame) -> DataFrame:
    read_ = rows.select("doc_id", F.explode(F.from_json(T.strip_fences(F.col("json")), "map<string,string>")).alias("name", "v"))
    return read_.select("doc_id", "name", F.col("v").try_cast("int").alias("num"))


@query("""SELECT doc_id, page, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY word_num, "left") AS text, min(top)::INT AS y_top, greatest(max(top + height), min(top) + 1)::INT AS y_bottom, min("left")::INT AS x_left, greatest(max("left" + width), min("left") + 1)::INT AS x_right FROM words WHERE conf >= 0 AND trim(text) <> '' GROUP BY ALL""",
    words="SELECT l_orderkey AS doc_id, 1 AS page, CAST(l_suppkey % 2 AS INT) AS block_num, 0 AS par_num, CAST(l_partkey % 3 AS INT) AS line_num, l_linenumber AS word_num, CAST(l_partkey % 100 AS INT) AS top, CAST(l_suppkey * 100 + l_partkey % 100 AS INT) AS `left`, 30 AS width, CAST(l_suppkey % 5 AS INT) AS height, l_discount * 1000 - 10 AS conf, concat('w', l_linenumber, '_', l_suppkey * 100 + l_partkey % 100) AS text FROM {lineitem}")
def words_to_lines(words: DataFrame) -> DataFrame:
    return lines.words_to_lines(words)


ORACLES["words_to_lines"] = ORACLES["words_to_lines"].replace("`left`", '"left"')


@query("SELECT doc_id, page, coalesce(round(avg(CASE WHEN conf >= 0 AND trim(text) <> '' THEN conf END), 6), 0) AS conf FROM words GROUP BY ALL", words="SELECT l_orderkey AS doc_id, CAST(l_suppkey % 2 AS INT) AS page, l_quantity - 5 AS conf, CASE WHEN l_partkey % 4 = 0 THEN ' ' ELSE 'word' END AS text FROM {lineitem}")
def page_confidence(words: DataFrame) -> DataFrame:
    return lines.page_confidence(words).withColumn("conf", F.round("conf", 6))


@query("""SELECT doc_id, coalesce(min(rung) FILTER (size <= 40000), arg_min(rung, size * 100 + rung)) AS rung, coalesce(arg_min(size, rung) FILTER (size <= 40000), min(size)) AS size, count(*) FILTER (size <= 40000) > 0 AS target_met FROM attempts GROUP BY ALL""",
    attempts=f"SELECT l_orderkey AS doc_id, CAST({ORDERED} AS INT) AS rung, CAST(floor(l_extendedprice) AS BIGINT) AS size FROM {{lineitem}}")
def compress_rung(attempts: DataFrame) -> DataFrame:
    return naming.choose_rung(attempts, 40000)


@query("SELECT session_id, seq, bytes, total FROM (SELECT *, (sum(bytes) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM files) WHERE total <= 300000", files=f"SELECT l_orderkey AS session_id, CAST({ORDERED} AS INT) AS seq, CAST(floor(l_extendedprice) AS BIGINT) AS bytes FROM {{lineitem}}")
def upload_ceiling(files: DataFrame) -> DataFrame:
    return lines.running_ceiling(files, 300000)


@query(""", w AS (SELECT *, max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM bands), g AS (SELECT *, sum(coalesce(y0 > far + 2, FALSE)::INT) OVER (PARTITION BY doc_id, page ORDER BY y0, y1) AS g FROM w)
SELECT doc_id, page, min(y0) AS y0, max(y1) AS y1 FROM g GROUP BY doc_id, page, g""", bands=BOX_LINES)
def band_merge(bands: DataFrame) -> DataFrame:
    return furniture.merge_bands(bands)


@query(""", x AS (SELECT e.doc_id, e.edit_seq, s.span_seq, greatest(0, least(e.x1, s.x1) - greatest(e.x0, s.x0)) * greatest(0, least(e.y1, s.y1) - greatest(e.y0, s.y0)) AS i, (e.x1 - e.x0) * (e.y1 - e.y0) + (s.x1 - s.x0) * (s.y1 - s.y0) AS t FROM edits e JOIN spans s ON e.doc_id = s.doc_id AND e.page = s.page),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, edit_seq ORDER BY i / (t - i) DESC, span_seq) AS r FROM x WHERE i > 0) SELECT doc_id, edit_seq, span_seq FROM r WHERE r = 1""",
    spans="SELECT doc_id, page, item_seq AS span_seq, y_start AS y0, y_end AS y1, x_start AS x0, x_end AS x1 FROM (" + BOXES + ") q", edits="SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, y1, x0, x1) AS INT) AS edit_seq, y0, y1, x0, x1 FROM (" + BOX_LINES + ") q")
def span_match(spans: DataFrame, edits: DataFrame) -> DataFrame:
    return dedup.best_span(spans, edits)


@query(""", n AS (SELECT doc_id, figure_seq, page, x_left / 600 AS a, y_top / 800 AS b, x_right / 600 AS c, y_bottom / 800 AS d FROM figures), m AS (SELECT x.doc_id, x.figure_seq FROM n x JOIN n y ON x.doc_id = y.doc_id AND abs(x.a - y.a) <= 0.02 AND abs(x.b - y.b) <= 0.02 AND abs(x.c - y.c) <= 0.02 AND abs(x.d - y.d) <= 0.02 GROUP BY ALL HAVING count(DISTINCT y.page) >= 3)
SELECT doc_id, page, figure_seq FROM figures WHERE (doc_id, figure_seq) NOT IN (SELECT doc_id, figure_seq FROM m)""",
    figures="SELECT CAST(o_custkey AS STRING) AS doc_id, CAST(o_orderkey % 5 AS INT) AS page, o_orderkey AS figure_seq, CAST(o_orderkey % 4 * 100 AS DOUBLE) AS x_left, CAST(o_orderkey % 3 * 100 + o_orderkey % 7 AS DOUBLE) AS y_top, CAST(o_orderkey % 4 * 100 + 90 AS DOUBLE) AS x_right, CAST(o_orderkey % 3 * 100 + 150 AS DOUBLE) AS y_bottom FROM {orders}")
def watermarks(figures: DataFrame) -> DataFrame:
    pages = figures.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return furniture.drop_watermarks(figures, pages).select("doc_id", "page", "figure_seq")


RANGES = "SELECT o_orderkey AS doc_id, concat(1 + o_orderkey % 9, CASE o_orderkey % 3 WHEN 0 THEN '-' WHEN 1 THEN ' to ' ELSE ', ' END, 1 + o_custkey % 12, ', 3') AS spec FROM {orders}"


@query(""", e AS (SELECT doc_id, 1 + doc_id % 9 AS a, regexp_extract(spec, '(?:-|to|,)\\s*(\\d+), 3$', 1)::INT AS b FROM docs), x AS (SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 2 THEN [a, b, 3] ELSE list_concat(range(least(a, b), greatest(a, b) + 1), [3]) END) AS p FROM e)
SELECT doc_id, count(DISTINCT p)::INT AS n, min(p)::INT AS first, max(p)::INT AS last FROM x WHERE p <= 10 GROUP BY doc_id""".replace("\\\\", "\\"), docs=RANGES)
def page_ranges(docs: DataFrame) -> DataFrame:
    p = docs.select("doc_id", T.page_ranges(F.col("spec"), F.lit(10)).alias("p"))
    return p.select("doc_id", F.size("p").alias("n"), F.array_min("p").alias("first"), F.array_max("p").alias("last"))


#: What several batches of pages found: each number's segments come more than once, some a little off.
BATCHES = BOXES.replace("l_orderkey AS doc_id, CAST(", "l_suppkey AS doc_id, CAST(").replace("PARTITION BY l_orderkey ORDER BY l_linenumber", "PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber")


@query("""SELECT doc_id, q_num, is_solution, len(kept)::INT AS n_segments, round(list_sum(list_transform(kept, lambda k: k.y1 - k.y0)), 4) AS extent FROM (
  WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, q_num, is_solution ORDER BY item_seq) AS i, {'page': page, 'y0': y_start, 'y1': y_end} AS s FROM boxes),
  f AS (SELECT doc_id, q_num, is_solution, i, [s] AS kept FROM o WHERE i = 1
    UNION ALL SELECT o.doc_id, o.q_num, o.is_solution, o.i, CASE WHEN len(list_filter(f.kept, lambda k: k.page = o.s.page AND abs(k.y0 - o.s.y0) < 3.0)) > 0 THEN f.kept ELSE list_append(f.kept, o.s) END
    FROM o JOIN f ON o.doc_id = f.doc_id AND o.q_num = f.q_num AND o.is_solution = f.is_solution AND o.i = f.i + 1)
  SELECT doc_id, q_num, is_solution, arg_max(kept, i) AS kept FROM f GROUP BY ALL)""", boxes=BATCHES)
def batch_merge(boxes: DataFrame) -> DataFrame:
    return dedup.merge_batches(with_segments(boxes)).select("doc_id", "q_num", "is_solution", F.size("segments").alias("n_segments"), F.round(G.extent(F.col("segments")), 4).alias("extent"))


PAPER = f"""SELECT CAST(l_suppkey AS STRING) AS doc_id, CAST(1 + l_orderkey % 7 AS INT) AS page, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS INT) AS line_seq,
 CASE WHEN l_partkey % 3 = 0 THEN concat(CASE WHEN l_partkey % 5 = 0 THEN 'Z' ELSE CAST(l_linenumber AS STRING) END, '. stem ', l_partkey) ELSE concat('(', substring('ABCD', CAST(1 + l_partkey % 4 AS INT), 1), ') option ', l_suppkey) END AS text,
 CAST(l_partkey % 780 AS DOUBLE) AS y_top, CAST(l_partkey % 780 + 10 AS DOUBLE) AS y_bottom, CAST(30 + l_orderkey % 2 * 300 AS DOUBLE) AS x_left, CAST(270 + l_orderkey % 2 * 300 AS DOUBLE) AS x_right FROM {{lineitem}}"""


def paper(lines_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    marks = lines_.withColumn("m", T.marker(F.col("text"))).where("m is not null").select("doc_id", "page", F.col("line_seq").alias("marker_seq"), "y_top", "m.q_num", F.lit(False).alias("is_solution"), "x_left", "x_right", "m.is_strong")
    pages = lines_.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return lines_, marks, pages


@query(None, lines_=PAPER)
def build_items(lines_: DataFrame) -> DataFrame:
    body, marks, pages = paper(lines_)
    out = regions.build_items(body, marks, pages)
    return out.select("doc_id", "item_seq", "q_num", "is_solution", "option_labels", F.size("segments").alias("n_segments"), F.round(G.extent(F.col("segments")), 4).alias("extent"))


#: Numbered lines of which some have letters for their digits.
MISREAD = f"""SELECT CAST(l_orderkey AS STRING) AS doc_id, 1 AS page, CAST({ORDERED} AS INT) AS line_seq, CAST(20 * l_linenumber AS DOUBLE) AS y_top, CAST(30 AS DOUBLE) AS x_left, CAST(270 AS DOUBLE) AS x_right,
 concat(CASE WHEN l_partkey % 3 = 0 THEN translate(CAST(l_linenumber AS STRING), '1234567', 'IZEASbT') ELSE CAST(l_linenumber AS STRING) END, '. stem') AS text FROM {{lineitem}}"""


@query(None, lines_=MISREAD)
def gap_recovery(lines_: DataFrame) -> DataFrame:
    marks = lines_.withColumn("m", T.marker(F.col("text"))).where("m is not null").select("doc_id", "page", F.col("line_seq").alias("marker_seq"), "y_top", "m.q_num", F.lit(False).alias("is_solution"), "x_left", "x_right", "m.is_strong")
    return lines.recover_markers(marks, lines_).select("doc_id", "page", "y_top", "q_num")


@query("""SELECT doc_id, marker_seq, page, q_num FROM (
  WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y_top, marker_seq) AS i FROM marks),
  f AS (SELECT doc_id, i, marker_seq, page, q_num, TRUE AS keep, page AS lp, q_num AS lq, is_solution AS ls, y_top AS ly FROM o WHERE i = 1
    UNION ALL SELECT o.doc_id, o.i, o.marker_seq, o.page, o.q_num, NOT same, CASE WHEN same THEN lp ELSE o.page END, CASE WHEN same THEN lq ELSE o.q_num END, CASE WHEN same THEN ls ELSE o.is_solution END, CASE WHEN same THEN ly ELSE o.y_top END
    FROM (SELECT o.*, f.lp, f.lq, f.ls, f.ly, o.page = f.lp AND o.q_num = f.lq AND o.is_solution = f.ls AND abs(o.y_top - f.ly) < 2 AS same FROM o JOIN f ON o.doc_id = f.doc_id AND o.i = f.i + 1) o)
  SELECT * FROM f WHERE keep)""", marks=MARKER_BOXES)
def marker_dedup(marks: DataFrame) -> DataFrame:
    return lines.dedup_consecutive(marks).select("doc_id", "marker_seq", "page", "q_num")


@query(None, boxes=BOXES, lines=BOX_LINES)
def review_notes(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    return review.notes(with_segments(boxes), lines)


SHAPES = f"""SELECT l_orderkey AS doc_id, CAST(1 + l_suppkey % 2 AS INT) AS page, CAST({ORDERED} AS INT) AS seq, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey * 37 % 780 AS DOUBLE) AS y0,
 CAST(l_partkey % 500 + CASE l_partkey % 3 WHEN 0 THEN 3 ELSE 4 * l_quantity END AS DOUBLE) AS x1, CAST(l_suppkey * 37 % 780 + CASE l_partkey % 3 WHEN 1 THEN 2 ELSE 5 * l_linenumber * l_linenumber END AS DOUBLE) AS y1,
 CAST(600 AS DOUBLE) AS width, CAST(800 AS DOUBLE) AS height FROM {{lineitem}}"""


@query(r"""SELECT doc_id, seq, 'image' AS kind FROM shapes WHERE x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) >= 0.0008 * 480000 AND NOT (y1 / 800 <= 0.07 OR y0 / 800 >= 0.93)
UNION ALL SELECT doc_id, seq, 'rule' FROM shapes WHERE (x1 - x0 <= 24 AND y1 - y0 >= 144 OR y1 - y0 <= 32 AND x1 - x0 >= 108) AND (x1 > x0 OR y1 > y0)""", shapes=SHAPES)
def shape_filters(shapes: DataFrame) -> DataFrame:
    from vellum.operators import branding as B

    return B.figure_images(shapes).select("doc_id", "seq", F.lit("image").alias("kind")).union(B.long_rules(shapes).select("doc_id", "seq", F.lit("rule")))


@query(r""", c AS (SELECT * FROM shapes WHERE x1 - x0 >= 24 AND y1 - y0 >= 24 AND NOT (x1 - x0 >= 576 AND y1 - y0 >= 736)), t AS (SELECT doc_id, page, x0 * 6 AS x0, x1 * 6 AS x1, y0 * 8 AS y0, y1 * 8 AS y1 FROM lines),
b AS (SELECT c.doc_id, c.seq FROM c JOIN t ON c.doc_id = t.doc_id AND c.page = t.page AND least(c.x1, t.x1) > greatest(c.x0, t.x0) AND least(c.y1, t.y1) > greatest(c.y0, t.y0) GROUP BY ALL
  HAVING count(*) > 3 OR sum((least(c.x1, t.x1) - greatest(c.x0, t.x0)) * (least(c.y1, t.y1) - greatest(c.y0, t.y0))) / max((c.x1 - c.x0) * (c.y1 - c.y0)) > 0.18)
SELECT doc_id, seq FROM c WHERE (doc_id, seq) NOT IN (SELECT doc_id, seq FROM b)""", shapes=SHAPES, lines=BOX_LINES)
def figure_clusters(shapes: DataFrame, lines: DataFrame) -> DataFrame:
    from vellum.operators import branding as B

    scaled = lines.select("doc_id", "page", *[(F.col(c) * (6 if c[0] == "x" else 8)).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return B.figure_clusters(shapes.withColumnRenamed("seq", "cluster_seq"), scaled).select("doc_id", F.col("cluster_seq").alias("seq"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)android\s*app|ios\s*app|download\s*app|play\s*store|app\s*store') AS brand, list_has_any(list_transform(['play.google.com', 'apps.apple.com', 'itunes.apple.com', 'onelink.me', 'bit.ly', 'linktr.ee'], lambda h: contains(lower(uri), h)), [TRUE]) AS link,
 regexp_matches(trim(text), '(?i)^(?:page\s*)?\d{1,3}\s*(?:/|of)\s*\d{1,3}$') AND (top <= 8 OR top + 2 >= 80) AS strip FROM rows_""",
    rows_="SELECT page_id AS doc_id, CASE page_id % 5 WHEN 0 THEN 'Get the Android  App | x' WHEN 1 THEN concat(page_id % 90, ' of 99') WHEN 2 THEN concat('Page ', page_id % 90, '/99') WHEN 3 THEN 'appstore' ELSE url END AS text, CASE page_id % 3 WHEN 0 THEN concat(url, '?u=Bit.ly') WHEN 1 THEN url ELSE '' END AS uri, CAST(page_id % 100 AS DOUBLE) AS top FROM {pages}")
def branding_lines(rows_: DataFrame) -> DataFrame:
    from vellum.operators import branding as B

    t = F.col("text")
    return rows_.select("doc_id", B.is_branding_text(t).alias("brand"), B.is_branding_uri(F.col("uri")).alias("link"), B.is_margin_strip(t, F.col("top"), F.col("top") + 2).alias("strip"))


@query("SELECT doc_id, answered, n FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (answer <> '') AS answered FROM sheet GROUP BY ALL)", sheet="SELECT CAST(o_custkey AS STRING) AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN '' ELSE 'A' END AS answer FROM {orders}")
def answered_count(sheet: DataFrame) -> DataFrame:
    return answers.count_answered(sheet).select("doc_id", "answered", "n")


@query("SELECT doc_id, CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS verdict FROM checks GROUP BY ALL", checks="SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 11 = 0 THEN 'fail' WHEN o_orderkey % 3 = 0 THEN 'warn' ELSE 'pass' END AS status FROM {orders}")
def preflight_verdicts(checks: DataFrame) -> DataFrame:
    return preflight.verdicts(checks)


@query("SELECT doc_id, arg_max(width, area * 1000000 - page) AS width, arg_max(height, area * 1000000 - page) AS height FROM (SELECT *, width * height AS area FROM pages) GROUP BY ALL", pages="SELECT p_size AS doc_id, p_partkey AS page, CAST(500 + p_partkey % 7 * 20 AS DOUBLE) AS width, CAST(700 + p_partkey % 5 * 30 AS DOUBLE) AS height FROM {part}")
def largest_page(pages: DataFrame) -> DataFrame:
    return preflight.largest_page(pages)


@query("""SELECT job_id, 'solutions' AS archive, file FROM files WHERE NOT is_sidecar AND is_solution UNION ALL SELECT job_id, 'questions', file FROM files WHERE NOT is_sidecar AND NOT is_solution
UNION ALL SELECT job_id, 'questions', file FROM files f WHERE is_sidecar AND EXISTS (SELECT 1 FROM files q WHERE q.job_id = f.job_id AND NOT q.is_sidecar AND NOT q.is_solution)
UNION ALL SELECT job_id, 'combined', file FROM files f WHERE NOT is_sidecar OR EXISTS (SELECT 1 FROM files q WHERE q.job_id = f.job_id AND NOT q.is_sidecar AND NOT q.is_solution)""",
    files="SELECT o_custkey AS job_id, concat('f', o_orderkey) AS file, o_custkey % 5 = 0 OR o_orderkey % 2 = 0 AS is_solution, o_orderkey % 7 = 0 AS is_sidecar FROM {orders}")
def archive_manifest(files: DataFrame) -> DataFrame:
    return naming.archive_manifest(files)


SPANNED = "SELECT o_orderkey AS doc_id, CAST(1 AS INT) AS item_seq, CAST(o_orderkey AS STRING) AS q_num, o_custkey % 2 = 0 AS is_solution, CAST(1 + o_custkey % 9 AS INT) AS page FROM {orders}"


def _ranged(rows: DataFrame, *args) -> DataFrame:
    seg = F.array(F.struct("page", *[F.lit(float(v)).alias(c) for c, v in (("y_start", 0), ("y_end", 9), ("x_start", 0), ("x_end", 9))]))
    return dedup.apply_ranges(rows.withColumn("segments", seg), *args).select("doc_id", "is_solution")


@query("""SELECT doc_id, is_solution, 'both' AS given FROM (SELECT doc_id, page IN (4, 5) AS is_solution FROM rows_ WHERE page IN (1, 2, 3, 4, 5))
UNION ALL SELECT doc_id, CASE WHEN page IN (4, 5) THEN TRUE ELSE is_solution END, 'answers' FROM rows_
UNION ALL SELECT doc_id, FALSE, 'strict' FROM rows_ WHERE page IN (1, 2)
UNION ALL SELECT doc_id, is_solution, 'none' FROM rows_""", rows_=SPANNED)
def page_filter(rows_: DataFrame) -> DataFrame:
    """Both ranges drop the rest; one relabels; strict drops with one; none changes nothing."""
    cases = (("both", ([1, 2, 3, 4], [4, 5])), ("answers", ([], [4, 5])), ("strict", ([1, 2], [], True)), ("none", ([], [])))
    parts = [_ranged(rows_, *args).withColumn("given", F.lit(name)) for name, args in cases]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("""SELECT doc_id, level, original_size, made_size, CASE level WHEN 'light' THEN 200 WHEN 'strong' THEN 100 WHEN 'extreme' THEN 72 ELSE 150 END AS dpi, CASE level WHEN 'light' THEN 85 WHEN 'strong' THEN 55 WHEN 'extreme' THEN 40 ELSE 72 END AS quality,
  least(original_size, made_size) AS size, made_size >= original_size AS kept_original FROM files""",
    files="SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN 'light' WHEN 1 THEN 'balanced' WHEN 2 THEN 'strong' WHEN 3 THEN 'extreme' ELSE 'unknown' END AS level, o_custkey AS original_size, o_custkey * (o_orderkey % 5) AS made_size FROM {orders}")
def compress_result(files: DataFrame) -> DataFrame:
    return naming.compressed(files)


PAGED = "SELECT p_partkey AS doc_id, concat('paper', p_partkey) AS stem, CAST(p_size * (p_partkey % 3) AS INT) AS n_pages FROM {part}"


@query("""SELECT doc_id, page::INT AS page, stem || '_p' || lpad(page::VARCHAR, greatest(2, length(n_pages::VARCHAR))::INT, '0') || '.png' AS name FROM (SELECT *, unnest(range(1, n_pages + 1)) AS page FROM docs)""", docs=PAGED)
def page_image_names(docs: DataFrame) -> DataFrame:
    return naming.page_images(docs)


@query("SELECT doc_id, page::INT AS page FROM (SELECT doc_id, unnest(range(greatest(1, n_pages - 5), n_pages + 1)) AS page FROM docs WHERE n_pages > 0)", docs=PAGED)
def key_pages(docs: DataFrame) -> DataFrame:
    return naming.key_pages(docs)


#: Docs whose numbers are 1 to 7 with holes, and lines that name the holes, some misread; `named` is what the rule for holes asks for.
HOLED = f"""SELECT CAST(l_orderkey AS STRING) AS doc_id, CAST({ORDERED} AS INT) AS num, l_partkey % 3 = 0 AS lost FROM {{lineitem}}"""


@query("""SELECT doc_id, FALSE AS is_solution, n::INT AS num FROM (
  SELECT doc_id, unnest(list_filter(range(low, high + 1), lambda x: NOT list_contains(have, x))) AS n, low, high, c FROM (
    SELECT doc_id, min(num) AS low, max(num) AS high, list(num) AS have, count(*) AS c FROM rows_ WHERE NOT lost GROUP BY doc_id))
WHERE c >= 3 AND high - low + 1 - c <= greatest(3, (high - low) // 3)""", rows_=HOLED)
def wanted_numbers(rows_: DataFrame) -> DataFrame:
    return lines.wanted_numbers(rows_.where("not lost").select("doc_id", F.lit(False).alias("is_solution"), "num"))


BOUNDED = "SELECT l_suppkey AS doc_id, l_linenumber AS page, CAST(l_orderkey % 2 AS INT) AS col, CAST(l_partkey % 300 AS DOUBLE) AS x_left, CAST(l_partkey % 300 + l_quantity - 9 AS DOUBLE) AS x_right FROM {lineitem}"


@query("SELECT doc_id, page, col, min(x_left) AS x0, max(x_right) AS x1 FROM rows_ WHERE x_right > x_left GROUP BY ALL", rows_=BOUNDED)
def content_bounds(rows_: DataFrame) -> DataFrame:
    return columns.content_bounds(rows_)


@query("SELECT doc_id, page, y_top / height * 100 AS y0, y_bottom / height * 100 AS y1, x_left / width * 100 AS x0, x_right / width * 100 AS x1 FROM rows_ JOIN pages USING (doc_id, page) WHERE trim(text) <> '' AND width > 0 AND height > 0",
    rows_="SELECT l_orderkey AS doc_id, l_linenumber AS page, CASE WHEN l_partkey % 4 = 0 THEN ' ' ELSE 'word' END AS text, CAST(l_partkey % 700 AS DOUBLE) AS y_top, CAST(l_partkey % 700 + 11 AS DOUBLE) AS y_bottom, CAST(l_suppkey % 50 AS DOUBLE) AS x_left, CAST(l_suppkey % 50 + 90 AS DOUBLE) AS x_right FROM {lineitem}",
    pages="SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page, CAST(595 AS DOUBLE) AS width, CAST(CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 842 END AS DOUBLE) AS height FROM {lineitem}")
def page_percent(rows_: DataFrame, pages: DataFrame) -> DataFrame:
    return lines.page_percent(rows_, pages)


@query("SELECT doc_id FROM files WHERE regexp_matches(original, '.\\.(png|jpe?g|gif|bmp|webp|tiff?)$', 'i')",
    files="SELECT o_orderkey AS doc_id, concat('scan', o_custkey, CASE o_orderkey % 7 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.pdf' WHEN 3 THEN '' WHEN 4 THEN '.tar.webp' WHEN 5 THEN '.' ELSE '.tif' END) AS original FROM {orders}")
def allowed_files(files: DataFrame) -> DataFrame:
    return naming.allowed(files).select("doc_id")


@query("SELECT doc_id, CASE WHEN trim(coalesce(q_num, '')) = '' THEN '0' ELSE trim(q_num) END AS q_num, coalesce(is_solution, FALSE) AS is_solution, n::INT AS n, CASE WHEN coalesce(source, '') = '' THEN 'auto' ELSE source END AS source FROM rows_ WHERE n > 0",
    rows_="SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN ' 7 ' ELSE CAST(o_custkey AS STRING) END AS q_num, CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS is_solution, CAST(o_orderkey % 3 AS INT) AS n, CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'manual' END AS source FROM {orders}")
def detected_items(rows_: DataFrame) -> DataFrame:
    return dedup.detected(rows_.withColumn("segments", F.array_repeat(F.lit(1.0), F.col("n")))).select("doc_id", "q_num", "is_solution", F.size("segments").alias("n"), "source")


@query("SELECT doc_id, 'p' || page || '_b' || block || '_l' || line || '_s' || span AS id, page, text, round_even(x0, 2) AS x0, round_even(y0, 2) AS y0, round_even(x1, 2) AS x1, round_even(y1, 2) AS y1, round_even(size, 2) AS size, coalesce(flags, 0) // 16 % 2 = 1 AS bold, coalesce(flags, 0) // 2 % 2 = 1 AS italic FROM spans WHERE trim(text) <> ''",
    spans="SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey % 4 AS block, l_suppkey % 3 AS line, l_partkey % 2 AS span, CASE WHEN l_partkey % 6 = 0 THEN '  ' ELSE concat('run ', l_partkey) END AS text, CAST(l_partkey % 500 AS DOUBLE) / 8 AS x0, CAST(l_suppkey % 70 AS DOUBLE) / 8 AS y0, CAST(l_partkey % 900 AS DOUBLE) / 8 AS x1, CAST(9 AS DOUBLE) AS y1, CAST(l_suppkey % 9 AS DOUBLE) / 8 AS size, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(l_partkey % 32 AS INT) END AS flags FROM {lineitem}")
def editable_spans(spans: DataFrame) -> DataFrame:
    return branding.editable_spans(spans)


@query("""SELECT doc_id, 'a4' AS spec, CASE WHEN 2 * n_wide > n THEN 841.89::DOUBLE ELSE 595.28::DOUBLE END AS width, CASE WHEN 2 * n_wide > n THEN 595.28::DOUBLE ELSE 841.89::DOUBLE END AS height FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (width > height) AS n_wide FROM pages GROUP BY ALL)
UNION ALL SELECT DISTINCT doc_id, 'custom:254x127', 720::DOUBLE, 360::DOUBLE FROM pages""", pages="SELECT l_suppkey AS doc_id, l_linenumber AS page, CAST(l_partkey % 900 AS DOUBLE) AS width, CAST(l_orderkey % 900 AS DOUBLE) AS height FROM {lineitem}")
def target_sizes(pages: DataFrame) -> DataFrame:
    a, b = (preflight.target_size(pages, s).withColumn("spec", F.lit(s)) for s in ("a4", "custom:254x127"))
    return a.unionByName(b)


@query("""SELECT doc_id, page, (tw - width * k) / 2 AS x0, (th - height * k) / 2 AS y0, (tw + width * k) / 2 AS x1, (th + height * k) / 2 AS y1, abs(width - tw) > 1 OR abs(height - th) > 1 AS moved
FROM (SELECT doc_id, page, p.width, p.height, t.width AS tw, t.height AS th, least(t.width / p.width, t.height / p.height) AS k FROM pages p JOIN target t USING (doc_id))""",
    pages="SELECT p_partkey AS doc_id, p_size AS page, CAST(500 + p_partkey % 9 * 20 AS DOUBLE) AS width, CAST(700 + p_partkey % 7 * 20 AS DOUBLE) AS height FROM {part}", target="SELECT p_partkey AS doc_id, CAST(540.5 AS DOUBLE) AS width, CAST(760 AS DOUBLE) AS height FROM {part}")
def page_placement(pages: DataFrame, target: DataFrame) -> DataFrame:
    return preflight.placement(pages, target)


@query("""SELECT f.doc_id, c AS check_id, status, n::BIGINT AS n, worst::DOUBLE AS worst, coalesce(names, '') AS names FROM files f
LEFT JOIN (SELECT doc_id, count(*) AS nf, count(*) FILTER (NOT e) AS nl, array_to_string(list_sort(list(DISTINCT b) FILTER (NOT e))[1:6], ', ') AS loose FROM (SELECT doc_id, xref, basefont AS b, bool_and(embedded) AS e FROM fonts GROUP BY ALL) GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS ni, count(*) FILTER (dpi > 0 AND dpi < 72) AS low, count(*) FILTER (dpi >= 72 AND dpi < 150) AS fair, min(dpi) FILTER (dpi > 0) AS least_dpi, count(*) FILTER (colorspace ILIKE '%rgb%') AS rgb FROM images GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(DISTINCT label) AS ns, array_to_string(list_sort(list(DISTINCT label))[1:4], ', ') AS sizes, sum(length(trim(text))) FILTER (page <= 5) AS chars FROM (SELECT *, CASE width WHEN 595 THEN '210×297 mm (A4)' WHEN 612 THEN '216×279 mm (Letter)' ELSE '141×141 mm' END AS label FROM pages) GROUP BY doc_id) USING (doc_id),
LATERAL (SELECT 'encryption' AS c, CASE WHEN encrypted THEN 'fail' ELSE 'ok' END AS status, encrypted::INT AS n, NULL AS worst, '' AS names
UNION ALL SELECT 'fonts_embedded', CASE WHEN nl > 0 THEN 'fail' WHEN nf > 0 THEN 'ok' ELSE 'info' END, CASE WHEN nl > 0 THEN nl ELSE coalesce(nf, 0) END, NULL, loose
UNION ALL SELECT 'image_dpi', CASE WHEN low > 0 THEN 'fail' WHEN fair > 0 THEN 'warn' WHEN ni > 0 THEN 'ok' ELSE 'info' END, CASE WHEN low > 0 THEN low WHEN fair > 0 THEN fair ELSE coalesce(ni, 0) END, CASE WHEN low > 0 OR fair > 0 THEN least_dpi END, ''
UNION ALL SELECT 'colorspace', CASE WHEN rgb > 0 THEN 'warn' ELSE 'ok' END, coalesce(rgb, 0), NULL, ''
UNION ALL SELECT 'page_sizes', CASE WHEN ns > 1 THEN 'warn' ELSE 'ok' END, coalesce(ns, 0), NULL, sizes
UNION ALL SELECT 'text_layer', CASE WHEN chars > 50 THEN 'ok' ELSE 'info' END, (coalesce(chars, 0) > 50)::INT, NULL, '') x""",
    files="SELECT p_partkey AS doc_id, p_partkey % 7 = 0 AS encrypted FROM {part}",
    fonts="SELECT l_partkey AS doc_id, l_linenumber AS page, l_suppkey % 5 AS xref, concat('Font', l_suppkey % 5) AS basefont, (l_suppkey % 5 + l_partkey) % 4 <> 0 OR l_partkey % 3 = 0 AS embedded FROM {lineitem} WHERE l_partkey % 11 <> 0",
    images="SELECT o_custkey AS doc_id, CAST(CASE o_custkey % 3 WHEN 0 THEN o_orderkey % 400 WHEN 1 THEN 72 + o_orderkey % 100 ELSE 150 + o_orderkey % 9 END AS DOUBLE) AS dpi, CASE o_custkey % 4 WHEN 0 THEN 'DeviceRGB' WHEN 1 THEN NULL ELSE 'DeviceCMYK' END AS colorspace FROM {orders}",
    pages="SELECT l_partkey AS doc_id, l_linenumber AS page, CAST(CASE WHEN l_partkey % 2 = 0 OR l_suppkey % 3 = 0 THEN 595 WHEN l_suppkey % 3 = 1 THEN 612 ELSE 400 END AS DOUBLE) AS width, CAST(CASE WHEN l_partkey % 2 = 0 OR l_suppkey % 3 = 0 THEN 842 WHEN l_suppkey % 3 = 1 THEN 792 ELSE 400 END AS DOUBLE) AS height, CASE WHEN l_partkey % 3 = 0 THEN ' ab ' ELSE concat('words of ', l_orderkey) END AS text FROM {lineitem}")
def preflight_report(files: DataFrame, fonts: DataFrame, images: DataFrame, pages: DataFrame) -> DataFrame:
    return preflight.report(files, fonts, images, pages)
