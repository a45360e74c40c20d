"""Scalar rules against values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T


def values(spark, texts, *exprs):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", *[e.alias(f"e{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()
    return [tuple(r[1:]) if len(exprs) > 1 else r[1] for r in rows]


def test_markers(spark):
    texts = ["Q1. What", "Ques 12 x", "Question No. 007", "3) Of", "4.", "2.5 m", "2024", "5 . (a)", "This", "", None, "000. x"]
    found = [m and (m["q_num"], m["is_strong"]) for m in values(spark, texts, T.marker(F.col("t")))]
    assert found == [("1", True), ("12", True), ("7", True), ("3", False), ("4", False), None, None, ("5", False), None, None, None, ("0", False)]
    assert [m and m["q_num"] for m in values(spark, ["Q1", "2."], T.marker(F.col("t"), "q"))] == ["1", None]
    assert [m and m["q_num"] for m in values(spark, ["Q1", "2."], T.marker(F.col("t"), "numbered"))] == [None, "2"]


def test_predicates(spark):
    t = F.col("t")
    assert values(spark, ["Answer Key:", "Hints & Solutions", "the solution", None], T.is_solution_header(t)) == [True, True, False, False]
    assert values(spark, ["PART-II (X)", "Section A", "This section contains 4", "part of it", "Parting"], T.is_section_header(t)) == [True, True, True, False, False]
    assert values(spark, ["5", "5/5", "Page 5 of 10", "- 5 -", "12345", "5 apples"], T.is_folio(t)) == [True, True, True, True, False, False]
    assert values(spark, ["1. (1)", "2-B", "10 (e)", "1. (1) and"], T.is_key_cell(t)) == [True, True, True, False]
    assert values(spark, ["(A) x", "b. y", "Apple"], T.starts_with_option(t)) == [True, True, False]


def test_letters_pairs_answers(spark):
    t = F.col("t")
    assert values(spark, ["(A) one B) two", "c. x (a)", "Acceleration", "A)B)"], T.option_letters(t)) == ["AB", "AC", "", "AB"]
    pairs = values(spark, ["1-B 2-A 3-D 4-C", "1. (b)  2. (a)", "Q.5 c, 1000 a", "word"], T.key_pairs(t))
    assert [[(p["num"], p["letter"]) for p in x] for x in pairs] == [[(1, "B"), (2, "A"), (3, "D"), (4, "C")], [(1, "B"), (2, "A")], [(5, "C")], []]
    assert values(spark, ["Ans. (C) so (A)", "Correct option: d", "see (B)", None], T.labelled_answer(t)) == ["C", "D", None, None]
    assert values(spark, ["2O.", "Z0)", "l", "This", "12345", ""], T.misread_number(t)) == [20, 20, 1, None, None, None]
    assert values(spark, ["2O. x", "20.2.5 y", "21 z", ""], T.matches_number(t, F.lit(20))) == [True, True, False, False]


def test_names(spark):
    t = F.col("t")
    assert [(x["stem"], x["ext"]) for x in values(spark, ["Photo.JPG", "a/b.tar.gz", ".bashrc", "plain", None], T.split_extension(t))] == [("Photo", "jpg"), ("b.tar", "gz"), (".bashrc", ""), ("plain", ""), ("", "")]
    assert values(spark, ["x.PNG", "y"], T.renamed(t, "a:#", F.lit(7), 3)) == ["a_007.png", "a_007"]
    assert values(spark, ["x.PNG"], T.renamed(t, "img", F.lit(1234), 3)) == ["img1234.png"]
    assert values(spark, ["Q7", "none"], T.output_file(t, F.lit(True), 5, "JPEG")) == ["S011.jpg", "S004.jpg"]


def test_page_ranges(spark):
    t = F.col("t")
    assert values(spark, ["1-5, 8", "3 TO 1", "", None, "99, 0"], T.page_ranges(t, F.lit(10))) == [[1, 2, 3, 4, 5, 8], [1, 2, 3], [], [], []]
    with pytest.raises(Exception, match="Invalid page range"):
        values(spark, ["12345678901x"], T.page_ranges(t, F.lit(10)))
    assert values(spark, ["12345678901", "9 - 12345678901", "1-2000000000", "0007"], T.page_ranges(t, F.lit(10))) == [[], [9, 10], list(range(1, 11)), [7]]
    with pytest.raises(Exception, match="Invalid page range"):
        values(spark, ["1-x"], T.page_ranges(t))


def test_geometry(spark):
    row = spark.sql("""SELECT named_struct('page', 1, 'y_start', 0D, 'y_end', 10D, 'x_start', 0D, 'x_end', 10D) a, named_struct('page', 1, 'y_start', 5D, 'y_end', 15D, 'x_start', 0D, 'x_end', 10D) b,
      array(named_struct('x0', 0D, 'x1', 10D), named_struct('x0', 20D, 'x1', 30D)) c""")
    got = row.select(G.iou(F.col("a"), F.col("b")), G.extent(F.array("a", "b")), G.column_index(F.col("c"), F.lit(16.0), F.lit(18.0)), G.column_index(F.col("c"), F.lit(10.0), F.lit(10.0)), G.column_index(F.col("c"), F.lit(1.0), F.lit(2.0)), G.size_label(F.lit(595.28), F.lit(841.89)), G.clamp_percent(F.lit(120.0))).first()
    assert got[0] == pytest.approx(1 / 3) and tuple(got[1:]) == (20.0, 1, 0, 0, "210×297 mm (A4)", 100.0)
