"""Operators on small relations made by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vellum.operators import answers, columns, dedup, furniture, lines, naming, preflight, review
from vellum.plans import regions, tiers

LINE = "doc_id string, page int, line_seq int, y_top double, y_bottom double, x_left double, x_right double, text string"
MARK = "doc_id string, page int, marker_seq int, y_top double, q_num string, is_solution boolean, x_left double, x_right double, is_strong boolean"
ITEM = "doc_id string, item_seq int, q_num string, is_solution boolean, segments array<struct<page:int,y_start:double,y_end:double,x_start:double,x_end:double>>"


def items(spark, *rows):
    return spark.createDataFrame([("d", i, str(n), side, [(p, float(a), float(b), float(c), float(e)) for p, a, b, c, e in segs]) for i, (n, side, segs) in enumerate(rows)], ITEM)


def box(page, a, b, c=0, e=100):
    return [(page, a, b, c, e)]


def test_sticky_section_drops_only_the_first_header(spark):
    rows = spark.createDataFrame([("d", 1, "1. x"), ("d", 2, "Solutions"), ("d", 3, "1. y"), ("d", 4, "Answers"), ("e", 1, "z")], "doc_id string, n int, text string")
    from vellum.functions.text import is_solution_header

    got = lines.sticky_section(rows, is_solution_header(F.col("text")), ["n"]).orderBy("doc_id", "n").collect()
    assert [(r.doc_id, r.n, r.is_solution) for r in got] == [("d", 1, False), ("d", 3, True), ("d", 4, True), ("e", 1, False)]


def test_gap_recovery_chains(spark):
    nums = ["18", "19", "21", "24"]
    marks = spark.createDataFrame([("d", 1, i, 100.0 * int(n), n, False, 10.0, 50.0, False) for i, n in enumerate(nums)], MARK)
    texts = {18: "18. a", 19: "19. b", 20: "2O. c", 21: "21. d", 22: "ZZ. e", 23: "23 f", 24: "24. g"}
    body = spark.createDataFrame([("d", 1, n, 100.0 * n, 100.0 * n + 10, 10.0, 50.0, t) for n, t in texts.items()], LINE)
    got = lines.recover_markers(marks, body).orderBy("y_top").collect()
    assert [(r.q_num, r.y_top) for r in got] == [("20", 2000.0), ("22", 2200.0), ("23", 2300.0)]
    sparse = marks.withColumn("q_num", F.when(F.col("q_num") == "24", "77").otherwise(F.col("q_num")))
    assert lines.recover_markers(sparse, body).count() == 0
    key = spark.createDataFrame([("d", 25)], "doc_id string, num int")
    more = body.union(spark.createDataFrame([("d", 1, 30, 2600.0, 2610.0, 10.0, 50.0, "2S) h")], LINE))
    assert [r.q_num for r in lines.recover_markers(marks, more, key).collect()] == ["25"]
    odd = body.union(spark.createDataFrame([("d", 1, 31, 2250.0, 2260.0, 10.0, 50.0, "² x"), ("d", 1, 32, 2250.0, 2260.0, 10.0, 50.0, "① y"), ("d", 1, 33, 0.0, 0.0, 0.0, 0.0, None)], LINE))
    assert lines.recover_markers(marks, odd).count() == 3 and lines.recover_markers(marks.limit(0), odd).count() == 0


def test_dedup_compares_with_the_last_kept(spark):
    marks = spark.createDataFrame([("d", 1, i, y, "1", False, 0.0, 1.0, True) for i, y in enumerate([0.0, 1.5, 3.0])], MARK)
    assert sorted(r.y_top for r in lines.dedup_consecutive(marks).collect()) == [0.0, 3.0]


def test_answer_key_needs_a_run(spark):
    rows = spark.createDataFrame([("a", 1, "1-B 2-A 3-D"), ("a", 2, "4-C 1-A"), ("b", 1, "1-B 50-A 99-D 4-C")], "doc_id string, n int, text string")
    assert [(r.doc_id, r.num, r.letter) for r in answers.answer_key(rows, ["n"]).orderBy("num").collect()] == [("a", 1, "B"), ("a", 2, "A"), ("a", 3, "D"), ("a", 4, "C")]
    text = spark.createDataFrame([("a", "1. x Ans. (B)\n2. y\nAnswer: C"), ("b", "1. z Ans (A)"), ("c", None)], "doc_id string, text string")
    assert [(r.doc_id, r.num, r.letter) for r in answers.solution_answers(text).orderBy("num").collect()] == [("a", 1, "B"), ("a", 2, "C")]
    odd = spark.createDataFrame([("a", '```json\n{"Q1": "(b)", "1": "C", "x": "A", "2": "F"}\n```')], "doc_id string, json string")
    assert [(r.num, r.letter) for r in answers.answer_map(odd).collect()] == [(1, "B")]


def test_furniture(spark):
    rows = []
    for p in range(1, 7):
        rows += [("d", p, 0, 20.0, 30.0, 0.0, 9.0, f"Running title {p}"), ("d", p, 1, 40.0, 50.0, 0.0, 9.0, f"Q{p}. stem"), ("d", p, 2, 60.0, 70.0, 0.0, 9.0, "A) one B) two"), ("d", p, 3, 300.0 + 40 * p, 320.0 + 40 * p, 0.0, 9.0, "Statement"), ("d", p, 4, 970.0, 980.0, 0.0, 9.0, f"{p}/6")]
    pages = spark.createDataFrame([("d", p, 100.0, 1000.0) for p in range(1, 7)], "doc_id string, page int, width double, height double")
    got = furniture.find_furniture(spark.createDataFrame(rows, LINE), pages).where("furniture").collect()
    assert {r.line_seq for r in got} == {0, 4} and len(got) == 12


def test_columns(spark):
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0), ("d", 2, 600.0, 800.0), ("d", 3, 600.0, 800.0)], "doc_id string, page int, width double, height double")
    two = [("d", 1, i, 10.0 * i, 10.0 * i + 8, x, x + 240, f"prose {i}") for i in range(20) for x in (30.0, 330.0)]
    one = [("d", 2, i, 10.0 * i, 10.0 * i + 8, 30.0, 570.0, f"line {i}") for i in range(20)]
    body = spark.createDataFrame(two + one, LINE)
    got = {r.page: [(c.x0, c.x1) for c in r["columns"]] for r in columns.detect(body, pages).collect()}
    assert got == {1: [(0.0, 301.5), (301.5, 600.0)], 2: [(0.0, 600.0)], 3: [(0.0, 600.0)]}
    left = spark.createDataFrame([("d", 1, i, 50.0 * i, str(i), False, 30.0, 60.0, True) for i in range(1, 4)], MARK)
    kept = columns.validate(columns.detect(body, pages), left, body, pages)
    assert {r.page: len(r["columns"]) for r in kept.collect()}[1] == 2
    grid = body.withColumn("text", F.when(F.col("x_left") > 300, "(B) x").otherwise(F.col("text")))
    assert {r.page: len(r["columns"]) for r in columns.validate(columns.detect(grid, pages), left, grid, pages).collect()}[1] == 1
    assert columns.absorb([(0, 5), (20, 90), (100, 190)], 24) == [(0, 90), (100, 190)]


def test_phantoms(spark):
    found = lambda nums: sorted(int(r.q_num) for r in review.drop_phantoms(items(spark, *[(n, False, box(1, 0, 5)) for n in nums])).collect())
    assert found([1, 2, 3, 4, 5, 53]) == [1, 2, 3, 4, 5]
    assert found([1, 2, 3, 4, 5, 53, 108]) == [1, 2, 3, 4, 5]
    assert found([1, 2, 3, 53]) == [1, 2, 3, 53]
    assert found([1, 2, 3, 4, 5, 14]) == [1, 2, 3, 4, 5, 14]


def test_flags_and_gaps(spark):
    some = items(spark, (1, False, box(1, 0, 20)), (2, False, box(1, 30, 50)), (2, False, box(1, 60, 80)), (3, False, box(2, 90, 95)), (4, False, box(2, 0, 70)), (7, False, box(3, 0, 20)), (8, False, box(3, 10, 30)))
    got = {r.item_seq: r.flag for r in review.flags(some).collect()}
    assert got == {0: None, 1: None, 2: "duplicate", 3: "page_edge", 4: "tall", 5: "overlap", 6: "overlap"}
    assert [list(r.missing) for r in review.number_gaps(some).collect()] == [[5, 6]]
    text = spark.createDataFrame([("d", 1, 51.0, 54.0, 10.0, 50.0), ("d", 1, 54.0, 59.9, 10.0, 50.0), ("d", 9, 20.0, 30.0, 10.0, 50.0)], "doc_id string, page int, y0 double, y1 double, x0 double, x1 double")
    assert [r.page for r in review.orphan_pages(some, text).collect()] == [9]
    alone = items(spark, (1, False, box(1, 0, 50)))
    tail = spark.createDataFrame([("d", 1, 52.0, 57.0, 10.0, 50.0), ("d", 1, 58.0, 63.0, 10.0, 50.0)], text.schema)
    assert [r.q_num for r in review.undercovered(alone, tail).collect()] == ["1"]
    kinds = {(r.kind, r.detail) for r in review.notes(some, text).collect()}
    assert {("duplicate", "duplicate"), ("gap", "5, 6"), ("incomplete", "orphan 9"), ("incomplete", "overlap")} <= kinds
    both = items(spark, (1, False, box(1, 0, 20)), (1, False, box(1, 90, 95)))
    assert sorted((r.kind, r.detail) for r in review.notes(both).collect()) == [("duplicate", "duplicate"), ("incomplete", "page_edge")]
    key = spark.createDataFrame([("d", n) for n in range(1, 16)], "doc_id string, num int")
    assert [r.detail for r in review.notes(both, expected=key).where("kind = 'gap'").collect()] == ["2, 3, 4, 5, 6, 7, 8, 9, 10, 11 (+4 more)"]
    docs = spark.createDataFrame([("d", "text"), ("e", "text"), ("f", "ai")], "doc_id string, method string")
    assert [r.doc_id for r in review.notes(both, docs=docs).where("kind = 'low_confidence'").collect()] == ["e"]
    nameless = both.withColumn("q_num", F.lit(None).cast("string"))
    assert {r.flag for r in review.flags(nameless, tail.withColumn("y0", F.col("y0") - 31).withColumn("y1", F.col("y1") - 31)).collect()} == {"page_edge", "tail"}


def test_dedup(spark):
    some = items(spark, (3, False, box(1, 0, 40)), (23, False, box(1, 0, 42)), (4, True, box(1, 0, 40)), (5, False, box(2, 0, 40)))
    assert sorted(int(r.q_num) for r in dedup.dedup_overlaps(some).collect()) == [4, 5, 23]
    twice = items(spark, (1, True, box(1, 0, 5)), (2, True, box(1, 5, 9)), (1, True, box(2, 0, 50)))
    assert sorted((r.q_num, r.place, r.item_seq) for r in dedup.best_per_file(twice).collect()) == [("1", 0, 2), ("2", 1, 1)]
    merged = dedup.merge_batches(items(spark, (2, False, box(1, 10, 20)), (2, False, box(1, 12, 25)), (2, False, box(2, 0, 5)), (10, False, box(2, 6, 9))))
    assert {r.q_num: len(r.segments) for r in merged.collect()} == {"2": 2, "10": 1}
    assert sorted((r.q_num, r.is_solution) for r in dedup.apply_ranges(some, [1], [2], strict=True).collect()) == [("23", False), ("3", False), ("4", False), ("5", True)]
    more = items(spark, *[(p, False, box(p, 0, 9)) for p in (1, 2, 3)])
    ranged = lambda *a: sorted((r.q_num, r.is_solution) for r in dedup.apply_ranges(more, *a).collect())
    assert ranged([1], [2]) == [("1", False), ("2", True)] and ranged([], [2]) == [("1", False), ("2", True), ("3", False)] and len(ranged([], [])) == 3 and ranged([1], [], True) == [("1", False)]


def test_archives(spark):
    rows = [(1, "q", False, False), (1, "s", True, False), (1, "a.csv", True, True), (2, "s2", True, False), (2, "b.csv", False, True)]
    got = naming.archive_manifest(spark.createDataFrame(rows, "job_id int, file string, is_solution boolean, is_sidecar boolean"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "combined", "a.csv"), (1, "combined", "q"), (1, "combined", "s"), (1, "questions", "a.csv"), (1, "questions", "q"), (1, "solutions", "s"), (2, "combined", "s2"), (2, "solutions", "s2")]


def test_names_collide_as_they_do(spark):
    files = spark.createDataFrame([("s", i, n) for i, n in enumerate(["a.png", "b.png", "c.jpg"])], "session_id string, seq int, original string")
    assert [r.output_name for r in naming.plan_renames(files, "x#", 9, 2).orderBy("seq").collect()] == ["x09.png", "x10.png", "x11.jpg"]
    stems = spark.createDataFrame([("s", 0, "a"), ("s", 1, "a"), ("s", 2, "a_2")], "session_id string, seq int, stem string")
    assert [r.output_name for r in naming.plan_outputs(files, stems=stems, output_format="png").orderBy("seq").collect()] == ["a.png", "a_2.png", "a_2.png"]


def test_preflight(spark):
    pages = spark.createDataFrame([("d", i, w, h) for i, (w, h) in enumerate([(595.3, 841.9), (842.0, 1190.6), (595.28, 841.89)])], "doc_id string, page int, width double, height double")
    assert tuple(preflight.mode_size(pages).first()) == ("d", 595.3, 841.9)
    assert tuple(preflight.target_size(pages, "max").first()) == ("d", 842.0, 1190.6)
    assert preflight.target_size(pages, "custom:210x297").first().width == pytest.approx(595.27, abs=0.01)
    assert tuple(preflight.target_size(pages, "letter").first()) == ("d", 612.0, 792.0)


def test_tiers(spark):
    docs = spark.createDataFrame([("a", 2), ("b", 2)], "doc_id string, n_pages int")
    found = items(spark, (1, False, box(1, 0, 5)), (2, False, box(1, 5, 9))).withColumn("doc_id", F.lit("a"))
    cheap = lambda d: found.join(d.select("doc_id"), "doc_id")
    costly = lambda d: found.withColumn("doc_id", F.lit("b")).join(d.select("doc_id"), "doc_id")
    done = tiers.run_tiers(docs, [("text", cheap), ("ai", costly)], lambda i, d: tiers.gates(i, d).where("confident"))
    assert sorted((r.doc_id, r.method) for r in done.collect()) == [("a", "text"), ("a", "text"), ("b", "ai"), ("b", "ai")]


def test_build_items(spark):
    rows = [("d", 1, 1, 100.0, 110.0, 50.0, 500.0, "1. First"), ("d", 1, 2, 120.0, 130.0, 60.0, 500.0, "(A) x (B) y"), ("d", 1, 3, 300.0, 310.0, 50.0, 500.0, "2. Second"), ("d", 2, 4, 200.0, 240.0, 60.0, 500.0, "goes on"), ("d", 2, 5, 300.0, 310.0, 60.0, 500.0, "PART-II"), ("d", 2, 6, 400.0, 410.0, 60.0, 500.0, "rubric")]
    body = spark.createDataFrame(rows, LINE)
    marks = spark.createDataFrame([("d", 1, 1, 100.0, "1", False, 50.0, 500.0, False), ("d", 1, 2, 300.0, "2", False, 50.0, 500.0, False)], MARK)
    pages = spark.createDataFrame([("d", 1, 600.0, 1000.0), ("d", 2, 600.0, 1000.0)], "doc_id string, page int, width double, height double")
    got = regions.build_items(body, marks, pages).orderBy("item_seq").collect()
    assert [(r.q_num, r.option_labels, [(s.page, s.y_start, s.y_end) for s in r.segments]) for r in got] == [("1", "AB", [(1, 10.0, 13.0)]), ("2", "", [(1, 30.0, 31.0), (2, 20.0, 24.0)])]
    assert {(s.page, round(s.x_start, 4), round(s.x_end, 4)) for r in got for s in r.segments if s.page == 1} == {(1, 8.3333, 83.3333)}


def test_stream_takes_each_file_once(spark, tmp_path):
    from vellum.streaming.ingest import append_lines, document_stream, marker_stream

    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([(1, "1. a\nb"), (2, "Q2 c")], "doc_id long, text string").write.parquet(src)
    for _ in range(2):
        append_lines(marker_stream(document_stream(spark, src)), out, state).awaitTermination()
    assert sorted((r.doc_id, r.q_num) for r in spark.read.parquet(out).collect()) == [(1, "1"), (2, "2")]


def test_empty_tables(spark):
    none = items(spark).limit(0) if False else spark.createDataFrame([], ITEM)
    text = spark.createDataFrame([], "doc_id string, page int, y0 double, y1 double, x0 double, x1 double")
    assert review.notes(none, text).count() == 0 and dedup.dedup_overlaps(none).count() == 0


def test_document_furniture(spark):
    from vellum.operators import branding as B

    shape = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, width double, height double"
    make = lambda rows, more="": spark.createDataFrame([("d", 1, *map(float, r[:4]), 600.0, 800.0, *r[4:]) for r in rows], shape + more)
    links, text = make([(10, 10, 90, 20, "https://bit.ly/x"), (10, 700, 90, 720, "https://example.org")], ", uri string"), make([(50, 100, 500, 112, "underlined words"), (50, 780, 90, 790, "4/5"), (50, 300, 90, 310, "4/5")], ", text string")
    images, strokes, boxes = make([(100, 8, 130, 22), (100, 300, 200, 400)]), make([(50, 112, 300, 113), (50, 500, 400, 501), (20, 100, 22, 700)]), make([(300, 600, 500, 700)])
    got = sorted(tuple(r)[2:] for r in B.collect(links, text, images, strokes, boxes).collect())
    assert got == [(10.0, 10.0, 90.0, 20.0), (20.0, 100.0, 22.0, 700.0), (50.0, 500.0, 400.0, 501.0), (50.0, 780.0, 90.0, 790.0), (100.0, 8.0, 130.0, 22.0)]
    row = spark.range(1).select(B.font_alias(F.lit("ABC+Arial"), F.lit(16), {"times": "tiro"}), B.font_alias(F.lit("X+Times"), F.lit(0), {"times": "tiro"}), B.font_alias(F.lit(None), F.lit(22)), B.packed_colour(F.lit("16777217"))).first()
    assert tuple(row) == ("hebo", "tiro", "tibi", 1)


def test_clusters_and_frames(spark):
    rect = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double"
    r = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, 10.0), ("d", 1, 12.0, 0.0, 20.0, 10.0), ("d", 1, 100.0, 100.0, 110.0, 110.0)], rect)
    assert sorted(tuple(x)[2:] for x in furniture.cluster_rects(r, 5.0).collect()) == [(0.0, 0.0, 20.0, 10.0), (100.0, 100.0, 110.0, 110.0)]
    v = spark.createDataFrame([("d", 1, 50.0, 100.0, 51.0, 300.0), ("d", 1, 400.0, 102.0, 401.0, 301.0), ("d", 1, 500.0, 0.0, 501.0, 50.0)], rect)
    h = spark.createDataFrame([("d", 1, 48.0, 100.0, 402.0, 101.0)], rect)
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0)], "doc_id string, page int, width double, height double")
    box = furniture.frames(v, h, pages)
    assert [tuple(x)[2:] for x in box.collect()] == [(50.0, 100.0, 401.0, 301.0)]
    assert furniture.outer_boxes(box.union(spark.createDataFrame([("d", 1, 60.0, 110.0, 90.0, 200.0)], rect))).count() == 1


def test_preflight_report(spark):
    make = spark.createDataFrame
    files = make([("a", True), ("b", None)], "doc_id string, encrypted boolean")
    fonts = make([("a", 1, 5, "F", False), ("a", 2, 5, "F", True), ("a", 1, 6, "G", None)], "doc_id string, page int, xref int, basefont string, embedded boolean")
    images = make([("a", 71.9, "ICCBased RGB"), ("a", 0.0, None), ("a", 150.0, None)], "doc_id string, dpi double, colorspace string")
    pages = make([("a", 1, 595.0, 842.0, "x" * 50), ("a", 2, 612.0, 792.0, " y "), ("a", 6, 595.0, 842.0, "z" * 99), ("c", 1, 1.0, 1.0, None)], "doc_id string, page int, width double, height double, text string")
    got = {(r.doc_id, r.check_id): (r.status, r.n, r.worst) for r in preflight.report(files, fonts, images, pages).collect()}
    assert [got["a", k] for k in ("encryption", "fonts_embedded", "image_dpi", "colorspace", "page_sizes", "text_layer")] == [("fail", 1, None), ("fail", 2, None), ("fail", 1, 71.9), ("warn", 1, None), ("warn", 2, None), ("ok", 1, None)]
    assert [got["b", k][0] for k in ("encryption", "fonts_embedded", "image_dpi", "colorspace", "page_sizes", "text_layer")] == ["ok", "info", "info", "ok", "ok", "info"]
    assert len(got) == 12
    assert {r.doc_id: r.verdict for r in preflight.verdicts(preflight.report(files, fonts, images, pages)).collect()} == {"a": "fail", "b": "pass"}
    assert preflight.report(*(t.limit(0) for t in (files, fonts, images, pages))).count() == 0


def test_small_relations(spark):
    from vellum.operators import branding as B

    make = spark.createDataFrame
    row = make([("d", 1, 0, 10.0, 20.0), ("d", 1, 0, 30.0, 5.0), ("d", 1, 0, 8.0, 15.0)], "doc_id string, page int, col int, x_left double, x_right double")
    assert [tuple(r) for r in columns.content_bounds(row).collect()] == [("d", 1, 0, 8.0, 20.0)] and columns.content_bounds(row.limit(0)).count() == 0
    name = make([("a.PNG",), ("b.pdf",), (None,), (".png",)], "original string")
    assert [r[0] for r in naming.allowed(name).collect()] == ["a.PNG"]
    item = make([("d", None, None, [1], None), ("d", " 3 ", True, [2], "x"), ("d", "4", True, [], "x"), ("d", "5", True, None, "x")], "doc_id string, q_num string, is_solution boolean, segments array<int>, source string")
    assert sorted((r.q_num, r.is_solution, r.source) for r in dedup.detected(item).collect()) == [("0", False, "auto"), ("3", True, "x")]
    span = make([("d", 1, 0, 2, 3, "run", 0.125, 1.0, 2.0, 3.0, 9.375, 18), ("d", 1, 0, 2, 4, " ", 0.0, 0.0, 0.0, 0.0, 1.0, None)], "doc_id string, page int, block int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double, size double, flags int")
    assert [tuple(r)[1:] for r in B.editable_spans(span).collect()] == [("p1_b0_l2_s3", 1, "run", 0.12, 1.0, 2.0, 3.0, 9.38, True, True)]
    text = make([("d", 1, "t", 100.0, 200.0, 30.0, 60.0), ("d", 1, None, 0.0, 1.0, 0.0, 1.0), ("d", 2, "t", 0.0, 1.0, 0.0, 1.0)], "doc_id string, page int, text string, y_top double, y_bottom double, x_left double, x_right double")
    paper = make([("d", 1, 600.0, 1000.0), ("d", 2, 0.0, 1000.0)], "doc_id string, page int, width double, height double")
    assert [tuple(r) for r in lines.page_percent(text, paper).collect()] == [("d", 1, 10.0, 20.0, 5.0, 10.0)]
