"""Layout expressions and validators with known answers."""

import pytest
from pyspark.sql import functions as F

from quern.functions import layout as L
from quern.operators import validate as V


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize("value", ["[3, 4, 1, 2]", "[[1, 2], [3, 2], [3, 4], [1, 4]]", '{"x0": 1, "y0": 2, "x1": 3, "y1": 4}', '{"l": 1, "t": 2, "r": 3, "b": 4}', '{"bbox": [1, 2, 3, 4]}', '{"poly": [[1, 2], [3, 4]]}'])
def test_boxes_of_any_shape(spark, value):
    assert tuple(one(spark, value, L.box_of(F.col("t")))) == (1, 2, 3, 4)


@pytest.mark.parametrize("value", [None, "", "[1, 2]", "{}", "text"])
def test_what_is_no_box(spark, value):
    assert one(spark, value, L.box_of(F.col("t"))) is None


def test_wrapped_lines_and_titles(spark):
    got = one(spark, "The valve\nis open.\nNext line\n\n第一条 甲\n乙\n1. item", L.merge_lines(F.col("t")))
    assert got == ["The valve is open.", "Next line", "第一条 甲乙", "1. item"]
    assert one(spark, "第 1 条 合同构成 本合同", L.article_title(F.col("t"))) == "第1条 合同构成"
    assert one(spark, "第 2 条", L.article_title(F.col("t"))) == "第2条"
    assert one(spark, "plain", L.article_title(F.col("t"))) == "plain"


def test_page_metadata_and_answers(spark):
    assert one(spark, "Chapter 3-1 The engine oil", L.page_chapter(F.col("t"))) == "3-1"
    assert one(spark, "Section 2. Start", L.page_section(F.col("t"))) == "2"
    assert one(spark, "engine oil", L.domain_hint(F.col("t"))) == "Engine"
    assert one(spark, "engine fault", L.domain_hint(F.col("t"))) == "Troubleshooting"
    assert one(spark, "nothing", L.domain_hint(F.col("t"))) is None
    assert one(spark, '{"choices": [{"message": {"content": "x"}}]}', L.answer_of(F.col("t"))) == "x"
    assert "[1], [2]" in one(spark, "q", L.answer_prompt(F.col("t"), F.lit("c"), F.array(F.lit(1), F.lit(2))))


BOXED = "document_id string, block_id string, page_number int, reading_order int, block_type string, text string, caption string, heading_path array<string>, bbox struct<x0:double,y0:double,x1:double,y1:double>"


def test_section_tree_and_faults(spark):
    rows = [("d", "a", 1, 0, "heading", "x", None, ["A", "B"], (0.0, 0.0, 0.0, 1.0)), ("d", "b", 2, 1, "table", "t", "own", ["A"], (0.0, 0.0, 900.0, 1.0)), ("d", "c", 2, 2, "caption", "cap", None, None, None), ("d", "c", 0, 3, "text", "", None, [], None)]
    df = spark.createDataFrame(rows, BOXED)
    tree = {(r.title, r.level): (r.page_start, r.page_end, r.parent_section_id is None) for r in V.section_tree(df).collect()}
    assert tree == {("A", 1): (1, 2, True), ("B", 2): (1, 1, False), ("Document", 1): (0, 2, True)}
    pages = spark.createDataFrame([("d", 2, 600.0, 800.0)], "document_id string, page_number int, width double, height double")
    assert {(r.rule, r.key) for r in V.document_faults(df, pages).collect()} == {("duplicate_block", "c"), ("page_number", "c"), ("empty_box", "a"), ("off_page", "b")}
    assert [(r.block_id, r.caption) for r in V.captions(df).collect()] == [("b", "own\n\ncap")]


def test_chunk_and_vector_faults(spark):
    chunks = spark.createDataFrame([("d", "p", "c1", "text", 1, 1, ["b1"]), ("d", "gone", "c2", "text", 2, 1, []), ("d", "p", "c1", "text", 1, 1, ["t1"])], "document_id string, parent_id string, chunk_id string, chunk_type string, page_start int, page_end int, block_ids array<string>")
    parents = spark.createDataFrame([("p",), ("empty",)], "parent_id string")
    blocks = spark.createDataFrame([("d", "t1", "table")], "document_id string, block_id string, block_type string")
    got = {(r.rule, r.key) for r in V.chunk_faults(chunks, parents, blocks).collect()}
    assert got == {("duplicate_chunk", "c1"), ("missing_parent", "c2"), ("missing_child", "empty"), ("no_block", "c2"), ("page_span", "c2"), ("swallowed_media", "t1")}
    vectors = spark.createDataFrame([(1, [1.0], "m", 1), (2, [1.0], "x", 1), (3, [1.0], "m", 2), (4, [float("nan")], "m", 1), (5, None, "m", 1)], "chunk_id long, embedding array<float>, embedding_model string, embedding_dim int")
    assert {(r.rule, r.key) for r in V.vector_faults(vectors, {"m": 1}).collect()} == {("unknown_model", "2"), ("stated_dim", "3"), ("length", "3"), ("length", "5"), ("not_finite", "4")}
    assert one(spark, "", V.strange_metadata(F.create_map(F.lit("evil"), F.lit("x"), F.lit("status"), F.lit("y")))) == ["evil"]


def test_split_markers_find_their_body(spark):
    rows = [("d", "m", 1, 2, "text", "第一条 定本办法。", None, None, (0.0, 100.0, 60.0, 112.0)), ("d", "b", 1, 1, "text", "为了规范，制", None, None, (70.0, 100.0, 500.0, 112.0)), ("d", "o", 1, 3, "text", "其他。", None, None, (70.0, 300.0, 500.0, 312.0))]
    assert [(r.marker_id, r.body_id) for r in V.split_markers(spark.createDataFrame(rows, BOXED)).collect()] == [("m", "b")]


def test_offsets_fonts_parts_and_running_lines(spark):
    pages = spark.createDataFrame([("d", 1, "One."), ("d", 2, "two"), ("d", 3, "three"), ("d", 4, None)], "document_id string, page_number int, t string")
    assert [(r.start, r.stop) for r in V.page_offsets(pages, "t").orderBy("page_number").collect()] == [(0, 4), (6, 9), (9, 14), (14, 14)]
    fonts = spark.createDataFrame([("d", float(s)) for s in (9, 9, 12, 20, None or 14)], "document_id string, s double")
    assert {(r.s, r.level) for r in V.font_levels(fonts, "s").collect()} == {(20, 1), (14, 2), (12, 3), (9, 4)}
    parts = spark.createDataFrame([("d", "p", 0, "a"), ("d", "p", 1, "a"), ("d", "p", 2, "b"), ("d", "p", 3, None)], "document_id string, parent_id string, chunk_index int, article string")
    assert [(r.part, r.parts) for r in V.article_parts(parts, "article").orderBy("chunk_index").collect()] == [(1, 2), (2, 2), (None, None), (None, None)]
    blocks = spark.createDataFrame([("d", "Report 3\nbody\n"), ("e", "Report 3\nbody"), ("d", None)], "document_id string, text string")
    lines = spark.createDataFrame([("d", "report #")], "document_id string, shape string")
    assert [r.text for r in V.without_running_lines(blocks, lines).orderBy("document_id", F.desc_nulls_last("text")).collect()] == ["body\n", None, "Report 3\nbody"]
