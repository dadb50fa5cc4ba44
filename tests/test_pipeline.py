"""The retrieval chain and the parser chain on small tables."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.operators import filters
from quern.operators.pipeline import answer_contexts
from quern.sources import parsers


def test_contexts_of_many_requests(spark):
    requests = spark.createDataFrame([("a", "annual budget", [1.0, 0.0]), ("b", "?!", [1.0, 0.0]), ("c", "nothing alike", [0.0, 1.0]), ("d", "annual budget", None)], "request_id string, question string, vector array<float>")
    columns = "id long, document_id long, parent_key string, content string, tenant_id string, department string, access_level string, status string, source_uri string, doc_type string, page_start int, page_end int, heading_path array<string>"
    rows = [(1, 1, "p", "annual budget report", "t", "d", "public", "active", "u", "md", 1, 2, ["H"]), (2, 1, "p", "annual thing", "t", "d", "public", "active", "u", "md", 1, 1, None), (3, 2, "gone", "annual budget", "t", "d", "restricted", "active", "u", "md", 1, 1, None), (4, 2, "q", "old", "t", "d", "public", "deleted", "u", "md", 1, 1, None)]
    chunks = spark.createDataFrame(rows + rows[:1], columns)
    vectors = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.2]), (3, [1.0, 0.0]), (4, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    parents = spark.createDataFrame([("p", "the parent text")], "parent_key string, parent_text string")
    titles = spark.createDataFrame([(1, "Handbook")], "document_id long, title string")
    got = {r.request_id: r for r in answer_contexts(requests, chunks, vectors, parents, titles, filters.visible("t", "d", "internal")).collect()}
    assert {k: (r.status, r.reason) for k, r in got.items()} == {"a": ("retrieved", None), "b": ("rejected", "empty_query"), "c": ("refused", "low_confidence"), "d": ("refused", "no_candidates")}
    a = got["a"]
    assert "the parent text" in a.context and a.context.startswith("[1]") and "标题路径: H" in a.context and "页码: 1-2" in a.context
    assert [(x.ref, x.title, x.chunk_id) for x in a.references] == [(1, "Handbook", 1)] and [h.chunk_id for h in a.hits] == [1, 2]


def test_parser_chain_falls_back_and_quarantines(spark):
    items = json.dumps([{"type": "text", "text": "body", "page_idx": 0}]).encode()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x/full.md", "# A\n\ntext\n\n## B\n\nmore")
    df = spark.createDataFrame([("1", "a.json", items), ("2", "b.zip", buffer.getvalue()), ("3", "c.bin", b"\0\1"), ("4", "d", None)], "document_id string, path string, content binary")
    chain = {k: parsers.CHAIN[k] for k in ("layout_archive", "layout_json")}
    got = {}
    for r in parsers.parse_files(df, chain).collect():
        got.setdefault(r.document_id, []).append((r.parser, r.text, r.heading_path, len(r.warnings)))
    assert got["1"] == [("layout_json", "body", [], 1)]
    assert got["2"] == [("layout_archive", "A", ["A"], 0), ("layout_archive", "text", ["A"], 0), ("layout_archive", "B", ["A", "B"], 0), ("layout_archive", "more", ["A", "B"], 0)]
    assert got["3"] == [(None, None, None, 2)] and got["4"][0][0] is None


def test_gates(spark):
    df = spark.createDataFrame([("MD", 5), ("exe", 5), ("pdf", 200 * 1024 * 1024), ("txt", 0), (None, 1)], "s string, n long")
    assert [r.x for r in df.select(filters.admit(F.col("s"), F.col("n")).alias("x")).collect()] == [None, "suffix", "size", "empty", "suffix"]
    assert filters.top_k(None, 8) == 8 and filters.top_k(3, 8) == 3
    with pytest.raises(ValueError):
        filters.top_k(9, 8)
