"""Operators on small tables with known answers."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from quern.functions import layout as L
from quern.functions import text as T
from quern.operators import blocks as B
from quern.operators import chunkers, filters, postprocess, retrieve, search, stats, store
from quern.operators.embed import embed, hashed_embedding
from quern.operators.postprocess import Chunk
from quern.sources import files

BLOCKS = "document_id string, block_id string, page_number int, reading_order int, block_type string, text string, heading_path array<string>, section_id string, metadata string, bbox struct<x0:double,y0:double,x1:double,y1:double>"


def block(i, text, kind="paragraph", doc="d", page=None, path=None, box=None, section="s", meta="{}"):
    return (doc, f"b{i}", page or i // 4 + 1, i, kind, text, path or [], section, meta, box)


def frame(spark, rows):
    return spark.createDataFrame(rows, BLOCKS)


def test_filters_refuse_what_the_server_sets():
    for bad in ({"tenant_id": "*"}, {"evil": "x"}, {"knowledge_base_id": 1, "knowledge_base_ids": [1]}):
        with pytest.raises(ValueError):
            filters.client_filters(bad)
    with pytest.raises(ValueError):
        filters.safe("a;b", "source_uri")


def test_no_row_leaks_for_any_level_and_department(spark):
    rows = [("t", "active", level, dep, i) for i, (level, dep) in enumerate((a, b) for a in filters.READABLE for b in ("global", "eng", "sales"))]
    df = spark.createDataFrame(rows + [("t", None, None, None, 99), ("u", "active", "public", "eng", 98)], "tenant_id string, status string, access_level string, department string, id int")
    for level, readable in filters.READABLE.items():
        got = {(r.access_level, r.department) for r in df.where(filters.visible("t", "eng", level)).collect()}
        assert got == {(a, d) for a in readable for d in ("global", "eng")}


def test_nearest_skips_unusable_vectors_and_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [0.0, 1.0])], "id int, v array<float>")
    assert [(r.id, r["rank"]) for r in search.nearest(df, "id", "v", [1.0, 0.0], 2).collect()] == [(1, 1), (3, 2)]
    each = search.nearest_for_each(df, "id", "v", df.where("id in (1, 6)"), "id", "v", 2)
    assert {(r.request, r.key, r["rank"]) for r in each.collect()} == {(1, 3, 1), (1, 6, 2), (6, 1, 1), (6, 3, 2)}


def test_full_text_needs_every_lexeme(spark):
    df = spark.createDataFrame([(1, "Annual budget report"), (2, "budget"), (3, "annual x y budget"), (4, None)], "id int, content string")
    assert [r.id for r in search.full_text(df, "id", "content", "annual BUDGET", 5).collect()] == [1, 3]
    assert search.full_text(df, "id", "content", "?!").count() == 0
    assert df.where("id = 1").select(search.lexical_score(F.lit("annual thing"), F.col("content")).alias("s")).first().s == 0.5


@pytest.mark.parametrize(("scores", "kind", "expected"), [([0.2, 0.1], 0.35, (True, "low_confidence", "low")), ([0.55], 0.6, (True, "low_confidence", "low")), ([0.8, 0.77], 0.35, (False, None, "medium")), ([0.8], 0.35, (False, None, "high")), ([], 0.35, (True, "no_candidates", "none"))])
def test_refusal(spark, scores, kind, expected):
    requests = spark.createDataFrame([("r",)], "q string")
    rows = spark.createDataFrame([("r", i, s) for i, s in enumerate(scores)], "q string, c int, s double")
    got = retrieve.refusal(retrieve.ranked(rows, "q", "c", "s"), "q", "s", requests, kind).first()
    assert (got.refuse, got.reason, got.confidence) == expected


def test_parents_references_and_budget(spark):
    rows = spark.createDataFrame([("q", 1, "10", 0.9), ("q", 2, "10", 0.8), ("q", 3, "11", 0.7), ("q", 4, "12", None)], "q string, chunk_id long, parent_key string, s double")
    parents = spark.createDataFrame([("10", "text")], "parent_key string, parent_text string")
    out = retrieve.references(retrieve.expand_parents(retrieve.ranked(rows, "q", "chunk_id", "s"), parents, "q", "s"), "q").orderBy("ref").collect()
    assert [(r.ref_id, r.parent_key, r.children, r.parent_missing) for r in out] == [("[1]", "10", [1, 2], False), ("[2]", "11", [3], True)]
    sized = spark.createDataFrame([("q", 1, 50, 10), ("q", 2, 500, 20), ("q", 3, 900, 900), ("q", 4, 15, 5)], "q string, o int, f int, c int")
    got = [(r.o, r.form, r.used) for r in retrieve.within_budget(sized, "q", "o", "f", "c", 90).orderBy("o").collect()]
    assert got == [(1, "full", 50), (2, "compact", 70), (4, "full", 85)]


def test_parent_window_marks_cut_ends(spark):
    df = spark.createDataFrame([("word " * 300 + "target" + " word" * 300, "target"), ("short", "x")], "p string, c string")
    got = [r.w for r in df.select(retrieve.parent_window(F.col("p"), F.lit(None).cast("int"), F.col("c"), F.lit(1), F.lit(1), 20).alias("w")).collect()]
    assert got[0].startswith("[...] ") and got[0].endswith(" [...]") and "target" in got[0] and got[1] == "short"


def test_text_blocks_of_markdown_and_lines(spark):
    df = spark.createDataFrame([(1, "# Guide\n\nfirst\n\n- item\n\nReferences\nx"), (2, "one\ntwo"), (3, None), (4, " \n ")], "id int, t string")
    got = {(r.id, r.reading_order): (r.block_type, r.text, r.heading) for r in B.text_blocks(df, "id", "t").collect()}
    assert got == {(1, 0): ("heading", "Guide", "Guide"), (1, 1): ("paragraph", "first", "Guide"), (1, 2): ("list_item", "- item", "Guide"), (1, 3): ("heading", "References\nx", "References"), (2, 0): ("paragraph", "one", None), (2, 1): ("paragraph", "two", None)}


def test_layout_noise_reasons(spark):
    edge, body = (0.0, 40.0, 1.0, 52.0), (0.0, 300.0, 1.0, 320.0)
    rows = [block(0, "Annual Report", page=1, box=edge), block(1, "annual  report", page=2, box=edge), block(2, "Annual report", page=3, box=body), block(3, "page 4", page=1, box=body), block(4, "Intro ........ 12", page=1, box=body), block(5, "", page=1), block(6, "x", "footer", page=1), block(7, "text", page=1, box=body), block(8, None, page=1)]
    got = {r.block_id: r.noise for r in B.layout_noise(frame(spark, rows)).collect()}
    assert got == {"b0": "repeated_page_edge", "b1": "repeated_page_edge", "b2": "repeated_page_edge", "b3": "page_number", "b4": "toc_dot_leader", "b5": "empty", "b6": "type", "b7": None, "b8": "empty"}


def test_heading_carry_and_levels(spark):
    rows = [block(0, "text"), block(1, "1.2 Scope of it", "heading"), block(2, "body"), block(3, "第一章 总则"), block(4, "2025 年 8 月 6 日"), block(5, "Ends with a stop.", "heading")]
    got = {r.block_id: (r.section_title, r.section_level) for r in B.heading_carry(frame(spark, rows)).collect()}
    assert got["b0"] == (None, None) and got["b2"] == ("1.2 Scope of it", 2) and got["b5"] == got["b4"] == ("第一章 总则", 1)


def test_neighbours_stay_in_their_run_of_a_section(spark):
    rows = [block(0, "a", section="s"), block(1, "b", section="s"), block(2, "c", section="s"), block(3, "T", "table", section="s"), block(4, "d", section="s"), block(5, "e", section="t"), block(6, "cap", "caption", section="t")]
    got = {r.block_id: (r.before, r.after) for r in B.neighbour_context(frame(spark, rows), 2).collect()}
    assert got == {"b3": ("b\n\nc", "d"), "b6": ("e", "")}


def test_question_pairs(spark):
    rows = [block(0, "Q: what?"), block(1, "A: this"), block(2, "more"), block(3, "Topic", "heading"), block(4, "问：为何？"), block(5, "答：因此")]
    got = [(r.question, r.answer) for r in B.question_pairs(frame(spark, rows)).orderBy("pair").collect()]
    assert got == [("what?", "this\n\nmore"), ("为何？", "因此")]


def test_document_types(spark):
    rows = [block(0, "the policy says", doc="a"), block(1, "doing well", doc="b"), block(2, "plain", doc="c"), block(3, "x", "table", doc="t"), block(4, None, doc="n")]
    got = {r.document_id: r.detected for r in B.document_types(frame(spark, rows)).collect()}
    assert got == {"a": "contract_terms", "b": "paper", "c": "generic_structured", "t": "table_data", "n": "generic_structured"}


def chunks(spark, rows, template, limit=450):
    configs = spark.createDataFrame([(template, limit, 60), ("generic_structured", limit, 60)], "template string, child_max_tokens int, child_min_tokens int")
    templates = spark.createDataFrame([("d", template)], "document_id string, template string")
    out = chunkers.chunk_blocks(frame(spark, rows + rows[:1]), templates, configs)
    return out.orderBy("section", "chunk_index").collect(), out, configs


def test_generic_chunks_pack_and_isolate_media(spark):
    rows = [block(0, "one " * 20, path=["A"]), block(1, "two " * 20, path=["A"]), block(2, "t", "table", path=["A"]), block(3, "x", "header"), block(4, "three", path=["B"]), block(5, "")]
    got, _, _ = chunks(spark, rows, "generic_structured", 40)
    assert [(c.section, c.chunk_type, c.block_ids) for c in got] == [("A", "text", ["b0"]), ("A", "text", ["b1"]), ("A", "table", ["b2"]), ("B", "text", ["b4"])]
    assert len({c.chunk_id for c in got}) == 4 and all(c.token_count > 0 for c in got)


@pytest.mark.parametrize(
    ("template", "rows", "kinds"),
    [
        ("qa", [block(0, "Q: a?"), block(1, "A: b"), block(2, "Q: c?"), block(3, "A: d")], ["qa_pair", "qa_pair"]),
        ("manual", [block(0, "Use", "heading"), block(1, "text"), block(2, "Warning: hot"), block(3, "1. do"), block(4, "2. then"), block(5, "symptom x", "table")], ["manual_text", "manual_callout", "manual_procedure", "manual_troubleshooting_table"]),
        ("laws", [block(0, "第一章 总则"), block(1, "第一条 甲。"), block(2, "（一）乙"), block(3, "第二条 丙。")], ["legal_article"] * 3),
        ("paper", [block(0, "Abstract", "heading"), block(1, "w " * 50), block(2, "w " * 50), block(3, "Results", "heading"), block(4, "w " * 50)], ["paper_abstract", "paper_text", "paper_text"]),
        ("book", [block(0, "Contents"), block(1, "Chapter 1 Start"), block(2, "text")], ["book_section"]),
        ("picture_pdf", [block(0, "ocr", page=1), block(1, "fig", "figure", page=1), block(2, "ocr", page=2)], ["ocr_text", "image_context", "ocr_text"]),
        ("table_data", [block(0, "r1", "table", meta='{"sheet_name": "S"}'), block(1, "r2", "table", meta='{"sheet_name": "S"}'), block(2, "r", "table", meta="not json")], ["table_row_group", "table_row_group"]),
        ("contract_terms", [block(0, "第一章 总则", "heading"), block(1, "第一条 保险责任", "heading"), block(2, "条文。"), block(3, "第 3 页"), block(4, "第二条 除外", "heading"), block(5, "条文。")], ["contract_clause", "contract_clause"]),
    ],
)
def test_templates(spark, template, rows, kinds):
    got, _, _ = chunks(spark, rows, template, 60)
    assert sorted(c.chunk_type for c in got) == sorted(kinds)
    used = [b for c in got for b in c.block_ids]
    assert len(used) == len(set(used))


def test_finished_chunks_keep_text_and_limits(spark):
    rows = [block(i, ("A sentence of words here. " * 30) if i % 3 else "tiny", path=[f"S{i // 5}"], page=i + 1) for i in range(12)]
    _, drafts, configs = chunks(spark, rows, "generic_structured", 60)
    done = postprocess.finish_chunks(drafts, configs).collect()
    assert all(c.token_count <= 60 for c in done)
    assert sum(c.text.count("sentence") for c in done) == 30 * sum(1 for i in range(12) if i % 3)
    assert postprocess.finish_chunks(drafts.where("false"), configs).count() == 0
    assert stats.quality(drafts).first().chunks == drafts.count()


def ch(text, page=1, parent="p", kind="text", n=None):
    return Chunk(parent, text[:8], kind, text, page, page, n if n is not None else len(text.split()))


def test_breaks_are_mended():
    assert [c.text for c in postprocess.mend([ch("it is inter-"), ch("national.", 2)])] == ["it is international."]
    assert [c.text for c in postprocess.mend([ch("it runs"), ch("on here.", 2)])] == ["it runs on here."]
    assert [c.text for c in postprocess.mend([ch("甲"), ch("，乙。")])] == ["甲，", "乙。"]
    assert [c.text for c in postprocess.mend([ch("1. a"), ch("2. b", 2)])] == ["1. a 2. b"]
    assert len(list(postprocess.mend([ch("open"), ch("table", 2, kind="table")]))) == 2
    assert len(list(postprocess.mend([ch("it runs"), ch("Article 2 new", 2, "q")]))) == 2
    assert len(list(postprocess.mend([ch("it runs"), ch("on", 2, "q")]))) == 1


def test_small_chunks_are_joined_and_long_ones_split():
    assert [c.text for c in postprocess.join_small([ch("a."), ch("b c d e f g")], 4)] == ["a.\n\nb c d e f g"]
    assert [c.text for c in postprocess.join_last([ch("b c d e f g"), ch("a")], 4)] == ["b c d e f g a"]
    assert len(list(postprocess.join_small([ch("a", kind="table"), ch("b")], 4))) == 2
    parts = list(postprocess.split_long([ch("One two three! Four five six! Seven eight nine!", n=99)], 8))
    assert [p.text for p in parts] == ["One two three! Four five six!", "Seven eight nine!"] and parts[1].id.endswith(":part2")
    assert all(p.tokens <= 8 for p in postprocess.split_long([ch("字" * 50, n=50)], 8))


def test_store_operators(spark):
    docs = spark.createDataFrame(
        [(1, "t", 1, "u", 1, "superseded", "a" * 64), (2, "t", 1, "u", 2, "active", "b" * 64), (3, "t", None, "v", 1, "active", "bad"), (4, "t", 1, "w", 1, "active", "c" * 64), (5, "t", 1, "w", 1, "active", "d" * 64)],
        "id long, tenant_id string, knowledge_base_id long, source_uri string, version int, status string, content_hash string",
    )
    assert {(r.source_uri, r.next_version) for r in store.next_versions(docs).collect()} == {("u", 3), ("v", 2), ("w", 2)}
    assert {(r.source_uri, r.id) for r in store.latest_of_source(docs).collect()} == {("u", 2), ("v", 3), ("w", 5)}
    incoming = spark.createDataFrame([("t", 1, "u", "a" * 64, 1), ("t", 1, "u", "e" * 64, 2), ("t", 1, "u", "e" * 64, 3), ("t", 1, "u", "f" * 64, 4), ("t", None, "n", "a" * 64, 1)], "tenant_id string, knowledge_base_id long, source_uri string, content_hash string, arrived_at int")
    got = {(r.source_uri, r.arrived_at): (r.outcome, r.version) for r in store.stage_ingest(incoming, docs).collect()}
    assert got == {("u", 1): ("skipped_duplicate", None), ("u", 2): ("superseded", 3), ("u", 3): ("skipped_duplicate", None), ("u", 4): ("active", 4), ("n", 1): ("active", 1)}
    after = {r.id: r.status for r in store.supersede(docs, docs.where("source_uri = 'v'")).collect()}
    assert after == {1: "superseded", 2: "active", 3: "superseded", 4: "active", 5: "active"}
    parts = spark.createDataFrame([(10, 1, 1, "superseded")], "id long, document_id long, version int, status string")
    new, copies = store.restore(docs, parts, docs.where("id = 1").select("id"), 5)
    assert (new.first().id, new.first().version, new.first().status) == (6, 3, "active") and copies.first().document_id == 6
    assert {(r.rule, r.key) for r in store.violations(docs).collect()} == {("content_hash", "3"), ("one_active", "w"), ("unique_version", "w#1")}
    changes = spark.createDataFrame([(1, None, "x")], "id long, status string, source_uri string")
    assert store.patch(docs, changes, "id").where("id = 1").first().source_uri == "x"


def test_keep_latest_prefers_time_then_is_stable(spark):
    df = spark.sql("select * from values (1, timestamp'2024-01-02', 'new'), (1, timestamp'2024-01-01', 'old'), (2, null, 'only'), (null, null, 'n') t(id, ts, v)")
    assert {(r.id, r.v) for r in store.keep_latest(df, ["id"], "ts").collect()} == {(1, "new"), (2, "only"), (None, "n")}


def test_embedding_plug_in(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "id long, c string")
    got = {r.id: r.embedding for r in embed(df, "id", "c").collect()}
    assert got[1] == got[3] and not any(got[2]) and len(got[1]) == 64
    with pytest.raises(Exception, match="hash-64 returned"):
        embed(df, "id", "c", lambda t: hashed_embedding(t, 8)).collect()


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Guide\n\nfirst\n\nsecond", encoding="utf-8-sig")
    (tmp_path / "b.csv").write_text("name,value,,name\nalpha,1\n,,\nbeta,2,x,y\n")
    (tmp_path / "c.tsv").write_text("k\tv\n1\t2\n")
    rows = files.read_files(spark, str(tmp_path))
    assert files.read_files(spark, str(tmp_path), most_bytes=10).count() == 1
    assert [r.text for r in files.read_text_blocks(rows).orderBy("reading_order").collect()] == ["Guide", "first", "second"]
    table = files.read_table_blocks(rows).orderBy("sheet", "row_number").collect()
    assert [(r.sheet, r.row_number) for r in table] == [("b", 2), ("b", 4), ("c", 2)]
    assert table[0].cells == {"name": "alpha", "value": "1", "column_3": "", "name_4": ""} and table[0].text == "Sheet: b\nRow: 2\nname: alpha\nvalue: 1"
    assert files.parser_for(".MD") == "text_file" and files.parser_for("xlsx") == "table_file" and files.parser_for("pdf") == "pdf"


def test_layout_items_and_html_tables(spark):
    items = '[{"type": "text", "text": "Top", "text_level": 1, "page_idx": 0}, {"type": "text", "text": "body", "page_idx": 0}, {"type": "text", "text": "Sub", "text_level": 2, "page_idx": 1}, {"type": "table", "table_body": "<table><tr><td>a<td>b</tr></table>", "page_idx": 1}, {"type": "image"}, 5]'
    df = spark.createDataFrame([(1, items), (2, "no json"), (3, None)], "id int, c string")
    got = [(r.page_number, r.block_type, r.text, r.heading_path) for r in files.read_layout_items(df, "id", "c").orderBy("reading_order").collect()]
    assert got == [(1, "heading", "Top", ["Top"]), (1, "paragraph", "body", ["Top"]), (2, "heading", "Sub", ["Top", "Sub"]), (2, "table", "a\tb", ["Top", "Sub"]), (1, "figure", "[Figure]", ["Top", "Sub"])]
    html = spark.createDataFrame([("x", "<table><tr><th>a</th></tr><tr><td>1</td></tr></table>"), ("y", "<p>no</p>"), ("z", None)], "id string, html string")
    assert [r.markdown for r in files.html_tables(html, "id", "html").collect()] == ["| a |\n| --- |\n| 1 |"]


def test_long_documents_are_mended_across_every_parent(spark):
    n = 5_300
    rows = [("d1", "t", f"p{i:05d}", f"c{i}", "text", f"this sentence number {i} runs on" if i == 4_999 else f"then part {i} ends here.", i, i, 500, 0) for i in range(n)]
    chunks = spark.createDataFrame(rows, "document_id string, template string, parent_id string, chunk_id string, chunk_type string, text string, page_start int, page_end int, token_count int, chunk_index int")
    configs = spark.createDataFrame([("t", 1000, 2)], "template string, child_max_tokens int, child_min_tokens int")
    out = postprocess.finish_chunks(chunks, configs).collect()
    assert len(out) == n - 1
    assert [r.text for r in out if r.chunk_id == "c4999"] == ["this sentence number 4999 runs on then part 5000 ends here."]


def test_breaks_across_parents_need_the_rest_of_a_sentence():
    two = lambda a, b, **more: [c.text for c in postprocess.mend([ch(a), dataclasses.replace(ch(b, 2, "q"), **more)])]
    assert len(two("1. first item", "2. second item")) == 2
    assert len(two("including, but not,", "Annex material begins.")) == 2
    assert two("the cover runs", "安心人生两全寿险利益条款\non here.") == ["the cover runs on here."]
    assert two("甲方应当", "支付费用。") == ["甲方应当支付费用。"]
    assert [c.text for c in postprocess.mend([ch("1. first item\nmore of it."), ch("2. second item", 2)])] == ["1. first item\nmore of it.2. second item"]


def test_layout_continuation():
    low, high = dataclasses.replace(ch("Section of Things"), bottom=720.0), dataclasses.replace(ch("Annex Material", 2), top=100.0)
    assert [c.text for c in postprocess.mend([low, high])] == ["Section of Things Annex Material"]
    assert len(list(postprocess.mend([low, dataclasses.replace(high, top=300.0)]))) == 2


def test_parts_of_a_long_chunk_keep_its_heading():
    long = dataclasses.replace(ch("Terms\n\n" + "One rule holds here. " * 20), heading="Terms").estimate()
    parts = list(postprocess.split_long([long], 40))
    assert len(parts) > 1 and all(c.text.startswith("Terms\n\n") and c.tokens <= 40 for c in parts)


def contract(*rows):
    return [block(i, t, k, page=max(1, i // 4 + 1)) for i, (t, k) in enumerate(rows)]


ARTICLES = [("本合同由双方订立。", "paragraph"), ("第一条 保险责任", "heading"), ("我们承担责任。", "paragraph"), ("第二条 责任免除", "heading"), ("下列情形除外。", "paragraph"), ("第三条 保险金额", "heading"), ("金额由双方约定。", "paragraph")]


def test_contract_without_chapters_has_articles_as_parents(spark):
    got, drafts, _ = chunks(spark, contract(*ARTICLES), "contract_terms")
    parents = chunkers.parents_of(drafts).orderBy("section").collect()
    assert {(p.heading, p.rule) for p in parents} == {("Document", "contract_parent_preamble"), ("第一条 保险责任", "contract_parent_article"), ("第二条 责任免除", "contract_parent_article"), ("第三条 保险金额", "contract_parent_article")}
    assert all(p.token_count > 0 for p in parents)
    spaced = [(t.replace("第一条", "第 1 条").replace("第二条", "第 2 条").replace("第三条", "第 3 条"), k) for t, k in ARTICLES[1:]]
    got, _, _ = chunks(spark, contract(*spaced), "contract_terms")
    assert sorted({c.heading for c in got}) == ["第1条 保险责任", "第2条 责任免除", "第3条 保险金额"]


def test_contract_children_stay_with_their_article(spark):
    rows = [("第一条 保险责任", "heading"), *[("我们对被保险人承担给付保险金的责任。", "paragraph")] * 4, *ARTICLES[3:]]
    got, _, _ = chunks(spark, contract(*rows), "contract_terms", 28)
    first = [c for c in got if c.section.startswith("article:1:")]
    assert len(first) > 1 and {c.heading for c in first} == {"第一条 保险责任"}


def test_contract_with_chapters_keeps_them(spark):
    rows = [("第一章 总则", "heading"), ("第一条 甲", "heading"), ("条文。", "paragraph"), ("第二章 保险责任", "heading"), ("第二条 乙", "heading"), ("条文。", "paragraph"), ("第三条 丙", "heading"), ("条文。", "paragraph")]
    got, _, _ = chunks(spark, contract(*rows), "contract_terms")
    assert {(c.section, c.rule) for c in got} == {("第一章 总则", "contract_parent_chapter"), ("第二章 保险责任", "contract_parent_chapter")}


def test_parent_granularity(spark):
    rows = [block(0, "a", path=["A", "One"]), block(1, "b", path=["A", "Two"]), block(2, "c", path=["B"])]
    for depth, sections in (("chapter", ["A", "A", "B"]), ("section", ["A > One", "A > Two", "B"])):
        configs = spark.createDataFrame([("generic_structured", 450, 60, depth)], "template string, child_max_tokens int, child_min_tokens int, parent_granularity string")
        out = chunkers.chunk_blocks(frame(spark, rows), spark.createDataFrame([], "document_id string, template string"), configs).orderBy("parent_index", "chunk_index")
        got = out.collect()
        assert sorted(c.section for c in got for _ in c.block_ids) == sections


def test_full_text_scores_the_least_cover(spark):
    df = spark.createDataFrame([(1, "annual y y budget and annual budget"), (2, "annual x budget"), (3, "budget budget")], "id int, content string")
    got = {r.id: round(r.score, 4) for r in search.full_text(df, "id", "content", "annual budget").collect()}
    assert got == {1: 1.0, 2: 0.6667}


def test_parents_of_other_tenants_or_inactive_are_hidden(spark):
    rows = spark.createDataFrame([("q", "t1", i, str(i), 0.9) for i in (1, 2, 3)], "q string, tenant_id string, chunk_id long, parent_key string, s double")
    parents = spark.createDataFrame([("1", "t1", "active", "own"), ("2", "t2", "active", "foreign"), ("3", "t1", "superseded", "old")], "parent_key string, tenant_id string, status string, parent_text string")
    got = {r.parent_key: (r.parent_text, r.parent_missing) for r in retrieve.expand_parents(retrieve.ranked(rows, "q", "chunk_id", "s"), parents, "q", "s").collect()}
    assert got == {"1": ("own", False), "2": (None, True), "3": (None, True)}


def test_parent_window_guesses_by_rank(spark):
    df = spark.createDataFrame([("word " * 600, "nowhere", r) for r in (1, 3)], "p string, c string, r int")
    got = [r.w for r in df.select(retrieve.parent_window(F.col("p"), F.lit(None).cast("int"), F.col("c"), F.col("r"), F.lit(4), 20).alias("w")).collect()]
    assert not got[0].startswith("[...]") and got[1].startswith("[...] ") and got[1].endswith(" [...]")


def test_restored_trees_have_ids_of_their_own(spark):
    docs = spark.createDataFrame([(1, "t", 1, "u", 1, "superseded"), (2, "t", 1, "u", 2, "active")], "id long, tenant_id string, knowledge_base_id long, source_uri string, version int, status string")
    parents = spark.createDataFrame([(7, 1, "P"), (8, 2, "Q")], "id long, document_id long, title string")
    parts = spark.createDataFrame([(10, 1, 7, 1, "superseded"), (11, 1, None, 1, "deleted"), (12, 2, 8, 2, "active")], "id long, document_id long, parent_id long, version int, status string")
    vectors = spark.createDataFrame([(10, 1, "m"), (12, 2, "m")], "chunk_id long, document_id long, embedding_model string")
    out = {k: v.collect() for k, v in store.restore_tree(docs, parents, parts, vectors, docs.where("id = 1").select("id")).items()}
    (doc,) = out["documents"]
    assert (doc.version, doc.status) == (3, "active") and doc.id not in (1, 2)
    assert {r.document_id for rows in (out["parents"], out["chunks"], out["vectors"]) for r in rows} == {doc.id} and len(out["chunks"]) == 2
    ids = {r.id for r in out["chunks"]}
    assert not ids & {10, 11, 12} and {r.chunk_id for r in out["vectors"]} <= ids and {r.parent_id for r in out["chunks"]} == {out["parents"][0].id, None}


def test_package_hash_falls_back_to_parents(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string")
    rows = spark.createDataFrame([("a", "b1", 1, 2, "two"), ("a", "b0", 1, 1, "one  \r\n"), ("a", "b0", 1, 1, "one  \r\n"), ("b", "b2", 1, 1, "  ")], "document_id string, block_id string, page_number int, reading_order int, text string")
    parents = spark.createDataFrame([("a", "p", 1, "other"), ("b", "p", 1, "held")], "document_id string, parent_id string, page_start int, text string")
    got = {r.document_id: r.hash for r in store.package_hashes(docs, rows, parents).collect()}
    expected = {r.k: r.h for r in spark.createDataFrame([("a", "one\n\ntwo"), ("b", "﻿held")], "k string, t string").select("k", T.content_hash(F.col("t")).alias("h")).collect()}
    assert got == expected | {"c": None}


def test_media_context_of_templates(spark):
    rows = [block(0, "a", path=["A"]), block(1, "b", path=["A"]), block(2, "t", "table", path=["A"]), block(3, "Table 1", "caption", path=["A"]), block(4, "c", path=["A"]), block(5, "d", path=["A"])]
    _, drafts, _ = chunks(spark, rows, "generic_structured")
    source = frame(spark, rows).withColumn("caption", F.lit(None).cast("string")).withColumn("section_id", F.lit("s"))
    for n, before, after in ((1, "Table 1\n\nb", "Table 1"), (2, "Table 1\n\na\n\nb", "Table 1\n\nc"), (0, "Table 1", None)):
        configs = spark.createDataFrame([("generic_structured", n, 2)], "template string, table_context_blocks int, image_context_blocks int")
        got = B.media_context(drafts.where("chunk_type = 'table'"), source, configs)
        assert [(r.context_before, r.context_after) for r in got.collect()] == [(before, after)]
    assert stats.context_coverage(got).first().coverage == 1.0 and stats.context_coverage(got.where("false")).first().coverage == 1.0


def test_vectors_are_validated_before_they_are_kept(spark):
    kind = "chunk_id long, embedding array<float>, embedding_model string, embedding_dim int, created_at int"
    table = spark.createDataFrame([(1, [1.0, 0.0], "m", 2, 1)], kind)
    changes = spark.createDataFrame([(1, [0.0, 1.0], "m", 2, 2), (2, [1.0], "m", 1, 2), (3, [1.0, float("nan")], "m", 2, 2), (4, [1.0, 1.0], "x", 2, 2), (5, [1.0, 1.0], "m", 2, 2), (5, [1.0, 1.0], "m", 2, 3)], kind)
    state, faults = store.put_vectors(table.withColumn("created_at", F.timestamp_seconds("created_at")), changes.withColumn("created_at", F.timestamp_seconds("created_at")), {"m": 2})
    assert {(r.chunk_id, tuple(r.embedding)) for r in state.collect()} == {(1, (0.0, 1.0)), (5, (1.0, 1.0))}
    assert sorted((r.rule, r.key) for r in faults.collect()) == [("twice", "5"), ("unusable", "2"), ("unusable", "3"), ("unusable", "4")]


def test_structured_chunks_and_small_expressions(spark):
    raw = '[{"raw_text": " body ", "page_number": 0, "headings": [], "chapter": "C", "section": "S", "content_type": "text"}, {"raw_text": "  "}, {"raw_text": "t", "page_number": 2, "headings": ["H"], "content_type": "table"}]'
    df = spark.createDataFrame([("d", raw), ("e", "no")], "id string, c string")
    got = [(r.page_number, r.reading_order, r.block_type, r.text, r.heading_path) for r in files.structured_chunks(df, "id", "c").orderBy("reading_order").collect()]
    assert got == [(1, 0, "paragraph", "body", ["C", "S"]), (2, 2, "table", "t", ["H"])]
    one = spark.range(1).select(
        L.heading_domain(F.array(F.lit("Engine removal")), F.lit("x")).alias("a"), L.heading_domain(F.lit(None).cast("array<string>"), F.lit("责任免除")).alias("b"), L.looks_like_heading(F.lit("1.2 Scope\nbody")).alias("c"),
        L.looks_like_heading(F.lit("1.2 ends here.")).alias("d"), L.page_size(F.lit('{"w": 595, "page_height": "842"}')).alias("e"), T.warning(F.lit("odd")).alias("f"), T.warning(F.lit('{"level": "info", "message": "m", "source": "s"}')).alias("g"),
        T.compact_json(F.struct(F.lit(None).cast("string").alias("x"), F.lit(1).alias("y"))).alias("h"),
    ).first()
    assert (one.a, one.b, one.c, one.d) == ("Engine", "责任免除", True, False) and (one.e.width, one.e.height) == (595.0, 842.0)
    assert tuple(one.f) == ("warning", "odd", "ingest") and tuple(one.g) == ("info", "m", "s") and one.h == '{"y":1}'
