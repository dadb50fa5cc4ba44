"""Ranking, packing, markup and scans."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import queries
from quern.llm.fuse import first_of_group, rank_places, rank_walk, walk
from quern.llm.markup import clean_text, label_texts, markup_residue, model, training_texts, with_source
from quern.llm.pack import estimate, over, oversized_pieces, split
from quern.llm.scans import Lexicon, is_page_number, paragraphs, repair, scanned_faults, skeleton, word_faults


def places(values):
    return [1 + sum(1 for y in values if y is not None and (x is None or y > x)) for x in values]


@pytest.mark.parametrize("window", [3, 1000])
def test_places_and_walk_by_memory_and_by_tables(spark, window):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(3):
        for i in range(12):
            a = None if i == 3 else float("nan") if i == 4 else float(rng.integers(0, 5))
            rows.append((f"g{g}", i, a, float(rng.random()), 3))
    rows += rows[:5] + [(None, 1, 1.0, 1.0, 3), ("g9", None, 1.0, 1.0, 3), ("one", 1, None, None, 3)]
    df = spark.createDataFrame(rows, "g string, i long, a double, b double, k int")
    out = {(r.g, r.i): r for r in rank_walk(df, "g", "i", ["a", "b"], {"k": F.max("k")}).collect()}
    assert len(out) == 37
    for g in ("g0", "g1", "g2"):
        own = [r for r in rows[:36] if r[0] == g]
        for s in (2, 3):
            values = [None if r[s] is None or r[s] != r[s] else r[s] for r in own]
            got = [out[(g, r[1])][f"place_{'ab'[s - 2]}"] for r in own]
            assert got == places(values)
        assert abs(sum(out[(g, r[1])].stationarity for r in own) - 1) < 1e-6
    assert out[("one", 1)].stationarity == 1
    binned = rank_places(df.where("g is not null and i is not null").dropDuplicates(["g", "i"]), "g", "i", ["b"], window_values=window)
    assert {(r.g, r.i): r.place_b for r in binned.collect()} == {k: r.place_b for k, r in out.items()}
    if window == 3:
        large = {(r.g, r.i): r.stationarity for r in rank_walk(df, "g", "i", ["a", "b"], rounds=12, memory_items=5).collect()}
        small = {(r.g, r.i): r.stationarity for r in rank_walk(df, "g", "i", ["a", "b"], rounds=12).collect()}
        assert all(abs(large[k] - small[k]) < 1e-9 for k in small)
    assert rank_walk(df.where("false"), "g", "i", ["a", "b"]).count() == 0


def test_walk_step_matches_the_matrix():
    higher = np.array([[0, 1], [1, 0], [1, 3], [3, 2]])
    n = 4
    p = np.zeros((n, n))
    for s in range(2):
        for i in range(n):
            up = [j for j in range(n) if higher[j, s] < higher[i, s]]
            for j in up or [i]:
                p[i, j] += 0.5 / len(up or [i])
    x = np.full(n, 1 / n)
    for _ in range(300):
        x = 0.15 / n + 0.85 * x @ p
    assert np.allclose(walk(higher, 0.85, 300, 1e-14), x)


def test_first_of_group_uses_its_own_limit(spark):
    df = spark.createDataFrame([("a", i, 2) for i in range(9)] + [("b", 1, 5)], "g string, i long, k int")
    out = first_of_group(df, "g", "i", [F.asc("i")], "k").collect()
    assert sorted((r.g, r.i) for r in out) == [("a", 0), ("a", 1), ("b", 1)]


def test_p3_found_runs_no_walk_and_p3_walk_goes_by_it(spark, tmp_path):
    """Each stage decides something: the walk the order of p3_walk, the places that of p3_found, which has no Python stage."""
    nan = float("nan")
    rng = np.random.default_rng(8)
    rows = [("r", i, a, b, 3) for i, (a, b) in enumerate([(9.0, 1.0), (8.0, 2.0), (7.0, 3.0), (6.0, 4.0), (5.0, 5.0), (4.0, 6.0), (3.0, 7.0), (2.0, 8.0)])]
    rows += [("odd", 1, None, nan, 2), ("odd", 2, nan, -0.0, 2), ("odd", 3, 1.0, 0.0, 2), ("odd", 4, 1.0, None, 2), ("odd", 4, nan, 0.0, 2), ("few", 1, nan, None, 5), ("none", 1, 1.0, 1.0, 0)]
    rows += [(f"x{g}", i, float(rng.integers(0, 9)), float(rng.integers(0, 9)), 6) for g in range(8) for i in range(20)]
    spark.createDataFrame(rows, "request_id string, chunk_id long, rerank_score double, vector_score double, final_top_k int").write.parquet(f"{tmp_path}/ranked_candidates.parquet")
    best: dict = {}
    for g, i, a, b, k in rows:
        own = best.setdefault(g, {}).setdefault(i, [None, None, k])
        for s, v in enumerate((a, b)):
            own[s] = max((x for x in (own[s], v) if x is not None and x == x), default=None)
    expected, walked = set(), set()
    for g, items in best.items():
        by = [places([v[s] for v in items.values()]) for s in range(2)]
        limit = next(iter(items.values()))[2]
        share = walk(np.array(by).T - 1, 0.85, 100, 1e-10)
        expected |= {(g, i) for *_, i in sorted(zip(np.add(*by).tolist(), by[0], items, strict=True))[:limit]}
        walked |= {(g, i) for *_, i in sorted(zip((-np.round(np.log(share), 8)).tolist(), by[0], items, strict=True))[:limit]}
    found = queries.p3_found(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == expected
    assert {(r.request_id, r.chunk_id) for r in queries.p3_walk(spark, str(tmp_path)).collect()} == walked != expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "FileScan" in plan


def check_split(text, limit, overlap):
    pieces = split(text, limit, overlap)
    assert "".join(text[s:e] for _, s, e, _ in pieces) == text
    for b, s, e, n in pieces:
        assert b <= s <= e and n == estimate(text[b:e]) and (n <= limit or n <= 2)
        assert estimate(text[b:s]) <= overlap
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab-'中文。.\n #,1"), max_size=300), st.integers(3, 40), st.integers(0, 15))
def test_splits_cover_the_text_within_the_limit(text, limit, overlap):
    if estimate(text) > limit:
        check_split(text, limit, overlap)


def test_splits_prefer_headings_and_paragraphs(prose):
    text = f"# One\n\n{prose(40)}\n\n# Two\n\n{prose(40)}"
    pieces = check_split(text, 90, 0)
    assert [text[s : s + 5] for _, s, _, _ in pieces] == ["# One", "# Two"]
    text = f"{prose(30)}.\n\n{prose(30)}."
    assert [text[s - 2 : s] for _, s, _, _ in check_split(text, 45, 0)][1] == "\n\n"


def test_oversized_items_take_the_limits_of_their_type(spark, prose):
    blocks = spark.createDataFrame([("b1", "d1", prose(100)), ("b1", "d1", None), ("b2", "d1", None), ("b3", "d2", prose(100)), ("b4", "none", prose(400)), ("b5", "d1", "")], "block_id string, document_id string, text string")
    blocks = blocks.where("block_id <> 'b1' or text is not null")
    parents = spark.createDataFrame([("p1", "d1", prose(100)), ("p1", "d1", prose(1))], "parent_id string, document_id string, text string").where("length(text) > 50")
    docs = spark.createDataFrame([("d1", "qa"), ("d2", "book"), ("d3", None)], "package_id string, doc_type string")
    configs = spark.createDataFrame([("qa", 60, 10), ("book", 600, 0), ("generic_structured", 300, 20)], "template string, child_max_tokens int, overlap_tokens int")
    out = oversized_pieces(blocks.unionByName(blocks), parents, docs, configs).collect()
    assert {(r.item_kind, r.item_id) for r in out} == {("block", "b1"), ("parent", "p1"), ("block", "b4")}
    assert all(r.tokens <= {"b1": 60, "p1": 60, "b4": 300}[r.item_id] for r in out)
    assert sum(r.piece == 1 for r in out) == 3
    assert over(blocks.where("false"), "text", 10).count() == 0


MARKED = [
    ("A report <b>valve</b> here.", "paragraph", "A report valve here."), ("Text &nbsp;and&hellip;", "paragraph", None), ("one **two** three", "paragraph", "one two three"), ("see [x](/a/b) now", "paragraph", "see x now"),
    ("\\section{Annex}", "heading", "# Annex"), ("{{note|clause}} stands", "paragraph", "clause stands"), ("[[Main page|queue]] stands", "paragraph", "queue stands"), ("$$E = m v^{2} / 2$$", "formula", "E = m v^{2} / 2"),
    ("<pre><code>if (a &lt; b) x();</code></pre>", "code", "if (a < b) x();"), ("<table><tr><td>A</td><td>1</td></tr></table>", "table", "A\t1"), ("a & 12 \\\\\nb & 13 \\\\\n\\end{tabular}", "table", None), ("text </p>", "paragraph", "text"),
]
PLAIN = [
    ("where (a < b, c > d) holds", "paragraph"), ("costs $40 or $60 now", "paragraph"), ("in C# and F# notes", "paragraph"), ("R&D and Q&A", "paragraph"), ("item #4512 as noted in [1]", "paragraph"), ("with snake_case_name set", "paragraph"),
    ("C:\\data\\in holds it", "paragraph"), ("for {tenant} filled in", "paragraph"), ("2^10 items, ~20 ms, 5 * 3 * 2", "paragraph"), ("<config>\n  <limit>5</limit>\n</config>", "code"), ("# set the limit\nexport LIMIT=5", "code"), ("\\frac{a_1}{b} = c^2", "formula"), ("plain text", "paragraph"), ("", "paragraph"),
]


def test_markup_examples():
    found = label_texts([t for t, *_ in MARKED], [b for _, b, _ in MARKED], model())
    for (text, _, clean), (nodes, label) in zip(MARKED, found, strict=True):
        assert label.any(), text
        if clean is not None:
            assert clean_text(text, nodes, label) == clean
    for (text, _), (_, label) in zip(PLAIN, label_texts([t for t, _ in PLAIN], [b for _, b in PLAIN], model()), strict=True):
        assert not label.any(), text


def test_markup_model_on_held_out_texts():
    texts = list(training_texts(500, seed=77))
    found = label_texts([t for t, _, _ in texts], [b for _, b, _ in texts], model())
    wrong = sum(bool(label.any()) != any(n.start < e and n.end > s for n in nodes for s, e in ranges) for (_, _, ranges), (nodes, label) in zip(texts, found, strict=True))
    assert wrong <= 10


def test_markup_residue_of_odd_rows(spark):
    rows = [("b1", "paragraph", "a <b>x</b>", 1), ("b1", "paragraph", "a <b>x</b>", 1), ("b2", None, "a <b>x</b>", 1), ("b3", "paragraph", None, 1), ("b4", "code", "", 1), (None, "list", "<li>x", 1), ("b5", "paragraph", "< " * 20_000, 1)]
    df = spark.createDataFrame(rows, "block_id string, block_type string, text string, marks int")
    assert sorted(str(r.block_id) for r in markup_residue(df).collect()) == ["None", "b1", "b1", "b2"]
    assert markup_residue(df.where("false")).count() == 0


def lexicon():
    words = {w: 100 for w in "the valve report firmware never settles a certificate permission of subscription nicht steuern die au-delà services techniques with and delà au".split()}
    text = "die Berichte für den Ämtern ôéèà 已经 未经 大约 责任 登记" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    letters = {c: 1000 for c in text if c.isalpha()}
    return Lexicon(words, letters, {"已经": 900, "未经": 900, "大约": 900, "责任": 900, "登记": 900})


@pytest.mark.parametrize(
    ("text", "kind", "clean"),
    [
        ("the firmvvare settles", "misread", "the firmware settles"), ("the cer†ificate", "sign", "the certificate"), ("a va1ve", "misread", "a valve"), ("the perrnission", "misread", "the permission"), ("die nicbt", "misread", "die nicht"), ("a r e p o r t never", "spaced", "a report never"),
        ("the services tech-\nniques", "cut", "the services techniques"), ("the services tech\xad\r\nniques", "cut", "the services techniques"), ("the subscriptionof", "joined", "the subscription of"), ("the val•ve", "sign", "the valve"), ("事故己经", "misread", "事故已经"), ("the nicHt", "case", "the nicht"),
    ],
)
def test_scan_faults(text, kind, clean):
    kinds, out = repair(text, set(), lexicon())
    assert kind in kinds and out == clean


@pytest.mark.parametrize("text", ["the valve report\nnever settles", "the code AB-1234C and 12.5", "Morkesstime settles the report", "Au-\ndelà the valve", "", "12\t13"])
def test_clean_scans_have_no_fault(text):
    assert word_faults(text, lexicon()) == []


def test_page_numbers_and_skeletons():
    for x in ("[16]", "· 4 ·", "— 9 —", "17/40", "p. 3", "Page 9 of 9", "Seite 4", "第 9 页", "xviii", "l9", "28"):
        assert is_page_number(x), x
    for x in ("Scope", "AB-1234C", "", "in 1998 it", "civil"):
        assert not is_page_number(x), x
    assert skeleton("15   KP-4089A  Remises et services") == skeleton("KP-4089A  REMISES ET SERVICES   16") == skeleton("KP-4089A  Rernises et serviccs  3")


def test_paragraphs_join_lines_of_a_sentence():
    assert paragraphs(["The valve is", "open today.", "Short.", "A next one that runs on", "and ends."])[0].startswith("The valve is open today.")


def test_scanned_faults_end_to_end(spark):
    body = "the valve report never settles the certificate of permission"
    box = (60.0, 300.0, 540.0, 340.0)
    rows = []
    for page in (1, 2, 3):
        rows.append((f"h{page}", "scan", page, "paragraph", f"{page}  Anlagen bei Morlu", (60.0, 40.0, 540.0, 52.0)))
        rows.append((f"b{page}", "scan", page, "paragraph", body, box))
    rows += [("n1", "scan", 2, "paragraph", f"{body}\nANLAGEN BEI MORLU  2\n{body}", box), ("n2", "scan", 2, "paragraph", f"{body}\n[2]\n{body}", box), ("h4", "scan", 4, "heading", "Anlagen bei Morlu 4", None), ("s1", "scan", 4, "heading", "Scope", box), ("e1", "scan", 4, "paragraph", "", box), ("e2", "scan", 4, "paragraph", None, None), ("t1", "scan", 4, "table", "12\n13", box)]
    rows += [(f"c{i}", "clean", 1, "paragraph", f"{body} {body}", None) for i in range(20)] + [("c99", "clean", 1, "paragraph", "a cer†ificate", None), ("x", None, 1, "paragraph", "a cer†ificate", None)]
    blocks = spark.createDataFrame(rows + rows[:3], "block_id string, document_id string, page_number int, block_type string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    docs = spark.createDataFrame([("scan", "a.pdf"), ("clean", "a.md"), ("none", None)], "package_id string, source_uri string")
    out = {r.block_id: r for r in scanned_faults(blocks, docs).collect()}
    assert set(out) == {"h1", "h2", "h3", "h4", "n1", "n2"}
    assert out["n1"].clean == f"{body} {body}" and out["h1"].clean == ""
    assert scanned_faults(blocks.where("false"), docs).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "clean"),
    [
        ("the certi ficate settles", "spaced", "the certificate settles"), ("the certi\nficate settles", "cut", "the certificate settles"), ("t h e valve", "spaced", "the valve"),
        ("the per missionof a valve", "spaced", "the permission of a valve"), ("责 任 登记", "spaced", "责任 登记"), ("未经责 任", "spaced", "未经责任"),
    ],
)
def test_words_broken_by_blanks_and_line_ends(text, kind, clean):
    kinds, out = repair(text, set(), lexicon())
    assert kind in kinds and out == clean


@pytest.mark.parametrize("text", ["the valve report", "Mor lu settles", "the report. ment", "die nicht au delà"])
def test_blanks_between_whole_words_stay(text):
    assert repair(text, set(), lexicon()) == ([], text)


@pytest.mark.parametrize(
    ("text", "kinds", "clean"),
    [
        ("未经责任登记大约已经责任 services tech-\nniques 登记责任大约未经已经登记", ["cut"], "未经责任登记大约已经责任 services techniques 登记责任大约未经已经登记"),
        ("大约责任登记未经责任登记 the\nvalve 已经登记大约", [], "大约责任登记未经责任登记 the valve 已经登记大约"), ("已经登记大约责任\n登记未经", [], "已经登记大约责任登记未经"),
    ],
)
def test_latin_words_at_line_ends_of_chinese_text(text, kinds, clean):
    assert repair(text, set(), lexicon()) == (kinds, clean)


def test_decoder_has_no_bound_of_length():
    lex = lexicon()
    assert lex.decode("thevalvereportneversettlestheservices") == ("the", "valve", "report", "never", "settles", "the", "services")
    assert lex.decode("thevalve" * 15) == ("the", "valve") * 15
    long = Lexicon({"donaudampfschiffahrtsgesellschaftskapitän": 50, "nicht": 50}, {c: 1000 for c in "abcdefghijklmnopqrstuvwxyzä"}, {})
    assert long.decode("donaudarnpfschiffahrtsgesellschaftskapitän", whole=True) == ("donaudampfschiffahrtsgesellschaftskapitän",)
    assert long.decode("nichtdonaudampfschiffahrtsgesellschaftskapitän") == ("nicht", "donaudampfschiffahrtsgesellschaftskapitän")
    assert lex.decode("vlk" * 3_000) is None


def test_parts_of_a_joined_run_are_common_by_share():
    small, large = ({w: n for w in ("subscription", "report")} | {"the": 20_000 * n} for n in (5, 500))
    assert Lexicon(small, {}, {}).decode("subscriptionreport") == Lexicon(large, {}, {}).decode("subscriptionreport")


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("the certifi-\ncatc settles", "the certificate settles"), ("the subscriptionfirm-\nware settles", "the subscription firmware settles"), ("the certi ficate of permis-\nsion", "the certificate of permission"),
        ("the v a l v e report", "the valve report"), ("the " + "valve " * 40 + "certi ficate", "the " + "valve " * 40 + "certificate"), ("subscription" * 12, " ".join(["subscription"] * 12)),
    ],
)
def test_joint_decoding_of_splits_merges_hyphens_and_confusions(text, clean):
    kinds, out = repair(text, set(), lexicon())
    assert kinds and out == clean


def test_body_in_the_margin_and_numbers_in_tables_are_no_furniture(spark):
    body = "the valve report never settles the certificate of permission."
    low, mid = (60.0, 720.0, 540.0, 760.0), (60.0, 300.0, 540.0, 340.0)
    texts = [f"the {w} never settles. " * 200 + f"the {w} settles." for w in ("valve", "report", "certificate", "firmware")]
    rows = [("low", "scan", 1, 9, "paragraph", body, low), ("cell", "scan", 1, 3, "table", "47", mid), ("foot", "scan", 1, 10, "paragraph", "Morlu · report", low)]
    rows += [(f"head{p}", "other", p, 1, "heading", "Scope", mid) for p in (1, 2, 3, 4)]
    rows += [(f"run{p}", "third", p, 1, "paragraph", f"Morlu permission {p}\n" + own, mid) for p, own in enumerate(texts, 1)]
    rows += [(f"c{i}", "clean", 1, i, "paragraph", f"{body} {body} firmware Scope Morlu", None) for i in range(20)]
    blocks = spark.createDataFrame(rows, "block_id string, document_id string, page_number int, reading_order int, block_type string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    docs = spark.createDataFrame([("scan", "a.pdf"), ("other", "b.pdf"), ("third", "c.pdf"), ("clean", "a.md")], "package_id string, source_uri string")
    out = {r.block_id: r for r in scanned_faults(blocks, docs).collect()}
    assert set(out) == {"foot", "run1", "run2", "run3", "run4"}
    assert out["run1"].kinds == ["furniture"] and out["run1"].clean == texts[0]


def _cleaned(text, block="paragraph", **sources):
    ((nodes, label),) = label_texts([text], [block], model())
    return with_source(clean_text(text, nodes, label, block), list(sources.values()), block, model())


@pytest.mark.parametrize(
    ("text", "block", "clean"),
    [
        ("Set `x**2` first.", "paragraph", "Set x**2 first."), ("Call `a_b_c` and **stop**.", "paragraph", "Call a_b_c and stop."), ("Run\n```\nbbb = 22   # x\n\n\nb   c\n```\nnow", "paragraph", "Run\n\nbbb = 22   # x\n\n\nb   c\n\nnow"),
        ("```sh\nif a:\n    b   = 1\n\n\n\n# done\n```", "code", "if a:\n    b   = 1\n\n\n\n# done"), ("<pre>a    b\n  c</pre>", "code", "a    b\n  c"), ("<acronym>WHO</acronym> says", "paragraph", "WHO says"), ("a <code>x_1 * y_1</code> <i>b</i>", "paragraph", "a x_1 * y_1 b"),
    ],
)
def test_code_inside_text_is_kept(text, block, clean):
    assert _cleaned(text, block) == clean


def test_structure_comes_from_html_or_markdown_of_the_same_content():
    html = "<ul><li>one rule</li><li>two rules</li></ul>"
    assert _cleaned("one rule</li> two rules", "list", html=html) == "- one rule\n- two rules"
    assert _cleaned("one rule</li> two rules", "list", html=None, markdown="* one rule\n* two rules") == "- one rule\n- two rules"
    assert _cleaned("one rule</li> two", "list", html=html) == "one rule\n two"  # another state of the block
    table = "<table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>"
    assert _cleaned("a <td>1 b 2</td></tr>", "table", html=table) == "a\t1\nb\t2"


HELD_OUT = [
    ("The <small>annual</small> report<br />ends.", True), ("See [the guide](../guide.md) for &mdash; more.", True), ("==== Deep heading ====\ntext", True), ("\\subsubsection{Pumps} start \\textit{slowly}", True), ("* first\n* second", True), ("| pump | 3 |\n| --- | --- |\n| valve | 4 |", True),
    ("{{Infobox|name=Valve}} text", True), ("[[Valve#Parts|parts]] of it", True), ("text <sub>2</sub>", True), ("1 < 2 and 5 > 3", False), ("costs $12 or $15 a month", False), ("the file_name_2 of a_b", False), ("5 * 4 = 20", False), ("[12] and [3, 4]", False), ("the C:\\temp folder", False), ("use <name> here", False),
    ("Smith & Sons, No. #4", False), ("~ 20 percent", False),
]


def test_markup_model_on_texts_not_written_by_its_templates():
    found = label_texts([t for t, _ in HELD_OUT], ["paragraph"] * len(HELD_OUT), model())
    assert sum(bool(label.any()) == marked for (_, label), (_, marked) in zip(found, HELD_OUT, strict=True)) >= len(HELD_OUT) - 1


def _sections(*sizes):
    return "\n\n".join(f"# {chr(65 + i)}\n\n" + "\n\n".join(" ".join([f"{chr(97 + i)}{k}"] * n) for k, n in enumerate(part)) for i, part in enumerate(sizes))


def test_only_whole_siblings_are_merged():
    text = _sections((60, 20), (20,), (20,))
    pieces = [text[s:e] for _, s, e, _ in split(text, 90, 0)]
    assert "".join(pieces) == text
    assert not any("# B" in p and "a1" in p for p in pieces) and any("# B" in p and "# C" in p for p in pieces)


def test_fenced_code_is_a_node():
    text = "Intro words here.\n\n```\n# no heading\n\nx = 1\n```\n\n" + "more words " * 20
    pieces = [text[s:e] for _, s, e, _ in split(text, 30, 0)]
    assert "".join(pieces) == text and any("# no heading" in p and "x = 1" in p for p in pieces)


@pytest.mark.parametrize("overlap", [0, 10, 25, 39, 40, 100])
def test_overlap_is_what_was_asked(overlap):
    text = " ".join(f"w{i}" for i in range(400))
    out = split(text, 40, overlap)
    assert all(estimate(text[b:e]) <= 40 for b, _, e, _ in out) and "".join(text[s:e] for _, s, e, _ in out) == text
    if overlap:
        for (b0, _, e0, _), (b, s, _, _) in zip(out, out[1:], strict=False):
            wanted = min(overlap, 39, estimate(text[b0:e0]))  # a piece shares no more than the one before holds
            assert wanted - 3 <= estimate(text[b:s]) <= wanted


def test_walk_of_a_large_group_keeps_its_order():
    rng = np.random.default_rng(8)
    n = 60_000
    higher = np.stack([rng.permutation(n), rng.permutation(n)], axis=1)
    share = walk(higher, 0.85, 100, 1e-10)
    assert len(np.unique(np.round(np.log(share), 8))) > 0.95 * n


@pytest.mark.parametrize("text", ["the valve report " * 4000 + "certi ficate", "el perro come mucho pan " * 2500, "xqz brq zzz " * 3000, "a " * 6000, "report" * 3000])
def test_very_long_stretches_take_time_in_proportion(text):
    start = time.perf_counter()
    word_faults(text, lexicon())
    assert time.perf_counter() - start < 20
