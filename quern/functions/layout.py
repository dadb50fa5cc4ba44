"""Expressions over page layout: boxes, wrapped lines, page metadata, answers of services."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
#: Words by which a page's domain is known.
DOMAINS = (
    ("Engine", ("engine", "starter", "oil", "coolant", "temperature", "fuel", "rpm", "crankcase")),
    ("Generator", ("generator", "voltage", "regulator", "contactor", "rectifier", "field", "brush")),
    ("Troubleshooting", ("troubleshoot", "fault", "symptom", "will not", "won't", "problem", "fails", "stops")),
    ("保险条款", ("保险金", "被保险人", "投保人", "保险费", "保险期间", "保险责任", "责任免除", "犹豫期")),
    ("理赔", ("理赔", "给付", "赔偿", "赔付", "申请保险金")),
    ("合同条款", ("合同成立", "合同效力", "合同解除", "合同终止", "合同变更", "现金价值")),
)
#: Words by which the domain of headings and of the text under them is known, in order of precedence.
HEADING_DOMAINS = (
    ("Troubleshooting", ("troubleshoot",)), ("Engine", ("removal", "installation")), ("Generator", ("generator",)), ("Maintenance", ("maintenance", "lubrication", "filter")), ("Engine", ("engine", "fuel", "coolant")),
    ("Electrical", ("electric", "circuit", "wiring")), ("Maintenance", ("repair", "torque", "adjustment")), ("责任免除", ("责任免除", "免责")), ("保险责任", ("保险责任", "保险金", "给付")), ("理赔", ("理赔", "赔偿", "赔付", "申请保险金")),
    ("合同条款", ("合同成立", "合同效力", "合同解除", "合同终止")), ("保险费", ("保险费", "缴费", "费率")), ("期间条款", ("犹豫期", "宽限期", "等待期")), ("保险条款", ("被保险人", "投保人", "受益人")),
)
#: Characters of a text that tell its domain beside the headings.
DOMAIN_HEAD = 1_200
#: Fixed value: numerals in Chinese titles.
_CN = "[一二三四五六七八九十百千万零\\d]+"


def ordered_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box with its corners in order; null where one is missing."""
    box = F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))
    return F.when(x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull(), box)


def box_of(value: Column) -> Column:
    """The box in a JSON value: four numbers, a polygon of points, or an object with x0.. or l, t, r, b; also under bbox, box, position, poly."""
    out = _plain_box(value)
    for key in ("bbox", "box", "position", "layout_bbox", "poly", "polygon"):
        out = F.coalesce(out, _plain_box(F.get_json_object(value, f"$.{key}")))
    return out


def _plain_box(value: Column) -> Column:
    v = strip(value)
    flat = F.from_json(F.when(v.rlike(r"^\[\s*-?[\d.]"), v), "array<double>")
    points = F.from_json(F.when(v.rlike(r"^\[\s*\["), v), "array<array<double>>")
    xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    named = F.from_json(F.when(v.startswith("{"), v), "x0 double, y0 double, x1 double, y1 double, l double, t double, r double, b double")
    return F.coalesce(
        ordered_box(*(F.get(flat, F.lit(i)) for i in range(4))),
        ordered_box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)),
        ordered_box(named["x0"], named["y0"], named["x1"], named["y1"]),
        ordered_box(named["l"], named["t"], named["r"], named["b"]),
    )


def box_in_page(box: Column, width: Column, height: Column) -> Column:
    """Whether a box lies on its page, give or take a point; true where the page's size is unknown."""
    inside = box["x0"].between(-1, width + 1) & box["x1"].between(-1, width + 1) & box["y0"].between(-1, height + 1) & box["y1"].between(-1, height + 1)
    return F.when(width.isNull() | height.isNull(), True).otherwise(inside)


def vertical_overlap(a: Column, b: Column) -> Column:
    """Shared height over the smaller height; 0 if apart."""
    shared = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when(shared > 0, shared / F.greatest(F.lit(1.0), F.least(a["y1"] - a["y0"], b["y1"] - b["y0"]))).otherwise(0.0)


def merge_lines(text: Column) -> Column:
    """Paragraphs of a text whose lines were wrapped: array<string>.

    A paragraph ends after terminal punctuation, at a blank line, or where a
    line begins a chapter, article or list item; Latin words are joined with a
    space, CJK without. The state of the fold is the paragraphs so far.
    """
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), strip)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state: Column, line: Column) -> Column:
        now = state["now"]
        closed = now.rlike("[。！？；.!?;:：]$")
        opens = line.rlike(rf"(?i)^(?:第{_CN}[章节条编部篇]|(?:chapter|section|article|part)\s+\d|\d+(?:\.\d+)*[.、)]?\s|[-*•·]\s|[（(]{_CN}[)）])")
        push = (now != "") & ((line == "") | closed | opens)
        gap = F.when(now.rlike("[A-Za-z]$") & line.rlike("^[A-Za-z]"), " ").otherwise("")
        return F.struct(
            F.when(push, F.concat(state["done"], F.array(now))).otherwise(state["done"]).alias("done"),
            F.when(line == "", "").when(push | (now == ""), line).otherwise(F.concat(now, gap, line)).alias("now"),
        )

    return F.aggregate(lines, empty, step, lambda s: F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def page_chapter(text: Column) -> Column:
    number = F.regexp_extract(text, r"(?i)Chapter\s+(\d+(?:-\d+)?)", 1)
    title = F.regexp_extract(text, f"第{_CN}[章编部篇]", 0)
    return F.when(number != "", number).when(title != "", title)


def page_section(text: Column) -> Column:
    number = F.regexp_extract(text, r"(?i)Section\s+(\d+)\.", 1)
    title = F.regexp_extract(text, f"第{_CN}[条节]", 0)
    return F.when(number != "", number).when(title != "", title)


def domain_hint(text: Column) -> Column:
    """The domain whose words a page holds; of several Troubleshooting, else the first; null for none."""
    low = F.lower(text)
    found = F.filter(F.array(*(F.when(low.rlike("|".join(words)), F.lit(name)) for name, words in DOMAINS)), lambda x: x.isNotNull())
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).when(F.array_contains(found, "Troubleshooting"), "Troubleshooting").otherwise(F.get(found, F.lit(0)))


def heading_domain(headings: Column, text: Column) -> Column:
    """The first domain of HEADING_DOMAINS with a word in the headings or in the beginning of the text; null for none."""
    seen = F.lower(F.concat(F.array_join(F.coalesce(headings, F.array().cast("array<string>")), " "), F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, DOMAIN_HEAD)))
    return F.coalesce(*(F.when(seen.rlike("|".join(words)), F.lit(name)) for name, words in HEADING_DOMAINS))


def looks_like_heading(text: Column) -> Column:
    """Whether the first line of a paragraph of a page text heads what follows: short, no sentence, and numbered or named so."""
    line = strip(F.regexp_extract(F.coalesce(text, F.lit("")), r"^([^\n\r]*)", 1))
    named = line.rlike(r"(?i)^(?:chapter|section)\s+\d+") | line.rlike(r"^\d+(?:\.\d+){0,3}\s+\S+") | line.rlike("^第.+[章节条]")
    return (line != "") & (F.length(line) <= 80) & ~line.rlike("[。！？；.!?;:：]$") & named


def page_size(value: Column) -> Column:
    """Struct of width and height in a JSON object of a page, under any of the usual names; null where there is none."""
    sides = {"width": ("width", "w", "page_width"), "height": ("height", "h", "page_height")}
    return F.struct(*(F.coalesce(*(F.get_json_object(value, f"$.{k}").try_cast("double") for k in keys)).alias(side) for side, keys in sides.items()))


def article_title(line: Column) -> Column:
    """第 1 条 合同构成 ... as 第1条 合同构成: the label without spaces and the first word after it."""
    label = F.regexp_replace(F.regexp_extract(line, r"^\s*(第\s*(?:[一二三四五六七八九十百千万零〇两0-9]\s*)+条)\s*(.*)$", 1), r"\s+", "")
    tail = F.regexp_extract(line, r"^\s*(第\s*(?:[一二三四五六七八九十百千万零〇两0-9]\s*)+条)\s*(.*)$", 2)
    word = F.regexp_replace(F.regexp_extract(tail, r"^\S+", 0), "^[。；;:：，,]+|[。；;:：，,]+$", "")
    head = F.trim(F.regexp_extract(tail, "^[^。；;:：，,]*", 0))
    rest = F.when((word != "") & (F.length(word) <= 30), word).when((head != "") & (F.length(head) <= 30), head).otherwise(F.trim(F.substring(tail, 1, 30)))
    return F.when(label == "", strip(line)).when(F.trim(tail) == "", label).otherwise(F.concat(label, F.lit(" "), rest))


def answer_of(payload: Column) -> Column:
    """The answer text of a generation service's JSON, in any of the usual places."""
    paths = ("$.answer", "$.choices[0].message.content", "$.choices[0].text", "$.output.text", "$.output.choices[0].message.content")
    return F.coalesce(*(F.get_json_object(payload, p) for p in paths))


def answer_prompt(question: Column, context: Column, allowed: Column) -> Column:
    """A prompt that binds the answer to the context and the allowed reference numbers."""
    numbers = F.array_join(F.transform(allowed, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ", ")
    return F.concat_ws(
        "\n",
        F.lit("Answer from the context alone and cite a reference number for every statement."),
        F.concat(F.lit("References you may cite: "), F.when(numbers == "", "none").otherwise(numbers)),
        F.concat(F.lit("Question: "), question),
        F.concat(F.lit("Context:\n"), context),
    )
