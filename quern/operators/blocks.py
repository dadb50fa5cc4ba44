"""Blocks of documents: parsing plain text, layout noise, headings, neighbours, types.

Everything that looks along a document is a window over (document, page,
reading order); everything that looks at all of a document is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import WS, block_id, line_shape, squash, strip, words

ORDER = ("page_number", "reading_order", "block_id")
NOISE = ("header", "footer", "page_number")
#: What a block has to look like to count as layout noise.
PAGE_NUMBER = r"(?i)^(?:(?:第\s*)?\d{1,4}\s*(?:页)?|page\s+\d{1,4}|[—–\-]\s*\d{1,4}\s*[—–\-])$"
DOT_LEADER = r"(?s)^[^\n]*\.{4,}\s*\d{1,4}$"
HEADER_HINT = r"(?i)confidential|draft|copyright|版权所有|保密|内部资料"
POLICY_HEADER = r"(?:保险股份有限公司\s*)?个人保险基本条款第[零一二三四五六七八九十\d]+版$|^[^。！？；：]{4,80}(?:寿险|保险|险)\S*利益条款$"
LEGAL_TITLE = r"^第[零一二三四五六七八九十百千万\d]+[条款章节]"
#: Parser labels and the block types they stand for.
BLOCK_TYPES = {
    "text": "paragraph", "paragraph": "paragraph", "title": "title", "heading": "heading", "section_header": "heading", "list": "list_item", "list_item": "list_item",
    "table": "table", "image": "figure", "figure": "figure", "picture": "figure", "caption": "caption", "page_header": "header", "page_footer": "footer", "page_number": "page_number",
}
#: Words by which a document's type is known, in order of precedence.
TYPE_WORDS = (
    ("contract_terms", ("保险", "合同", "责任免除", "释义", "条款", "policy", "insured", "premium", "exclusion")),
    ("paper", ("abstract", "references", "introduction", "methodology", "doi", "keywords")),
    ("book", ("chapter ", "contents", "table of contents", "preface", "appendix", "目录")),
    ("laws", ("中华人民共和国", "第一条", "第二条", "条例", "办法", "regulation", "article 1", "article 2")),
    ("manual", ("troubleshooting", "maintenance", "installation", "warning", "caution", "procedure")),
    ("qa", ("question:", "answer:", "q:", "a:", "faq", "问：", "答：")),
)
TEMPLATES = ("contract_terms", "paper", "book", "manual", "laws", "table_data", "picture_pdf", "qa", "generic_structured")


def block_type(c: Column) -> Column:
    """The block type of a parser's label; unknown labels are paragraphs."""
    table = F.create_map(*(F.lit(x) for pair in BLOCK_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(c)), F.lit("paragraph"))


def deliver_once(blocks: DataFrame) -> DataFrame:
    """Blocks delivered twice are one block."""
    return blocks.dropDuplicates(["document_id", "block_id"])


def text_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, reading_order, block_type, text, heading, block_id of the parts of plain or Markdown texts.

    Parts lie between blank lines; a text of one part is cut into lines. A
    Markdown heading, or a first line that is a customary heading, heads what
    follows. Null and blank texts give no rows.
    """
    t = F.regexp_replace(F.regexp_replace(F.col(text), r"^\x{feff}", ""), r"\r\n|\r", "\n")
    full = F.filter(F.transform(F.split(t, rf"\n{WS}*\n"), strip), lambda x: x != "")
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != "")
    parts = docs.select(F.col(key), F.posexplode(F.when(F.size(full) > 1, full).otherwise(lines)).alias("reading_order", "part"))
    mark = r"^#{1,6}[ \t]+([^\n]+)$"
    first = F.substring_index("part", "\n", 1)
    plain = (F.length(first) <= 80) & (F.lower(strip(first)).isin("abstract", "references", "contents", "faq") | F.lower(first).rlike("^(?:chapter|section|part|appendix) "))
    kind = F.when(F.col("part").rlike(mark) | plain, "heading").when(F.col("part").rlike(r"^(?:[-*+]\s+|\d+[.)]\s+|[①②③④⑤⑥⑦⑧⑨⑩])"), "list_item").otherwise("paragraph")
    own = F.when(F.col("part").rlike(mark), strip(F.regexp_extract("part", mark, 1))).otherwise(F.col("part"))
    title = F.when(kind == "heading", strip(F.substring_index(own, "\n", 1)))
    so_far = Window.partitionBy(key).orderBy("reading_order").rowsBetween(Window.unboundedPreceding, 0)
    out = parts.select(key, "reading_order", kind.alias("block_type"), own.alias("text"), title.alias("_title"))
    out = out.withColumn("heading", F.last("_title", ignorenulls=True).over(so_far)).drop("_title")
    return out.withColumn("block_id", block_id(F.col(key).cast("string"), F.lit(1), F.col("reading_order"), F.col("block_type")))


def at_edge() -> Column:
    middle = (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    return F.coalesce((middle <= 90) | (middle >= 700), F.lit(False))


def _running(text: Column) -> Column:
    looks = (F.col("page_number") > 1) & (text != "") & (F.length(text) <= 120) & ~text.rlike(LEGAL_TITLE) & text.rlike(POLICY_HEADER)
    return looks & (F.col("bbox.y0").isNull() | at_edge())


def repeated_edge_texts(blocks: DataFrame) -> DataFrame:
    """document_id, shape, pages: short texts at page edges, or like running headers, that stand on two pages or more."""
    text = strip(F.col("text"))
    shape = F.lower(squash(F.col("text")))
    short = blocks.where((shape != "") & (F.length(shape) <= 120) & (at_edge() | shape.rlike(HEADER_HINT) | _running(text)))
    return short.groupBy("document_id", shape.alias("shape")).agg(F.countDistinct("page_number").cast("int").alias("pages")).where("pages >= 2")


def layout_noise(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``noise``: why a block is no content, null for content."""
    text = strip(F.coalesce("text", F.lit("")))
    repeated = repeated_edge_texts(blocks).select("document_id", F.col("shape").alias("_shape"), F.lit(True).alias("_again"))
    marked = blocks.withColumn("_shape", F.lower(squash(F.coalesce("text", F.lit(""))))).join(repeated, ["document_id", "_shape"], "left")
    reason = (
        F.when(text == "", "empty")
        .when(F.col("block_type").isin(*NOISE), "type")
        .when(text.rlike(PAGE_NUMBER) & (F.length(text) <= 20), "page_number")
        .when(text.rlike(DOT_LEADER) & (F.length(text) <= 160), "toc_dot_leader")
        .when(_running(text), "running_header_pattern")
        .when(F.col("_again"), "repeated_page_edge")
    )
    return marked.withColumn("noise", reason).drop("_shape", "_again")


def header_footer_lines(blocks: DataFrame, share: float = 0.5, edge: int = 3, least_pages: int = 3) -> DataFrame:
    """document_id, shape, pages: lines, digits apart, among the first or last ``edge`` of at least ``share`` of a document's pages."""
    lines = blocks.where(F.length("text") > 0).select("document_id", "page_number", "reading_order", "block_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("n", "line"))
    lines = lines.withColumn("shape", line_shape(F.col("line"))).where("shape <> ''")
    down = Window.partitionBy("document_id", "page_number").orderBy("reading_order", "block_id", "n")
    up = Window.partitionBy("document_id", "page_number").orderBy(F.desc("reading_order"), F.desc("block_id"), F.desc("n"))
    edges = lines.withColumn("_a", F.row_number().over(down)).withColumn("_b", F.row_number().over(up)).where((F.col("_a") <= edge) | (F.col("_b") <= edge))
    total = blocks.groupBy("document_id").agg(F.countDistinct("page_number").alias("_pages")).where(F.col("_pages") >= least_pages)
    return (
        edges.groupBy("document_id", "shape")
        .agg(F.countDistinct("page_number").cast("int").alias("pages"))
        .join(total, "document_id")
        .where(F.col("pages") >= F.greatest(F.floor(F.col("_pages") * share), F.lit(1)))
        .select("document_id", "shape", "pages")
    )


def document_types(blocks: DataFrame, sample: int = 12_000, media: float = 0.35) -> DataFrame:
    """document_id, detected, confidence: by the share of tables or figures, else by the first group of words that occurs.

    Of a document the blocks count that begin within its first ``sample``
    characters, which bounds what is put together.
    """
    before = Window.partitionBy("document_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    text = F.coalesce("text", F.lit(""))
    head = blocks.withColumn("_before", F.coalesce(F.sum(F.length(text)).over(before), F.lit(0)))
    some = F.when((F.col("_before") < sample) & (text != ""), F.struct(*ORDER, F.lower(text).alias("t")))
    stats = head.groupBy("document_id").agg(
        F.avg((F.col("block_type") == "table").cast("double")).alias("tables"),
        F.avg((F.col("block_type") == "figure").cast("double")).alias("figures"),
        F.array_join(F.transform(F.array_sort(F.collect_list(some)), lambda x: x["t"]), "\n").alias("s"),
    )
    kind = F.when(F.col("tables") > media, "table_data").when(F.col("figures") > media, "picture_pdf")
    sure = F.when(F.col("tables") > media, F.least(F.lit(0.95), "tables")).when(F.col("figures") > media, F.least(F.lit(0.95), "figures"))
    for name, needles in TYPE_WORDS:
        found = sum(((F.contains("s", F.lit(w))).cast("int") for w in needles), F.lit(0))
        kind, sure = kind.when(found > 0, name), sure.when(found > 0, F.least(F.lit(0.9), F.lit(0.55) + F.lit(0.1) * found))
    return stats.select("document_id", kind.otherwise("generic_structured").alias("detected"), F.round(sure.otherwise(0.3), 4).alias("confidence"))


def heading_level(title: Column) -> Column:
    """1 to 6, from a dotted number, a Chinese mark or a customary word; 1 if nothing tells."""
    number = F.regexp_extract(title, r"^\s*(\d+(?:\.\d+){0,5})\s+\S+", 1)
    mark = F.regexp_extract(title, r"^\s*第\s*(?:[零一二三四五六七八九十百千万\d]\s*)+([章节目篇卷条款])", 1)
    return (
        F.when(number != "", F.least(F.lit(6), F.regexp_count(number, F.lit(r"\.")) + 1))
        .when(mark.isin("章", "篇", "卷"), 1)
        .when(mark.isin("节", "目", "条"), 2)
        .when(mark != "", 3)
        .when(F.lower(title).rlike("^(?:chapter |part |appendix)"), 1)
        .when(F.lower(title).startswith("section "), 2)
        .otherwise(1)
        .cast("int")
    )


def heading_carry(blocks: DataFrame) -> DataFrame:
    """``blocks`` with section_title and section_level: the nearest heading at or before a block."""
    line = strip(F.regexp_extract(F.coalesce("text", F.lit("")), rf"^{WS}*([^\n\r]*)", 1))
    ends = line.rlike("[。！？…；.!?]$")
    structured = line.rlike(r"(?i)^\s*(?:\d+(?:\.\d+){0,4}\s+\S+|chapter\s+\d+\b|section\s+\d+\b|part\s+\d+\b|appendix\b|第\s*(?:[零一二三四五六七八九十百千万\d]\s*)+[章节目篇卷])")
    legal = line.rlike(r"^第\s*(?:[零一二三四五六七八九十百千万\d]\s*)+[条款章节]{1,2}(?:\s|$)") & (F.length(line) <= 40)
    barred = (line == "") | line.rlike("^[，、；：…—]") | line.rlike(r"^\d{4}\s*[年/\-.]\s*\d{1,2}") | (F.length(line) > 80)
    given = F.col("block_type").isin("heading", "title") & (structured | (~ends & (F.length(line) <= 30)))
    inferred = F.col("block_type").isin("paragraph", "text") & ~ends & (legal | structured)
    is_heading = ~barred & (given | inferred)
    so_far = Window.partitionBy("document_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(is_heading, line), ignorenulls=True).over(so_far)
    return blocks.withColumn("section_title", title).withColumn("section_level", F.when(F.col("section_title").isNotNull(), heading_level(F.col("section_title"))))


def neighbour_context(blocks: DataFrame, n: int = 2, media: tuple[str, ...] = ("table", "figure", "caption")) -> DataFrame:
    """document_id, block_id, before, after of media blocks: the texts of ``n`` content blocks on either side in the same run of a section."""
    near = neighbour_texts(blocks, n, media)
    return near.select("document_id", "block_id", *(F.array_join(c, "\n\n").alias(c) for c in ("before", "after")))


def media_context(chunks: DataFrame, blocks: DataFrame, configs: DataFrame, default: str = "generic_structured") -> DataFrame:
    """document_id, chunk_id, context_before, context_after of chunks of tables, figures and captions.

    As many content blocks on either side as the template says for tables
    (``table_context_blocks``) and for the rest (``image_context_blocks``);
    captions of the block come first. Null where there is nothing.
    """
    from .validate import captions

    sizes = configs.groupBy("template").agg(F.min("table_context_blocks").alias("_t"), F.min("image_context_blocks").alias("_i"))
    most = configs.agg(F.greatest(F.max("table_context_blocks"), F.max("image_context_blocks"))).first()[0] or 0
    other = sizes.where(F.col("template") == default).first()  # one row
    near = neighbour_texts(blocks, max(1, most))
    titles = captions(blocks, ("table", "figure", "caption")).select("document_id", "block_id", F.col("caption").alias("_caption"))
    media = chunks.where(F.col("chunk_type").isin("table", "figure", "caption")).select("document_id", "chunk_id", "template", "chunk_type", F.col("block_ids")[0].alias("block_id")).join(sizes, "template", "left")
    n = F.when(F.col("chunk_type") == "table", F.coalesce("_t", F.lit(other["_t"] if other else 0))).otherwise(F.coalesce("_i", F.lit(other["_i"] if other else 0)))
    joined = media.join(near, ["document_id", "block_id"], "left").join(titles, ["document_id", "block_id"], "left")
    nothing = F.array().cast("array<string>")
    before = F.when(n > 0, F.slice("before", F.greatest(F.lit(1), F.size("before") - n + 1), F.greatest(n, F.lit(1)))).otherwise(nothing)
    after = F.when(n > 0, F.slice("after", F.lit(1), F.greatest(n, F.lit(1)))).otherwise(nothing)
    first = F.when(F.coalesce("_caption", F.lit("")) != "", F.array("_caption")).otherwise(nothing)
    parts = {"context_before": F.concat(first, F.coalesce(before, nothing)), "context_after": F.coalesce(after, nothing)}
    return joined.select("document_id", "chunk_id", *(F.when(F.size(c) > 0, F.array_join(c, "\n\n")).alias(name) for name, c in parts.items()))


def neighbour_texts(blocks: DataFrame, n: int = 2, media: tuple[str, ...] = ("table", "figure", "caption")) -> DataFrame:
    """document_id, block_id, before, after of media blocks as arrays, in reading order; see neighbour_context."""
    order = Window.partitionBy("document_id").orderBy(*ORDER)
    turn = F.coalesce((~F.col("section_id").eqNullSafe(F.lag("section_id").over(order))).cast("int"), F.lit(0))
    runs = blocks.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = strip(F.coalesce("text", F.lit("")))
    content = ~F.col("block_type").isin(*NOISE, "table", "figure") & (text != "")
    # content blocks of a run are numbered; a media block knows how many precede it
    runs = runs.withColumn("_c", content).withColumn("_text", text)
    upto = Window.partitionBy("document_id", "_run").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("_no", F.sum(F.col("_c").cast("int")).over(upto))
    source = runs.where(F.col("block_type").isin(*media)).select("document_id", "block_id", "_run", F.col("_no").alias("_at"), F.col("_c").alias("_self"))
    near = source.select("document_id", "_run", "block_id", "_at", "_self", F.explode(F.sequence(F.col("_at") - n, F.col("_at") + n)).alias("_no"))
    near = near.where((F.col("_no") > 0) & ~(F.col("_self") & (F.col("_no") == F.col("_at"))))
    texts = runs.where("_c").select("document_id", "_run", "_no", "_text")
    joined = near.join(texts, ["document_id", "_run", "_no"])
    earlier = F.when(F.col("_self"), F.col("_no") < F.col("_at")).otherwise(F.col("_no") <= F.col("_at"))

    def side(keep: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("_no", "_text")))), lambda x: x["_text"])

    shift = F.when(F.col("_self"), 1).otherwise(0)
    found = joined.groupBy("document_id", "block_id").agg(side(earlier & (F.col("_no") > F.col("_at") - n - shift)).alias("before"), side(~earlier & (F.col("_no") <= F.col("_at") + n)).alias("after"))
    return source.select("document_id", "block_id").join(found, ["document_id", "block_id"], "left").select("document_id", "block_id", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("before", "after")))


def order_violations(blocks: DataFrame) -> DataFrame:
    """document_id, page_number, block_id of blocks that stand, in delivered reading order, on an earlier page than the block before."""
    order = Window.partitionBy("document_id").orderBy("reading_order", "block_id")
    return blocks.withColumn("_p", F.lag("page_number").over(order)).where(F.col("_p") > F.col("page_number")).select("document_id", "page_number", "block_id")


def question_pairs(blocks: DataFrame) -> DataFrame:
    """document_id, pair, question, answer: a pair starts at each question mark of a question-and-answer text."""
    q, a = r"(?i)^\s*(?:q(?:uestion)?\s*[:：]|问[:：]|问题[:：])", r"(?i)^\s*(?:a(?:nswer)?\s*[:：]|答[:：]|答案[:：])"
    text = strip(F.coalesce("text", F.lit("")))
    rows = blocks.where(text != "").withColumn("_t", text).withColumn("_q", text.rlike(q))
    so_far = Window.partitionBy("document_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("pair", F.sum(F.col("_q").cast("int")).over(so_far).cast("int")).where("pair > 0 and (_q or block_type <> 'heading')")
    answers = F.transform(F.array_sort(F.collect_list(F.when(~F.col("_q"), F.struct(*ORDER, F.regexp_replace("_t", a, "").alias("t"))))), lambda x: strip(x["t"]))
    return rows.groupBy("document_id", "pair").agg(
        F.max(F.when(F.col("_q"), strip(F.regexp_replace(F.regexp_extract("_t", r"^[^\n\r]*", 0), q, "")))).alias("question"), F.array_join(answers, "\n\n").alias("answer")
    )


def page_texts(blocks: DataFrame) -> DataFrame:
    """document_id, page_number, n, words of the content of each page."""
    content = blocks.where(~F.col("block_type").isin(*NOISE) & (strip(F.coalesce("text", F.lit(""))) != ""))
    return content.groupBy("document_id", "page_number").agg(F.count("*").cast("int").alias("n"), F.sum(F.size(words(F.col("text")))).cast("bigint").alias("words"))
