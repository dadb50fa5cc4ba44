"""Rows that break a rule of parsed documents, chunks or vectors, as (rule, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.layout import box_in_page, vertical_overlap
from quern.functions.text import section_id

#: Names that a vector's metadata may have.
METADATA = frozenset(
    "tenant_id knowledge_base_id document_id chunk_id chunk_key parent_id parent_key doc_type chunk_type template access_level department heading_path page_start page_end source_uri version embedding_model embedding_provider embedding_dim status".split()
)


def rule(rows: DataFrame, name: str, key: Column, where: Column | None = None) -> DataFrame:
    rows = rows.where(where) if where is not None else rows
    return rows.select(F.lit(name).alias("rule"), key.cast("string").alias("key"))


def section_tree(blocks: DataFrame) -> DataFrame:
    """document_id, section_id, parent_section_id, title, level, page_start, page_end of every prefix of a heading path."""
    path = F.filter(F.transform(F.coalesce("heading_path", F.array().cast("array<string>")), F.trim), lambda x: x != "")
    path = F.when(F.size(path) > 0, F.array_distinct(path)).otherwise(F.array(F.lit("Document")))
    steps = blocks.select("document_id", "page_number", path.alias("p")).select("document_id", "page_number", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.slice("p", 1, n))).alias("p"))
    nodes = steps.groupBy("document_id", "p").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))
    doc = F.col("document_id")
    return nodes.select(
        "document_id",
        section_id(doc, F.col("p")).alias("section_id"),
        F.when(F.size("p") > 1, section_id(doc, F.slice("p", 1, F.size("p") - 1))).alias("parent_section_id"),
        F.element_at("p", -1).alias("title"),
        F.size("p").alias("level"),
        "page_start",
        "page_end",
    )


def document_faults(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Blocks with a used id, a page below 1, an empty box, a box off its page; pages whose order runs back.

    ``pages``: document_id, page_number, width, height, where sizes are known.
    """
    key = F.col("block_id")
    twice = blocks.groupBy("document_id", "block_id").agg(F.count("*").alias("n")).where("n > 1")
    box = F.col("bbox")
    out = [
        rule(twice, "duplicate_block", key),
        rule(blocks, "page_number", key, F.coalesce(F.col("page_number") <= 0, F.lit(True))),
        rule(blocks, "empty_box", key, (box["x0"] == box["x1"]) | (box["y0"] == box["y1"])),
    ]
    if pages is not None:
        sized = blocks.join(pages, ["document_id", "page_number"], "left")
        out += [rule(sized, "off_page", key, box.isNotNull() & ~box_in_page(box, F.col("width"), F.col("height")))]
    return reduce(DataFrame.unionByName, out)


def chunk_faults(chunks: DataFrame, parents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chunks (document_id, parent_id, chunk_id, chunk_type, page_start, page_end, block_ids) with a used id, no parent,
    no block, a bad page span; parents without a chunk; media blocks inside chunks of text."""
    key = F.col("chunk_id")
    twice = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1")
    used = chunks.select("document_id", "chunk_type", F.explode("block_ids").alias("block_id"))
    media = blocks.where(F.col("block_type").isin("table", "figure")).select("document_id", "block_id").distinct()
    inside = used.where(~F.col("chunk_type").isin("table", "figure", "caption", "image_context")).join(media, ["document_id", "block_id"], "left_semi").select("block_id").distinct()
    return reduce(
        DataFrame.unionByName,
        [
            rule(twice, "duplicate_chunk", key),
            rule(chunks.join(parents.select("parent_id").distinct(), "parent_id", "left_anti"), "missing_parent", key),
            rule(parents.select("parent_id").distinct().join(chunks.select("parent_id").distinct(), "parent_id", "left_anti"), "missing_child", F.col("parent_id")),
            rule(chunks, "no_block", key, F.size("block_ids") < 1),
            rule(chunks, "page_span", key, (F.col("page_start") <= 0) | (F.col("page_end") < F.col("page_start"))),
            rule(inside, "swallowed_media", F.col("block_id")),
        ],
    )


def vector_faults(vectors: DataFrame, dims: dict[str, int]) -> DataFrame:
    """Vectors of an unknown model, of another length than stated or registered, or with an element that isn't finite."""
    key, e = F.col("chunk_id"), F.col("embedding")
    known = F.create_map(*(F.lit(x) for pair in dims.items() for x in pair)) if dims else F.create_map().cast("map<string,int>")
    dim = F.try_element_at(known, F.col("embedding_model"))
    return reduce(
        DataFrame.unionByName,
        [
            rule(vectors, "unknown_model", key, dim.isNull()),
            rule(vectors, "stated_dim", key, F.coalesce(F.col("embedding_dim") != dim, F.lit(False))),
            rule(vectors, "length", key, F.coalesce(F.size(e) != F.col("embedding_dim"), F.lit(True)) | e.isNull()),
            rule(vectors, "not_finite", key, F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))),
        ],
    )


def strange_metadata(metadata: Column) -> Column:
    """Names in a metadata map that are not allowed."""
    return F.array_except(F.map_keys(metadata), F.array(*(F.lit(x) for x in sorted(METADATA))))


def unknown_paths(blocks: DataFrame, tree: DataFrame) -> DataFrame:
    """Blocks whose heading path is no section of ``tree`` (document_id, section_id)."""
    some = blocks.where(F.size("heading_path") > 0).withColumn("section_id", section_id(F.col("document_id"), F.col("heading_path")))
    return rule(some.join(tree.select("document_id", "section_id").distinct(), ["document_id", "section_id"], "left_anti"), "unknown_path", F.col("block_id"))


def top_sections(blocks: DataFrame) -> DataFrame:
    """document_id, block_id, section: the first level of a block's heading path, "Document" without one."""
    return blocks.select("document_id", "block_id", F.coalesce(F.get("heading_path", F.lit(0)), F.lit("Document")).alias("section"))


def shapeless_metadata(rows: DataFrame, metadata: str = "metadata") -> DataFrame:
    """rows: how many rows have metadata that is no JSON object; null counts as none."""
    kind = F.schema_of_variant(F.try_parse_json(metadata))
    return rows.agg(F.count_if(F.col(metadata).isNotNull() & ~F.coalesce(kind.startswith("OBJECT"), F.lit(False))).alias("rows"))


def captions(blocks: DataFrame, media: tuple[str, ...] = ("table", "figure")) -> DataFrame:
    """document_id, block_id, caption of media blocks: their own and that of a caption block right before or after on the page."""
    order = Window.partitionBy("document_id", "page_number").orderBy("reading_order", "block_id")
    text = F.trim(F.coalesce("text", F.lit("")))
    near = [F.when(f("block_type", 1).over(order) == "caption", f(text, 1).over(order)) for f in (F.lag, F.lead)]
    rows = blocks.withColumn("_c", F.concat_ws("\n\n", F.when(F.trim("caption") != "", F.trim("caption")), *near))
    return rows.where(F.col("block_type").isin(*media)).select("document_id", "block_id", F.col("_c").alias("caption"))


def font_levels(blocks: DataFrame, size: str) -> DataFrame:
    """document_id, size, level: the six largest sizes of a document are heading levels 1 to 6."""
    sizes = blocks.where(F.col(size).isNotNull()).select("document_id", size).distinct()
    return sizes.withColumn("level", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc(size)))).where("level <= 6")


def split_markers(blocks: DataFrame) -> DataFrame:
    """marker_id, body_id: an article label that a parser set apart from the body it stands beside.

    The two overlap in height on one page; the body is much wider, or comes
    before and does not end. The best overlap wins, then the nearest.
    """
    label = r"^\s*第\s*(?:[一二三四五六七八九十百千万零〇两0-9]\s*)+条\s*\S"
    rows = blocks.where(F.col("bbox").isNotNull() & (F.length("text") > 0)).select("document_id", "page_number", "block_id", "reading_order", "block_type", "bbox", F.col("text").rlike(label).alias("_m"), F.regexp_extract("text", r"^\s*([^\n\r]*)", 1).alias("_l"))
    m = rows.where("_m").alias("m")
    b = rows.where(~F.col("_m") & ~F.col("block_type").isin("table", "figure", "caption", "heading", "title")).alias("b")
    share = vertical_overlap(F.col("m.bbox"), F.col("b.bbox"))
    wide = (F.col("b.bbox.x1") - F.col("b.bbox.x0")) > 1.8 * (F.col("m.bbox.x1") - F.col("m.bbox.x0"))
    unfinished = (F.col("b.reading_order") < F.col("m.reading_order")) & ~F.col("b._l").rlike("[。！？；.!?]$")
    joined = m.join(b, (F.col("m.document_id") == F.col("b.document_id")) & (F.col("m.page_number") == F.col("b.page_number"))).where((share > 0) & (wide | unfinished))
    score = F.struct((share * 100 - F.abs(F.col("m.reading_order") - F.col("b.reading_order"))).alias("s"), (-F.col("b.reading_order")).alias("o"), F.col("b.block_id").alias("id"))
    best = joined.groupBy(F.col("m.document_id").alias("document_id"), F.col("m.block_id").alias("marker_id")).agg(F.max(score)["id"].alias("body_id"))
    return best.groupBy("document_id", "body_id").agg(F.min("marker_id").alias("marker_id")).select("document_id", "marker_id", "body_id")


def article_parts(chunks: DataFrame, article: str) -> DataFrame:
    """``chunks`` with part and parts for articles that take several chunks; null for the rest."""
    one = Window.partitionBy("document_id", article)
    parts = F.count("*").over(one)
    part = F.row_number().over(one.orderBy("parent_id", "chunk_index"))
    many = F.col(article).isNotNull() & (parts > 1)
    return chunks.withColumn("part", F.when(many, part)).withColumn("parts", F.when(many, parts))


def page_offsets(pages: DataFrame, text: str) -> DataFrame:
    """document_id, page_number, start, stop of each page in the document's joined text: a blank line follows a page that ends a sentence."""
    order = Window.partitionBy("document_id").orderBy("page_number")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = pages.withColumn("_t", t).withColumn("_gap", F.when(F.lag("_t").over(order).rlike(r"[。！？；.!?;）)」』\"]\s*$") & (t != ""), 2).otherwise(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", (F.coalesce(F.sum(F.length("_t") + F.col("_gap")).over(before), F.lit(0)) + F.col("_gap")).cast("bigint"))
    return rows.select("document_id", "page_number", "start", (F.col("start") + F.length("_t")).alias("stop"))


def without_running_lines(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """``blocks`` whose text has lost the lines of ``lines`` (document_id, shape)."""
    from quern.functions.text import line_shape

    shapes = lines.groupBy("document_id").agg(F.collect_set("shape").alias("_shapes"))  # a few lines a document
    parts = F.split("text", r"\r\n|\n|\r")
    kept = F.array_join(F.filter(parts, lambda x: ~F.coalesce(F.array_contains("_shapes", line_shape(x)), F.lit(False))), "\n")
    return blocks.join(shapes, "document_id", "left").withColumn("text", kept).drop("_shapes")
