"""Cutting documents into parent and child chunks.

Documents are order-dependent, so blocks are brought together by document and
sorted, and each task then streams through them with the open group and the
open child as its only state: a document of any size is never held as a whole.
A template is a few decisions about a block, kept in ``Rules``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.session import ship_package

MEDIA = frozenset({"table", "figure", "caption"})
SKIP = frozenset({"header", "footer", "page_number"})
#: Fixed value: the numerals of Chinese headings.
_NUM = "一二三四五六七八九十百千万零〇两0-9"
#: How templates know their headings, articles, items, questions.
PATTERNS = {
    "chapter": rf"^\s*(?:第\s*(?:[{_NUM}]\s*)+[章编部篇卷]|chapter\s+\d+|part\s+\d+)",
    "article": rf"^\s*(?:第\s*(?:[{_NUM}]\s*)+条|article\s+\d+)",
    "number": r"^\s*\d+(?:\.\d+){0,2}\s+\S+",
    "clause": rf"^\s*(?:[（(][{_NUM}a-zA-Z]+[）)]|[①②③④⑤⑥⑦⑧⑨⑩]|\d+[.)、])",
    "law_part": rf"^\s*(?:第[\p{{Han}}{_NUM}]+[章节编]|chapter\s+\d+|section\s+\d+)",
    "book_part": r"^\s*(?:chapter\s+\d+|book\s+\d+|part\s+\d+|第.+[章节卷篇])",
    "contents": r"^\s*(?:contents|table of contents|目录|index|索引)\s*$",
    "paper_part": r"^\s*(?:\d+(?:\.\d+)*\s+)?(?:abstract|introduction|background|methods?|methodology|results?|discussion|conclusion|references|appendix)\b",
    "step": r"^\s*(?:step\s+\d+|\d+[.)]\s+)",
    "callout": r"^\s*(?:warning|caution|note|danger|important)\b",
    "trouble": r"troubleshoot|fault|symptom|cause|remedy|maintenance|installation",
    "question": r"^\s*(?:q(?:uestion)?\s*[:：]|问[:：]|问题[:：])",
    "sentence_end": r"[。！？；.!?]$",
    "orphan": r"^[，、；：…）)]",
    "junk": r"^第\s*\d+\s*页\s*$|^page\s+\d+\s*$|^\d{4,6}\s*$|.*\[\d{4}\].*号\s*$|.*基本条款第[一二三四五六七八九十百千万\d]+版\s*$",
}
_RE = {k: regex.compile(p, regex.I) for k, p in PATTERNS.items()}
_CJK, _LATIN = regex.compile("[一-鿿㐀-䶿豈-﫿\U00020000-\U0002a6df]"), regex.compile(T.WORD)


def is_(kind: str, s: str) -> bool:
    return _RE[kind].match(s) is not None


def counts(text: str) -> tuple[int, int]:
    return len(_CJK.findall(text)), len(_LATIN.findall(text))


def tokens(cjk: int, latin: int) -> int:
    return cjk + int(latin * 1.3)


@dataclass
class Block:
    id: str
    page: int
    kind: str
    text: str
    path: list[str]
    meta: dict = field(default_factory=dict)
    top: float | None = None
    bottom: float | None = None

    @property
    def first(self) -> str:
        return next((x.strip() for x in self.text.splitlines() if x.strip()), "")


@dataclass
class Rules:
    """A template: the group a block starts (or None), the child it must go to, and when a child may not grow."""

    start: str
    group: Callable[[Block, str], str | None]
    kind: str
    opens: Callable[[Block], bool] = lambda b: False
    alone: Callable[[Block], str | None] = lambda b: None
    glued: Callable[[Block], bool] = lambda b: False
    lane: Callable[[Block], str] = lambda b: ""
    limited: Callable[[str], bool] = lambda group: True
    skip: Callable[[Block], bool] = lambda b: False
    media_kind: Callable[[Block], str] = lambda b: b.kind
    adopt: bool = True  # the starting group takes the name of the first heading path


def _section_title(s: str) -> bool:
    return bool(s) and not (is_("clause", s) or _RE["sentence_end"].search(s) or is_("orphan", s) or len(s) > 30)


def _contract_group(b: Block, now: str) -> str | None:
    f = b.first
    if _section_title(f) and (is_("chapter", f) or b.kind == "heading" and not is_("article", f)):
        return f
    return None


def _heading(b: Block, now: str) -> str | None:
    return b.first or None if b.kind == "heading" else None


def _article(b: Block) -> bool:
    return is_("article", b.first) or b.kind == "heading" and is_("number", b.first)


RULES: dict[str, Rules] = {
    "generic_structured": Rules("Document", lambda b, now: None, "text"),  # by heading path, see Stream
    "contract_terms": Rules("Document", _contract_group, "contract_clause", opens=_article, glued=lambda b: b.kind == "list_item" or is_("clause", b.first), skip=lambda b: len(b.text) <= 120 and is_("junk", b.text.strip()), adopt=False),
    "laws": Rules("Document", lambda b, now: b.first if is_("law_part", b.first) and not is_("article", b.first) else None, "legal_article", opens=lambda b: is_("article", b.first), glued=lambda b: b.kind == "list_item" or is_("clause", b.first)),
    "book": Rules("Front Matter", lambda b, now: b.first if is_("book_part", b.first) or b.kind == "heading" and b.first.lower().startswith(("preface", "appendix", "chapter", "part ")) else None, "book_section", opens=lambda b: b.kind == "heading", skip=lambda b: is_("contents", b.first)),
    "paper": Rules("Front Matter", lambda b, now: b.first if b.first and (b.kind == "heading" or is_("paper_part", b.first)) else None, "paper_text", limited=lambda g: "abstract" not in g.lower() and "references" not in g.lower()),
    "manual": Rules("Manual", _heading, "manual_text", alone=lambda b: "manual_callout" if is_("callout", b.first) else None, lane=lambda b: "manual_procedure" if b.kind == "list_item" or is_("step", b.first) else "", media_kind=lambda b: "manual_troubleshooting_table" if b.kind == "table" and _RE["trouble"].search(b.text) else b.kind),
    "table_data": Rules("Table", lambda b, now: b.meta.get("sheet_name") or b.meta.get("table_name") or "Table", "table_row_group", adopt=False),
    "picture_pdf": Rules("Page", lambda b, now: f"Page {b.page}", "ocr_text", media_kind=lambda b: "image_context", adopt=False),
    "qa": Rules("QA", lambda b, now: b.first if b.kind == "heading" and b.first and not is_("question", b.first) else None, "qa_pair", opens=lambda b: is_("question", b.first), limited=lambda g: False, skip=lambda b: False),
}


#: How deep a heading path parts the parents of the plain template, by the setting of that name.
GRANULARITY = {"chapter": 1, "section": 2}
_ARTICLE = regex.compile(rf"^\s*(?P<label>第\s*(?:[{_NUM}]\s*)+条)\s*(?P<tail>.*)$")
_ENDS = "。；;:：，,"


def article_name(line: str) -> str:
    """第 1 条 合同构成 ... as 第1条 合同构成: the label without spaces and the first word or clause after it."""
    m = _ARTICLE.match(line)
    if m is None:
        return line.strip()
    label, tail = "".join(m["label"].split()), m["tail"].strip()
    if not tail:
        return label
    word = tail.split()[0].strip(_ENDS)
    clause = regex.split(f"[{_ENDS}]", tail)[0].strip()
    return f"{label} " + next((x for x in (word, clause) if 0 < len(x) <= 30), tail[:30].strip())


class Stream:
    """Children of one document after another, from blocks in order.

    ``depth``: levels of a heading path that make a parent of the plain
    template. ``articles``: a contract without chapters, whose articles are
    the parents.
    """

    def __init__(self, template: str, limit: int, depth: int = 1, articles: bool = False):
        self.name, self.rules, self.limit, self.depth, self.articles = template, RULES[template], limit, depth, articles
        self.seen: dict[str, int] = {}
        self.order: dict[str, int] = {}
        self.group, self.named = self.rules.start, not self.rules.adopt
        self.key, self.count = self.group, 0
        self.open: list[Block] = []
        self.lane = ""
        self.size = [0, 0]

    def next_group(self, b: Block) -> str | None:
        if self.name == "generic_structured":
            path = list(dict.fromkeys(x.strip() for x in b.path if x and x.strip()))[: self.depth]
            group = " > ".join(path)
            return group if group and group != self.group else None
        if self.articles:
            return article_name(b.first) if _article(b) else None
        return self.rules.group(b, self.group)

    @property
    def rule(self) -> str:
        if self.name != "contract_terms":
            return self.name
        return "contract_parent_chapter" if not self.articles else "contract_parent_article" if self.count else "contract_parent_preamble"

    def push(self, b: Block) -> Iterator[tuple]:
        r = self.rules
        if b.kind in SKIP or not b.text.strip() or r.skip(b):
            return
        group = self.next_group(b)
        if group is None and not self.named and b.path and self.name != "generic_structured":
            group = b.path[0]
        if group is not None and (group != self.group or self.articles):
            yield from self.flush()
            self.group, self.named = group, True
            self.count += 1
            self.key = f"article:{self.count}:{group}" if self.articles else group
        if self.name == "qa" and b.kind == "heading" and not is_("question", b.first):
            return
        if b.kind in MEDIA and self.name not in ("table_data", "qa"):
            yield from self.flush()
            yield self.child([b], r.media_kind(b))
            return
        alone = r.alone(b)
        if alone:
            yield from self.flush()
            yield self.child([b], alone)
            return
        lane = r.lane(b)
        if lane != self.lane or r.opens(b):
            yield from self.flush()
            self.lane = lane
        c, w = counts(b.text)
        if self.open and not lane and r.limited(self.group) and not r.glued(b) and tokens(self.size[0] + c, self.size[1] + w) > self.limit:
            yield from self.flush()
        self.open.append(b)
        self.size[0] += c
        self.size[1] += w

    def flush(self) -> Iterator[tuple]:
        if self.open:
            headings_only = self.name == "contract_terms" and all(b.kind in ("heading", "title") and len([x for x in b.text.splitlines() if x.strip()]) < 2 for b in self.open)
            if not headings_only:
                kind = self.lane or ("list" if self.name == "generic_structured" and all(b.kind == "list_item" for b in self.open) else self.rules.kind)
                low = self.group.lower()
                if self.name == "paper" and ("abstract" in low or "references" in low):
                    kind = "paper_abstract" if "abstract" in low else "paper_references"
                yield self.child(self.open, kind)
        self.open, self.size, self.lane = [], [0, 0], ""

    def child(self, blocks: list[Block], kind: str) -> tuple:
        index = self.seen.get(self.key, 0)
        self.seen[self.key] = index + 1
        order = self.order.setdefault(self.key, len(self.order))
        body = "\n\n".join(b.text.strip() for b in blocks)
        text = body if not self.group or body.startswith(self.group) else f"{self.group}\n\n{body}"
        pages = [b.page for b in blocks]
        return (self.key, self.group, self.rule, order, index, kind, text, min(pages), max(pages), [b.id for b in blocks], tokens(*counts(text)), blocks[0].top, blocks[-1].bottom)


_OUT = "document_id string, template string, section string, heading string, rule string, parent_index int, chunk_index int, chunk_type string, text string, page_start int, page_end int, block_ids array<string>, token_count int, top double, bottom double"
_TYPES = [*[pa.string()] * 5, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.float64(), pa.float64()]


def chapterless(blocks: DataFrame) -> DataFrame:
    """document_id of documents whose blocks give one parent by chapters at most, but three articles or more."""

    def look(batches):
        for batch in batches:
            start, article = [], []
            for kind, text in zip(batch.column("block_type").to_pylist(), batch.column("text").to_pylist(), strict=True):
                b = Block("", 0, kind or "paragraph", text, [])
                start.append(_contract_group(b, ""))
                article.append(_article(b))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("document_id", "page_number", "reading_order", "block_id")), pa.array(start, pa.string()), pa.array(article, pa.bool_())], ["document_id", "page_number", "reading_order", "block_id", "start", "article"])

    content = blocks.where((F.length("text") > 0) & ~F.coalesce(F.col("block_type").isin(*SKIP), F.lit(False)))
    seen = content.select("document_id", "page_number", "reading_order", "block_id", "block_type", "text").mapInArrow(look, "document_id string, page_number int, reading_order int, block_id string, start string, article boolean")
    facts = seen.groupBy("document_id").agg(F.countDistinct("start").alias("chapters"), F.countDistinct(F.when(F.col("article"), F.col("block_id"))).alias("articles"), F.min_by(F.col("start").isNull(), F.struct("page_number", "reading_order", "block_id")).alias("preamble"))
    return facts.where("articles >= 3 and chapters + int(preamble) <= 1").select("document_id")


def chunk_blocks(blocks: DataFrame, templates: DataFrame, configs: DataFrame, default: str = "generic_structured") -> DataFrame:
    """Child chunks of all documents: document_id, template, section, chunk_index, ... and their content-derived ids.

    ``templates``: document_id, template; documents and templates that are not
    known take ``default``. Blocks delivered twice are one block; empty blocks
    and page furniture are left out; a repeated section title continues the
    numbering of the earlier one.
    """
    ship_package(blocks.sparkSession)
    depth = F.min(F.col("parent_granularity")) if "parent_granularity" in configs.columns else F.lit(None).cast("string")
    limits = configs.groupBy("template").agg(F.min("child_max_tokens").alias("limit"), depth.alias("granularity"))
    known = templates.groupBy("document_id").agg(F.min("template").alias("template")).join(limits, "template", "left")
    other = limits.where(F.col("template") == default).first()
    box = ("bbox.y0", "bbox.y1") if "bbox" in blocks.columns else (None, None)
    places = [(F.col(c) if c else F.lit(None)).cast("double").alias(n) for c, n in zip(box, ("top", "bottom"), strict=True)]
    contracts = blocks.join(known.where("template = 'contract_terms'").select("document_id"), "document_id", "left_semi")
    by_article = chapterless(contracts).withColumn("articles", F.lit(True))
    rows = (
        blocks.select("document_id", "block_id", "page_number", "reading_order", "block_type", "text", "heading_path", "metadata", *places)
        .join(known, "document_id", "left")
        .join(by_article, "document_id", "left")
        .withColumn("template", F.when(F.col("limit").isNull(), F.lit(default)).otherwise(F.col("template")))
        .withColumn("limit", F.coalesce("limit", F.lit(other.limit if other else 450)))
        .withColumn("granularity", F.coalesce("granularity", F.lit(other.granularity if other else None)))
        .repartition("document_id")
        .dropDuplicates(["document_id", "block_id"])  # within the documents' partitions: no shuffle of its own
        .sortWithinPartitions("document_id", "page_number", "reading_order", "block_id")
    )

    def run(batches):
        import json

        state, now, out = None, None, []

        def emit(children):
            out.extend((now, state.name, *c) for c in children)

        for batch in batches:
            for r in batch.to_pylist():
                if r["document_id"] != now:
                    if state:
                        emit(state.flush())
                    state, now = Stream(r["template"] if r["template"] in RULES else default, r["limit"], GRANULARITY.get(r["granularity"], 1), bool(r["articles"])), r["document_id"]
                try:
                    meta = json.loads(r["metadata"] or "{}")
                except ValueError:
                    meta = {}
                emit(state.push(Block(r["block_id"], r["page_number"] or 0, r["block_type"] or "paragraph", r["text"] or "", r["heading_path"] or [], meta if isinstance(meta, dict) else {}, r["top"], r["bottom"])))
            if len(out) >= 1000:
                yield _batch(out)
                out.clear()
        if state:
            emit(state.flush())
        yield _batch(out)

    drafts = rows.drop("reading_order").select("document_id", "block_id", "page_number", "block_type", "text", "heading_path", "metadata", "top", "bottom", "template", "limit", "granularity", "articles").mapInArrow(run, _OUT)
    parent = T.parent_id(F.col("document_id"), T.section_id(F.col("document_id"), F.array("section")))
    ids = drafts.withColumn("parent_id", parent)
    return ids.withColumn("chunk_id", T.child_id(F.col("document_id"), F.col("template"), F.col("parent_id"), F.col("chunk_index"), F.col("block_ids")))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _OUT.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], names)


def parents_of(chunks: DataFrame) -> DataFrame:
    """Parent rows of chunks: pages, number of children, tokens."""
    return chunks.groupBy("document_id", "template", "section", "heading", "rule", "parent_id").agg(
        F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.count("*").cast("int").alias("children"), F.sum("token_count").cast("bigint").alias("token_count")
    )
