"""Splitting oversized texts at natural boundaries.

The gaps between tokens of a text have a rank: before a heading (by its
level), a blank line, a line, a sentence end, a clause end, a word. The gaps of
one rank cut a node into its children, so the ranks make a tree: sections,
paragraphs, lines, sentences, words; fenced code is one node of lines. A node
within the limit stays whole; only an oversized one is opened; siblings that
are whole are merged from the bottom up while they fit, and what is left of an
opened node is never merged with the next one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import ship_package

#: What counts as one CJK token and as one Latin word, and the tokens of a word.
CJK = "一-鿿㐀-䶿豈-﫿\U00020000-\U0002a6df"
WORD = "[a-zA-Z0-9]+(?:[-'][a-zA-Z0-9]+)*"
PER_WORD = 1.3

_TOKEN = regex.compile(f"([{CJK}])|{WORD}")
_CJK = regex.compile(f"[{CJK}]")
_WORD = regex.compile(WORD)
_HEADING = regex.compile(
    r"^[ \t]*(?:(?P<md>#{1,6})[ \t]+\S|(?P<wiki>={2,6})[ \t]*[^=\n]+?={2,6}[ \t]*$|<h(?P<html>[1-6])\b|\\(?P<tex>(?:sub){0,2}section|chapter|part)\*?\{"
    r"|(?P<cn>第[〇零一二三四五六七八九十百千0-9]+[章节条部篇])|(?P<num>\d+(?:\.\d+){0,3})[.、]?[ \t]+\p{Lu}[^.。!?！？\n]{0,60}$)",
    regex.M,
)
_LISTED = regex.compile(r"^[ \t]*(?:[-*+•·]|\d+[.)、]|[（(]?[a-zA-Z0-9一二三四五六七八九十]{1,3}[)）]|\||\\item)[ \t|]?", regex.M)
_FENCE = regex.compile(r"^[ \t]*(?P<mark>```|~~~)[^\n]*\n.*?^[ \t]*(?P=mark)[ \t]*$", regex.M | regex.S)
_BREAK = regex.compile(r"\n[^\S\n]*\n|\r[^\S\r\n]*\r|\r\n[^\S\r\n]*\r\n")
_SENTENCE, _CLAUSE = regex.compile(r"[。！？!?；;…]|\.(?:[\"'”’)\]]*)\s"), regex.compile(r"[,，、:：]|\s[-–—]\s")
TEN_HEADING, PARAGRAPH, LISTED, LINE, SENTENCE, CLAUSE, GAP = 10, 7, 6, 5, 4, 3, 1


def estimate(text: str | None) -> int:
    """CJK characters and 1.3 tokens for each Latin word, rounded down; 0 for null."""
    if not text:
        return 0
    return len(_CJK.findall(text)) + int(len(_WORD.findall(text)) * PER_WORD)


class Outline:
    """Tokens of a text, their running cost, and the rank of the gap before each token."""

    def __init__(self, text: str):
        spans, cjk = [], []
        for m in _TOKEN.finditer(text):
            spans.append(m.span())
            cjk.append(m.group(1) is not None)
        self.text, self.spans = text, spans
        self.cjk = np.concatenate([[0], np.cumsum(cjk, dtype=np.int64)]).tolist()
        headings = {}
        for m in _HEADING.finditer(text):
            headings[m.start()] = _level(m)
        fences = [m.span() for m in _FENCE.finditer(text)]
        for s, e in fences:  # a comment in code is no heading
            headings = {at: x for at, x in headings.items() if not s <= at < e}
        lists = {m.start() for m in _LISTED.finditer(text)}
        fence = 0
        rank, previous, heading_end = [0] * len(spans), 0, -1
        inline: dict[str, int] = {}
        for i, (s, _) in enumerate(spans):
            gap = text[previous:s]
            if i == 0:
                heading_end = self._heading_end(text, s, headings)
            elif not gap:
                rank[i] = GAP if cjk[i] or cjk[i - 1] else 0
            else:
                r = inline.get(gap)
                if r is None:
                    r = self._rank(gap, previous, s, headings, lists)
                    while fence < len(fences) and fences[fence][1] <= previous:
                        fence += 1
                    if r > LINE and fence < len(fences) and fences[fence][0] < previous:
                        r = LINE if s < fences[fence][1] else PARAGRAPH
                    if r < LINE:
                        inline[gap] = r
                if r >= LINE:
                    if heading_end >= previous and r <= PARAGRAPH:
                        r = CLAUSE  # a heading stays with what it heads
                    heading_end = self._heading_end(text, s, headings)
                rank[i] = r
            previous = spans[i][1]
        self.rank = rank

    @staticmethod
    def _heading_end(text: str, at: int, headings: dict) -> int:
        """End of the line of ``at`` if it is a heading, else -1."""
        if max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1 not in headings:
            return -1
        stop = text.find("\n", at)
        return len(text) if stop < 0 else stop

    @staticmethod
    def _rank(gap: str, start: int, end: int, headings: dict, lists: set) -> int:
        if "\n" in gap or "\r" in gap:
            line = start + max(gap.rfind("\n"), gap.rfind("\r")) + 1
            if line in headings:
                return TEN_HEADING + 6 - headings[line]
            if _BREAK.search(gap):
                return PARAGRAPH
            return LISTED if line in lists else LINE
        if _SENTENCE.search(gap):
            return SENTENCE
        return CLAUSE if _CLAUSE.search(gap) else GAP

    def cut(self, i: int) -> int:
        """Where a piece that begins with token i begins: at its line's start if a line ends before it, so that marks stay with it."""
        s = self.spans[i][0]
        previous = self.spans[i - 1][1] if i else 0
        return max(self.text.rfind("\n", previous, s), self.text.rfind("\r", previous, s), -1) + 1 or s

    def cost(self, i: int, j: int) -> int:
        c = self.cjk[j] - self.cjk[i]
        return c + int((j - i - c) * PER_WORD)

    def tree_pack(self, i: int, j: int, limit: int) -> list[tuple[int, int]]:
        """Token ranges within the limit that cover i..j."""
        if self.cost(i, j) <= limit or j - i <= 1:
            return [(i, j)]
        top = max(self.rank[i + 1 : j])
        if top <= GAP:  # words only: fill
            out, first = [], i
            for x in range(i + 1, j + 1):
                if x == j or self.rank[x] or top == 0:
                    if self.cost(first, x) > limit and last > first:
                        out.append((first, last))
                        first = last
                last = x if x == j or self.rank[x] or top == 0 else (last if x > i + 1 else x)
            return [*out, (first, j)]
        cuts = [i, *(x for x in range(i + 1, j) if self.rank[x] == top), j]
        out: list[tuple[int, int]] = []
        grows = False  # whether the last piece is made of whole siblings
        for a, b in zip(cuts, cuts[1:], strict=False):
            parts = self.tree_pack(a, b, limit)
            whole = len(parts) == 1
            if whole and grows and self.cost(out[-1][0], b) <= limit:
                out[-1] = (out[-1][0], b)
            else:
                out += parts
            grows = whole
        return out


def _level(m: regex.Match) -> int:
    for kind in ("md", "wiki"):
        if m.group(kind):
            return len(m.group(kind)) - (kind == "wiki")
    if m.group("html"):
        return int(m.group("html"))
    if m.group("tex"):
        return {"part": 1, "chapter": 1}.get(m.group("tex"), 2 + m.group("tex").count("sub"))
    if m.group("cn"):
        return {"部": 1, "篇": 1, "章": 2, "节": 3}.get(m.group("cn")[-1], 4)
    return min(6, 1 + m.group("num").count("."))


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(begin, start, end, tokens) of the pieces: text[start:end] end to end is the text,
    text[begin:start] is the overlap with the piece before, and no text[begin:end]
    is over the limit (a single token aside). An overlap as large as the limit
    leaves no room: then each piece has one token more than it shares."""
    o = Outline(text)
    n = len(o.spans)
    overlap = max(0, min(overlap, limit - 1))
    ranges = o.tree_pack(0, n, limit)
    if len(ranges) > 1 and overlap:
        ranges = o.tree_pack(0, n, max(1, limit - overlap))
    out = []
    before = 0  # where the piece before begins, with its own overlap
    for k, (i, j) in enumerate(ranges):
        start = 0 if k == 0 else o.cut(i)
        end = len(text) if k == len(ranges) - 1 else o.cut(j)
        b = i
        if k:
            while b > before and o.cost(b - 1, i) <= overlap and o.cost(b - 1, j) <= limit:
                b -= 1
            while b < i and o.rank[b] == 0 and b > 0:
                b += 1
        before = b
        out.append((o.cut(b) if b < i else start, start, end, o.cost(b, j)))
    return out


def split_oversized(items: DataFrame, keys: list[str], text: str, limit: str, overlap: str) -> DataFrame:
    """keys, piece, pieces, begin, start, end, tokens, text of the pieces of every
    item of ``items`` whose estimate is over ``limit``; others give no row.

    Null and empty texts are never over a limit; a null limit sets none; rows
    are split one by one, repeated ones repeatedly.
    """
    ship_package(items.sparkSession)
    schema = items.schema
    kinds = ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            take, rows = [], []
            for r, (t, most, shared) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_limit").to_pylist(), batch.column("_overlap").to_pylist(), strict=True)):
                if t and most is not None and estimate(t) > most:
                    pieces = split(t, most, shared or 0)
                    for k, (b, s, e, cost) in enumerate(pieces):
                        take.append(r)
                        rows.append((k + 1, len(pieces), b, s, e, cost, t[b:e]))
            columns = [pa.array(c, ty) for c, ty in zip(zip(*rows, strict=True) if rows else [[]] * 7, [pa.int32()] * 6 + [pa.string()], strict=True)]
            own = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), *columns], [*keys, "piece", "pieces", "begin", "start", "end", "tokens", "text"])

    ready = items.select(*keys, F.col(text).alias("_text"), F.col(limit).cast("int").alias("_limit"), F.col(overlap).cast("int").alias("_overlap"))
    return ready.mapInArrow(run, f"{kinds}, piece int, pieces int, begin int, start int, `end` int, tokens int, text string")


def over(items: DataFrame, text: str, least: int) -> DataFrame:
    """Rows of ``items`` whose estimate is over ``least``, found where they are read."""
    ship_package(items.sparkSession)

    def run(batches):
        for batch in batches:
            keep = [i for i, t in enumerate(batch.column(text).to_pylist()) if estimate(t) > least]
            yield batch.take(pa.array(keep, pa.int64()))

    # an estimate is at most 1.15 tokens a character
    return items.where(F.length(text) * 1.15 + 1 > least).mapInArrow(run, items.schema)


def oversized_pieces(blocks: DataFrame, parents: DataFrame, documents: DataFrame, configs: DataFrame, default: str = "generic_structured") -> DataFrame:
    """Pieces (see split_oversized) of all blocks and parent chunks over the limit of their document's type.

    Types without a template, and items without a document, have the limits of
    ``default``. Items delivered twice are one item.
    """
    least = configs.agg(F.min("child_max_tokens")).first()[0]
    if least is None:
        least = 1 << 30
    items = over(
        blocks.select(F.lit("block").alias("item_kind"), F.col("block_id").alias("item_id"), "document_id", "text").unionByName(
            parents.select(F.lit("parent").alias("item_kind"), F.col("parent_id").alias("item_id"), "document_id", "text")
        ),
        "text",
        least,
    )
    types = documents.groupBy(F.col("package_id").alias("document_id")).agg(F.min("doc_type").alias("doc_type"))
    templates = configs.groupBy("template").agg(F.min("child_max_tokens").alias("most"), F.min("overlap_tokens").alias("shared"))
    other = templates.where(F.col("template") == default).first()  # one row
    typed = types.join(templates, types["doc_type"] == templates["template"], "left").select("document_id", "most", "shared")
    plain = F.col("most").isNull()
    most, shared = (F.lit(other[c] if other else None).cast("int") for c in ("most", "shared"))
    limited = items.join(typed, "document_id", "left").select(
        "document_id", "item_kind", "item_id", "text", F.when(plain, most).otherwise(F.col("most")).alias("most"), F.when(plain, shared).otherwise(F.col("shared")).alias("shared")
    )
    once = limited.dropDuplicates(["document_id", "item_kind", "item_id"])
    return split_oversized(once, ["item_kind", "item_id"], "text", "most", "shared")
