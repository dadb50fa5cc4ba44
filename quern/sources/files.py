"""Files as tables of blocks: plain text, Markdown, delimited rows, parser output in JSON, HTML tables."""

from __future__ import annotations

import csv
import io
import json
from html.parser import HTMLParser
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.blocks import BLOCK_TYPES, block_type, text_blocks
from quern.session import ship_package

TEXT, TABLE = ("txt", "md", "markdown"), ("csv", "tsv", "xlsx", "xlsm")


def parser_for(suffix: str, forced: str | None = None) -> str:
    """The parser of a file suffix: text, table, else pdf."""
    if forced:
        return forced
    s = suffix.lower().lstrip(".")
    return "text_file" if s in TEXT else "table_file" if s in TABLE else "pdf"


def read_files(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """path, document_id (SHA-256 of the bytes), suffix, length, content; files over ``most_bytes`` are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    return files.select("path", F.sha2("content", 256).alias("document_id"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"), "length", "content")


def read_text_blocks(files: DataFrame) -> DataFrame:
    """Blocks of text and Markdown files; bytes that aren't UTF-8 become replacement characters."""
    decoded = files.where(F.col("suffix").isin(*TEXT)).select("document_id", F.try_validate_utf8(F.col("content").cast("string")).alias("ok"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return text_blocks(decoded.select("document_id", F.coalesce("ok", "text").alias("text")), "document_id", "text")


def headers(row: list[str]) -> list[str]:
    """Clean column names: blank ones get their number, repeated ones too."""
    out: list[str] = []
    for i, value in enumerate(row, 1):
        name = value.strip() or f"column_{i}"
        out.append(f"{name}_{i}" if name in out else name)
    return out


def delimited_rows(raw: str, suffix: str) -> list[tuple[int, dict[str, str]]]:
    """(row number, values) of a delimited text; its first row names the columns; empty rows are dropped."""
    raw = raw.removeprefix("﻿")
    if suffix == "tsv":
        reader = csv.reader(raw.splitlines(), delimiter="\t")
    else:
        try:
            reader = csv.reader(raw.splitlines(), csv.Sniffer().sniff(raw[:4096], delimiters=",;\t|"))
        except csv.Error:
            reader = csv.reader(raw.splitlines())
    rows = [[c.strip() for c in r] for r in reader]
    if not rows:
        return []
    names = headers(rows[0])
    return [(n, dict(zip(names, r + [""] * (len(names) - len(r)), strict=False))) for n, r in enumerate(rows[1:], 2) if any(r)]


def row_text(values: dict[str, str], sheet: str, number: int) -> str:
    return "\n".join([f"Sheet: {sheet}", f"Row: {number}", *(f"{k}: {v}" for k, v in values.items() if v.strip())])


_ROW_SCHEMA = "document_id string, sheet string, row_number int, cells map<string,string>, text string"


def _cells(values: list[dict[str, str]]) -> pa.Array:
    return pa.array([list(v.items()) for v in values], pa.map_(pa.string(), pa.string()))


def read_table_blocks(files: DataFrame) -> DataFrame:
    """One row for each row of the delimited files (and workbooks, where their reader is installed)."""
    ship_package(files.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for doc, path, suffix, content in zip(*(batch.column(c).to_pylist() for c in ("document_id", "path", "suffix", "content")), strict=True):
                if suffix in ("csv", "tsv"):
                    sheet = PurePosixPath(path).stem
                    out += [(doc, sheet, n, v, row_text(v, sheet, n)) for n, v in delimited_rows(content.decode("utf-8-sig", "replace"), suffix)]
                else:
                    out += [(doc, sheet, n, v, row_text(v, sheet, n)) for sheet, n, v in _workbook(content)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), _cells(columns[3]), pa.array(columns[4], pa.string())], ["document_id", "sheet", "row_number", "cells", "text"])

    return files.where(F.col("suffix").isin(*TABLE)).select("document_id", "path", "suffix", "content").mapInArrow(run, _ROW_SCHEMA)


def _workbook(content: bytes):
    try:
        from openpyxl import load_workbook
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    for sheet in load_workbook(io.BytesIO(content), read_only=True, data_only=True).worksheets:
        rows = [["" if c is None else str(c).strip() for c in r] for r in sheet.iter_rows(values_only=True)]
        rows = [r for r in rows if any(r)]
        if rows:
            names = headers(rows[0])
            yield from ((sheet.title, n, dict(zip(names, r, strict=False))) for n, r in enumerate(rows[1:], 2))


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self._close()
            if not self.rows:
                self.rows.append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _close(self):
        if self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def html_rows(fragment: str | None) -> list[list[str]]:
    """Cells of the table rows of an HTML fragment; unclosed cells end where the next begins."""
    p = _Cells()
    p.feed(fragment or "")
    p._close()
    return [r for r in p.rows if r]


def structured_chunks(df: DataFrame, key: str, content: str) -> DataFrame:
    """Blocks of JSON arrays of parsed chunks (raw_text, page_number, headings, chapter, section, content_type).

    Blank chunks are left out; headings that are missing are chapter and
    section; a page below 1 is 1; what is no JSON array gives no rows.
    """
    kind = "array<struct<raw_text:string,page_number:int,headings:array<string>,chapter:string,section:string,content_type:string>>"
    items = df.select(F.col(key).alias("document_id"), F.posexplode(F.from_json(content, kind)).alias("reading_order", "c"))
    clean = F.filter(F.transform(F.coalesce("c.headings", F.array().cast("array<string>")), T.strip), lambda x: x != "")
    given = F.array_distinct(F.filter(F.array(T.strip(F.col("c.chapter")), T.strip(F.col("c.section"))), lambda x: x.isNotNull() & (x != "")))
    page = F.when(F.col("c.page_number") > 0, F.col("c.page_number")).otherwise(1)
    rows = items.withColumn("text", T.strip(F.col("c.raw_text"))).where("text <> ''").withColumn("block_type", block_type(F.col("c.content_type")))
    return rows.select("document_id", page.cast("int").alias("page_number"), "reading_order", "block_type", "text", F.when(F.size(clean) > 0, clean).otherwise(given).alias("heading_path")).withColumn(
        "block_id", T.block_id(F.col("document_id").cast("string"), F.col("page_number"), F.col("reading_order"), F.col("block_type"))
    )


def html_tables(blocks: DataFrame, key: str, html: str) -> DataFrame:
    """key, rows, markdown of every fragment that holds a table row."""
    ship_package(blocks.sparkSession)
    kind = blocks.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [html_rows(h) for h in batch.column(1).to_pylist()]
            keep = [i for i, r in enumerate(rows) if r]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([rows[i] for i in keep], pa.list_(pa.list_(pa.string())))], [key, "rows"])

    parsed = blocks.where(F.col(html).rlike("(?i)<t[rdh][ >]")).select(key, html).mapInArrow(run, f"{key} {kind}, rows array<array<string>>")
    return parsed.withColumn("markdown", T.markdown_table(F.col("rows")))


def content_items(items: list[dict]) -> list[tuple[int, str, str, list[str]]]:
    """(page, block type, text, heading path) of a layout parser's items; headings keep a stack by level."""
    out, stack = [], []
    for item in items:
        page = item["page_idx"] + 1 if isinstance(item.get("page_idx"), int) else item.get("page_number") or item.get("page") or 1
        label = str(item.get("type") or item.get("label") or "text").lower()
        kind = BLOCK_TYPES.get(label, "paragraph")
        caption = item.get("table_caption") or item.get("caption") or []
        body = item.get("table_body") or item.get("html")
        if kind == "table" and body:
            rows = html_rows(body)
            text = "\n".join([*(caption if isinstance(caption, list) else [caption]), *("\t".join(r) for r in rows)])
        else:
            text = str(item.get("text") or item.get("content") or ("[Figure]" if kind == "figure" else ""))
        level = item.get("text_level") or item.get("level") or (1 if kind in ("heading", "title") else 0)
        if level:
            kind = "heading"
            del stack[max(0, int(level) - 1) :]
            stack.append(text.strip())
        if text.strip():
            out.append((int(page), kind, text.strip(), list(stack)))
    return out


def read_layout_items(df: DataFrame, key: str, content: str) -> DataFrame:
    """Blocks of JSON lists of layout items; what is no such list gives none."""
    ship_package(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                try:
                    items = json.loads(raw or "[]")
                except ValueError:
                    items = []
                items = [x for x in items if isinstance(x, dict)] if isinstance(items, list) else []
                out += [(i, n, *b) for n, b in enumerate(content_items(items))]
            c = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(c[0], pa.int64())), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.string()), pa.array(c[4], pa.string()), pa.array(c[5], pa.list_(pa.string()))],
                [key, "reading_order", "page_number", "block_type", "text", "heading_path"],
            )

    return df.select(key, content).mapInArrow(run, f"{key} {kind}, reading_order int, page_number int, block_type string, text string, heading_path array<string>")
