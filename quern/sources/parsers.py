"""Parsing binary documents with a chain of parsers: the first that gives blocks wins, the others leave warnings."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.session import ship_package

from .files import content_items

#: A parser takes a file's name and bytes to (page, block type, text, heading path) rows.
Parser = Callable[[str, bytes], list[tuple[int, str, str, list[str]]]]

_SCHEMA = "document_id string, path string, parser string, reading_order int, page_number int, block_type string, text string, heading_path array<string>, warnings array<string>"


def layout_json(name: str, content: bytes):
    """A JSON list of layout items."""
    return content_items(json.loads(content))


def layout_archive(name: str, content: bytes):
    """A zip archive with a list of layout items, or else with full Markdown."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        for n in names:
            if n.endswith("_content_list.json"):
                return content_items(json.loads(z.read(n)))
        for n in names:
            if n.endswith("full.md"):
                return markdown(n, z.read(n))
    return []


def markdown(name: str, content: bytes):
    """Markdown with a stack of headings by level."""
    out, stack = [], []
    for part in content.decode("utf-8", "replace").replace("\r\n", "\n").split("\n\n"):
        text = part.strip()
        level = len(text) - len(text.lstrip("#"))
        if 0 < level <= 6 and "\n" not in text and text[level : level + 1] == " ":
            title = text[level:].strip()
            del stack[level - 1 :]
            stack.append(title)
            out.append((1, "heading", title, list(stack)))
        elif text:
            out.append((1, "paragraph", text, list(stack)))
    return out


def pdf_text(name: str, content: bytes):
    """Text of a PDF's pages, where pypdf is installed."""
    from pypdf import PdfReader

    pages = [(n, (p.extract_text() or "").strip()) for n, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]
    return [(n, "paragraph", t, []) for n, page in pages for t in page.split("\n\n") if t.strip()]


#: Parsers by name, in the order in which they are tried.
CHAIN: dict[str, Parser] = {"layout_archive": layout_archive, "layout_json": layout_json, "pdf_text": pdf_text}


def parse_files(files: DataFrame, chain: dict[str, Parser] | None = None) -> DataFrame:
    """Blocks of ``files`` (document_id, path, content), with the parser that gave them and the warnings of those before.

    A file that no parser can read gives one row without text, parser null,
    with all warnings: the quarantine.
    """
    ship_package(files.sparkSession)
    parsers = dict(chain or CHAIN)

    def run(batches):
        for batch in batches:
            rows = []
            for doc, path, content in zip(*(batch.column(c).to_pylist() for c in ("document_id", "path", "content")), strict=True):
                warnings, found, used = [], [], None
                for name, parse in parsers.items():
                    try:
                        found = parse(path, content or b"")
                    except Exception as e:  # a parser may fail in any way
                        warnings.append(f"{name}: {type(e).__name__}")
                        continue
                    if found:
                        used = name
                        break
                    warnings.append(f"{name}: empty")
                rows += [(doc, path, used, n, *b, warnings) for n, b in enumerate(found)] or [(doc, path, None, 0, None, None, None, None, warnings)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])

    return files.select("document_id", "path", "content").mapInArrow(run, _SCHEMA)
