"""Text expressions that stay in the JVM.

White space is spelled out as a class because Java's ``\\s`` is ASCII only; the
same class works in DuckDB, which the SQL twins use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space without the line feed.
WS_INLINE = r"[\x{9}\x{b}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: What the token estimate counts.
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{20000}-\x{2a6df}]"
WORD = r"[a-zA-Z0-9]+(?:[-'][a-zA-Z0-9]+)*"
#: Polite openings that a query loses, and marks of several intents.
PREFIXES = ("please", "can you", "could you", "tell me", "help me find", "help me search", "请问", "帮我查", "帮我找", "你知道")
INTENTS = ("以及", "同时", "并且", "还有", " and ", " plus ", "；", ";")
#: Fixed value: an answer that starts so refuses and needs no citation.
REFUSAL = "当前资料无法确认"
#: An audit entry whose key contains one of these is not kept.
SECRET_KEYS = ("password", "secret", "token", "api_key", "authorization", "credential", "private_key")


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def squash(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def words(c: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def token_estimate(c: Column) -> Column:
    """CJK characters and 1.3 tokens for each Latin word, rounded down; 0 for null."""
    return F.coalesce((F.regexp_count(c, F.lit(CJK)) + F.floor(F.regexp_count(c, F.lit(WORD)) * F.lit(1.3))).cast("int"), F.lit(0))


def normalize_content(c: Column) -> Column:
    """Line feeds only, nothing at line ends, at most one blank line in a row, nothing at the ends; no BOM."""
    c = F.regexp_replace(c, r"\x{feff}", "")
    c = F.regexp_replace(c, r"\r\n|\r", "\n")
    c = F.regexp_replace(c, f"{WS_INLINE}+\n", "\n")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return strip(c)


def content_hash(c: Column) -> Column:
    return F.sha2(normalize_content(c), 256)


def stable_hash(*parts: Column, length: int = 32) -> Column:
    """The first hex digits of the SHA-256 of the parts joined by colons; null parts are empty."""
    return F.substring(F.sha2(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, length)


def block_id(document: Column, page: Column, order: Column, kind: Column) -> Column:
    return stable_hash(F.lit("block"), document, page, order, kind)


def section_id(document: Column, path: Column) -> Column:
    return stable_hash(F.lit("section"), document, F.when(F.size(path) > 0, F.array_join(path, " > ")).otherwise(F.lit("Document")))


def parent_id(document: Column, section: Column) -> Column:
    return stable_hash(F.lit("parent"), document, section)


def child_id(document: Column, template: Column, parent: Column, index: Column, blocks: Column) -> Column:
    return stable_hash(F.lit("child"), document, template, parent, index, F.array_join(blocks, ","))


def snippet(c: Column, limit: int = 360) -> Column:
    """The squashed text, cut after ``limit`` characters with three dots."""
    s = squash(c)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit)), F.lit("...")))


def page_label(start: Column, end: Column) -> Column:
    return (
        F.when(start.isNull() & end.isNull(), F.lit("未知"))
        .when(end.isNull() | start.eqNullSafe(end), start.cast("string"))
        .when(start.isNull(), end.cast("string"))
        .otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))
    )


def page_or_null(c: Column) -> Column:
    return F.when(c > 0, c)


def model_slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"))


def clean_page_marks(c: Column) -> Column:
    """Without page marks, and without lines that are then 4 to 8 digits alone."""
    c = F.regexp_replace(c, r"(?i)第\s*\d+\s*页(?:\s*(?:共|/)\s*\d+\s*页)?|(?:^|\s)[-—]\s*\d+\s*[-—](?:\s|$)|Page\s+\d+(?:\s+of\s+\d+)?", "")
    c = F.regexp_replace(c, r"(?m)^[ \t]*\d{4,8}[ \t]*(?:\n|$)", "")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def line_shape(c: Column) -> Column:
    """A line with digits as # and single spaces, to find running headers."""
    return F.lower(F.regexp_replace(squash(c), "[0-9]+", "#"))


def strip_tags(c: Column) -> Column:
    """Text of an HTML fragment: tags become spaces, the five basic entities are resolved."""
    c = F.regexp_replace(c, "<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return squash(c)


def analyze_query(c: Column, least: int = 2, rewrite: bool = False) -> Column:
    """Struct of effective, rejected, reason, intents of a question."""
    q = squash(F.coalesce(c, F.lit("")))
    intents = F.greatest(F.lit(1), F.when(F.regexp_count(q, F.lit("[?？]")) > 1, F.regexp_count(q, F.lit("[?？]"))).otherwise(F.lit(1)))
    for mark in INTENTS:
        intents = intents + F.regexp_count(q, F.lit(mark))
    intents = intents + F.when(F.length(q) > 8, F.regexp_count(q, F.lit("和"))).otherwise(F.lit(0))
    reason = F.when(q == "", "empty_query").when(~q.rlike(r"(?U)[\w\x{4e00}-\x{9fff}]"), "empty_query").when(F.length(q) < least, "query_too_short")
    effective = q
    if rewrite:
        effective = F.coalesce(F.when(reason.isNull(), squash(F.regexp_replace(q, "(?i)^(?:" + "|".join(PREFIXES) + ")[ ，,：:]*", ""))), q)
    return F.struct(effective.alias("effective"), reason.isNotNull().alias("rejected"), reason.alias("reason"), intents.cast("int").alias("intents"))


def citations(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))


def check_citations(answer: Column, allowed: Column) -> Column:
    """Struct of valid, reason: an answer may cite only allowed numbers, and has to cite one; a refusal need not."""
    cited = citations(answer)
    invented = F.array_sort(F.array_except(cited, allowed))
    reason = (
        F.when(F.size(invented) > 0, F.concat(F.lit("invented citation: "), F.get(invented, F.lit(0)).cast("string")))
        .when((F.size(allowed) > 0) & (F.size(cited) == 0), "answer has no citations")
        .when(F.size(allowed) == 0, "answer has no references")
    )
    refusal = strip(answer).startswith(REFUSAL)
    return F.struct((refusal | reason.isNull()).alias("valid"), F.when(~refusal, reason).alias("reason"))


def redact(entries: Column) -> Column:
    """A string map without the values of secret keys."""
    return F.transform_values(entries, lambda k, v: F.when(F.lower(k).rlike("|".join(SECRET_KEYS)), F.lit("[redacted]")).otherwise(v))


def warning(c: Column) -> Column:
    """A warning as struct of level, message, source: what is a JSON object keeps its own, what is a plain text is its message."""
    own = F.from_json(F.when(strip(c).startswith("{"), c), "level string, message string, source string")
    known = own["message"].isNotNull()
    return F.when(
        c.isNotNull(),
        F.struct(F.when(known, own["level"]).otherwise("warning").alias("level"), F.when(known, own["message"]).otherwise(c).alias("message"), F.when(known, own["source"]).otherwise("ingest").alias("source")),
    )


def compact_json(value: Column) -> Column:
    """A struct, map or array as JSON without its null fields, at any depth."""
    return F.to_json(value, {"ignoreNullFields": "true"})


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table: the first row heads it, short rows are filled, bars are escaped."""
    width = F.array_max(F.transform(rows, F.size))
    cells = F.transform(rows, lambda r: F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|"))))
    lines = F.transform(cells, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1_000_000)), "\n"))


def lock_id(tenant: Column, kb: Column, uri: Column, seed: int = 0x51A7C0DE) -> Column:
    """A 63-bit number for the one writer of a source."""
    digest = F.substring(F.sha2(F.concat_ws(":", tenant, F.lit("kb"), F.coalesce(kb.cast("string"), F.lit("")), uri), 256), 1, 15)
    return F.conv(digest, 16, 10).cast("bigint").bitwiseXOR(F.lit(seed))
