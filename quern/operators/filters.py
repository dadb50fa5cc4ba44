"""Predicates built in one place and pushed to the scan."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels that a level may read.
READABLE = {
    "public": ("public",),
    "internal": ("public", "internal"),
    "confidential": ("public", "internal", "confidential"),
    "restricted": ("public", "internal", "confidential", "restricted"),
}
FORBIDDEN = frozenset({"tenant_id", "user_id", "department", "access_level", "status"})
ALLOWED = frozenset({"doc_type", "source_uri", "version", "date_range", "knowledge_base_id", "knowledge_base_ids"})


def one_of(column: str, value: object) -> Column:
    """Equality with a value or membership in a list; an empty list matches nothing."""
    if isinstance(value, (list, tuple, set, frozenset)):
        return F.col(column).isin(*sorted(value)) if value else F.lit(False)
    return F.col(column) == F.lit(value)


def safe(value: str, field: str) -> str:
    """The value, unless it holds what no identifier needs."""
    if any(x in value for x in ("\0", "--", "/*", "*/", ";")):
        raise ValueError(f"{field} holds an unsafe sequence")
    return value


def client_filters(filters: dict) -> dict:
    """The filters a caller may set; others raise."""
    for name in filters:
        if name in FORBIDDEN:
            raise ValueError(f"filter {name} is set by the server")
        if name not in ALLOWED:
            raise ValueError(f"filter {name} is unknown")
    if filters.get("knowledge_base_id") is not None and filters.get("knowledge_base_ids") is not None:
        raise ValueError("one knowledge base or a list, not both")
    return filters


def visible(tenant: str, department: str, level: str, filters: dict | None = None, status: str = "active") -> Column:
    """The server's predicate: tenant, status, readable levels, own and global department, and the caller's filters."""
    filters = client_filters(filters or {})
    parts = [
        F.col("tenant_id") == safe(tenant, "tenant_id"),
        F.col("status") == status,
        one_of("access_level", READABLE[level]),
        one_of("department", {department, "global"}),
    ]
    if filters.get("knowledge_base_ids") is not None:
        parts.append(one_of("knowledge_base_id", list(filters["knowledge_base_ids"])))
    for name in ("knowledge_base_id", "doc_type", "source_uri", "version"):
        if filters.get(name) is not None:
            parts.append(one_of(name, filters[name]))
    return reduce(and_, parts)


def contains_text(needle: str, columns: Iterable[str]) -> Column:
    """Any of the columns holds the needle, whatever its case; % and _ in it stay wildcards."""
    return reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{needle}%") for c in columns))


#: Suffixes that are ingested, and the limits of a document.
SUFFIXES = ("txt", "md", "markdown", "csv", "tsv", "pdf")
MOST_BYTES, MOST_CHUNKS, MOST_TOP_K, MOST_FINAL_K = 100 * 1024 * 1024, 20_000, 50, 8


def admit(suffix: Column, length: Column) -> Column:
    """Why a file is not ingested; null if it is."""
    return F.when(~F.coalesce(F.lower(suffix).isin(*SUFFIXES), F.lit(False)), "suffix").when(length > MOST_BYTES, "size").when(length <= 0, "empty")


def top_k(requested: int | None, most: int) -> int:
    """The requested number of results within the configured one."""
    if requested is None:
        return most
    if not 0 < requested <= most:
        raise ValueError(f"at most {most} results can be asked for")
    return requested
