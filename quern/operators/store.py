"""Versioned tables without row mutation: every operator gives the table's next state, or the rows that violate a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import compact_json, content_hash, page_or_null, strip, token_estimate

SOURCE = ("tenant_id", "knowledge_base_id", "source_uri")


def keep_latest(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """One row of each key, that with the latest time: an upsert by union and choice.

    Only the time and the row itself are compared, map side first, so a key
    that holds most rows is reduced before it is shuffled.
    """
    rest = [c for c in rows.columns if c not in keys]
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(time, F.lit("0001-01-01").cast("timestamp")), F.xxhash64(*rest))).alias("_row"))
    return packed.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*rows.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], time: str) -> DataFrame:
    return keep_latest(table.unionByName(changes), keys, time)


def same_key(a: str, b: str, keys: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def next_versions(documents: DataFrame) -> DataFrame:
    """Source columns and next_version: one more than the highest of any status."""
    return documents.groupBy(*SOURCE).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("int").alias("next_version"))


def latest_of_source(documents: DataFrame, statuses: tuple[str, ...] = ("active",)) -> DataFrame:
    """id and version of the highest version of each source in one of the statuses; ties to the higher id."""
    return documents.where(F.col("status").isin(*statuses)).groupBy(*SOURCE).agg(F.max(F.struct("version", "id")).alias("m")).select(*SOURCE, F.col("m.id").alias("id"), F.col("m.version").alias("version"))


def already_stored(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """``incoming`` with ``known_id``: the newest active or superseded document of the source with the same content hash."""
    known = documents.where(F.col("status").isin("active", "superseded")).groupBy(*SOURCE, "content_hash").agg(F.max(F.struct("version", "id"))["id"].alias("known_id"))
    cond = F.col("i.content_hash") == F.col("k.content_hash")
    return incoming.alias("i").join(known.alias("k"), cond & same_key("i", "k", SOURCE), "left").select("i.*", "k.known_id")


def stage_ingest(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """``incoming`` (source columns, content_hash, arrived_at) with outcome and version.

    Per source in order of arrival: contents that are stored, or that came
    earlier in the batch, are skipped; the rest become versions one after
    another, of which the last stays active.
    """
    known = already_stored(incoming, documents)
    order = Window.partitionBy(*SOURCE).orderBy("arrived_at", "content_hash")
    first = Window.partitionBy(*SOURCE, "content_hash").orderBy("arrived_at")
    fresh = known.withColumn("_n", F.row_number().over(first)).withColumn("_new", F.col("known_id").isNull() & (F.col("_n") == 1))
    counted = fresh.withColumn("_k", F.sum(F.col("_new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(F.col("_new").cast("int")).over(Window.partitionBy(*SOURCE)))
    base = next_versions(documents)
    out = counted.alias("c").join(base.alias("b"), same_key("c", "b", SOURCE), "left")
    outcome = F.when(~F.col("_new"), "skipped_duplicate").when(F.col("_k") == F.col("_all"), "active").otherwise("superseded")
    return out.select(*(f"c.{c}" for c in incoming.columns), outcome.alias("outcome"), F.when(F.col("_new"), F.coalesce("b.next_version", F.lit(1)) + F.col("_k") - 1).cast("int").alias("version"))


def with_status(rows: DataFrame, keys: DataFrame, on: list[str], status: str, when: Column | None = None) -> DataFrame:
    """``rows`` whose key is in ``keys`` (and which meet ``when``) with a new status."""
    hit = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    change = F.col("_hit") & (when if when is not None else F.lit(True))
    return rows.join(hit, on, "left").withColumn("status", F.when(F.coalesce(change, F.lit(False)), F.lit(status)).otherwise(F.col("status"))).select(*rows.columns)


def supersede(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents after the active ones of the given sources have been superseded."""
    hit = sources.select(*SOURCE).distinct().withColumn("_hit", F.lit(True))
    joined = documents.alias("d").join(hit.alias("h"), same_key("d", "h", SOURCE), "left")
    return joined.select(*(F.when(F.col("h._hit") & (F.col("d.status") == "active"), "superseded").otherwise(F.col("d.status")).alias("status") if c == "status" else F.col(f"d.{c}") for c in documents.columns))


def restore(documents: DataFrame, chunks: DataFrame, ids: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """New active versions of old documents and copies of their chunks under them (one version to a source)."""
    base = next_versions(documents)
    chosen = documents.join(ids, "id", "left_semi").alias("d").join(base.alias("b"), same_key("d", "b", SOURCE))
    numbered = chosen.withColumn("_new", F.lit(first_id) + F.dense_rank().over(Window.orderBy("d.id")))  # the chosen few
    docs = numbered.select(*({"id": F.col("_new").cast("bigint").alias("id"), "version": F.col("b.next_version").alias("version"), "status": F.lit("active").alias("status")}.get(c, F.col(f"d.{c}")) for c in documents.columns))
    map_ = numbered.select(F.col("d.id").alias("_old"), F.col("_new").cast("bigint").alias("_to"), F.col("b.next_version").alias("_v"))
    return docs, _copies(chunks, map_, "chunk")


def number(*parts: Column) -> Column:
    """A 60-bit number from the SHA-256 of the parts joined by colons: the id of a copy, the same wherever it is made."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("bigint")


def _copies(rows: DataFrame, map_: DataFrame, kind: str) -> DataFrame:
    """Rows of the old documents of ``map_`` (_old, _to, _v) under the new ones: ids and references to chunks and parents are those of the copies."""
    to = F.col("_to")
    new = {
        "document_id": to.alias("document_id"),
        "version": F.col("_v").alias("version"),
        "status": F.lit("active").alias("status"),
        "id": number(F.lit(kind), to, F.col("id")).alias("id") if "id" in rows.columns else None,
        "parent_id": F.when(F.col("parent_id").isNotNull(), number(F.lit("parent"), to, F.col("parent_id"))).alias("parent_id") if kind != "parent" and "parent_id" in rows.columns else None,
        "chunk_id": number(F.lit("chunk"), to, F.col("chunk_id")).alias("chunk_id") if "chunk_id" in rows.columns else None,
    }
    return rows.join(map_, rows["document_id"] == F.col("_old")).select(*(new[c] if new.get(c) is not None else F.col(c) for c in rows.columns))


def restore_tree(documents: DataFrame, parents: DataFrame, chunks: DataFrame, vectors: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """documents, parents, chunks, vectors that are new when old documents become the active version of their sources again.

    All have ids of their own; vectors and chunks refer to the new chunks and
    parents. ``document_id`` of every table is ``id`` of documents; a chunk
    that was deleted on its own comes back with its document. The present
    versions have to be superseded (see ``supersede``).
    """
    base = next_versions(documents)
    chosen = documents.join(ids.select("id").distinct(), "id", "left_semi").alias("d").join(base.alias("b"), same_key("d", "b", SOURCE))
    new = chosen.withColumn("_to", number(F.lit("document"), F.col("d.id"), F.col("b.next_version"))).withColumn("_v", F.col("b.next_version"))
    docs = new.select(*({"id": F.col("_to").alias("id"), "version": F.col("_v").alias("version"), "status": F.lit("active").alias("status")}.get(c, F.col(f"d.{c}")) for c in documents.columns))
    map_ = new.select(F.col("d.id").alias("_old"), "_to", "_v")
    return {"documents": docs, "parents": _copies(parents, map_, "parent"), "chunks": _copies(chunks, map_, "chunk"), "vectors": _copies(vectors, map_, "vector")}


def read(rows: DataFrame, tenant: str | None = None, statuses: tuple[str, ...] = ("active",), ids: DataFrame | None = None, on: str = "id", **equal: object) -> DataFrame:
    """Rows by id or by other columns, of one tenant and in one of the statuses; ``ids``: a table of the keys wanted.

    The conditions are on plain columns, so they reach the scan. Without a
    tenant rows of all are read, which only parents by key need.
    """
    out = rows.where(F.col("status").isin(*statuses))
    if tenant is not None:
        out = out.where(F.col("tenant_id") == tenant)
    for name, value in equal.items():
        out = out.where(F.col(name) == F.lit(value))
    return out if ids is None else out.join(ids.select(on).distinct(), on, "left_semi")


def versions_of(documents: DataFrame, tenant: str, base: int | None, uri: str) -> DataFrame:
    """All versions of a source, newest first."""
    rows = documents.where((F.col("tenant_id") == tenant) & F.col("knowledge_base_id").eqNullSafe(F.lit(base)) & (F.col("source_uri") == uri))
    return rows.orderBy(F.desc("version"), F.desc("id"))


def package_hashes(documents: DataFrame, blocks: DataFrame, parents: DataFrame) -> DataFrame:
    """document_id, hash: of the content of a document's blocks in order, without any of its parents' texts, null without any.

    ``documents``: document_id. Blank blocks don't count; blocks and parents
    delivered twice count once.
    """
    def joined(rows: DataFrame, order: list[str], name: str) -> DataFrame:
        texts = F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"])  # of one document
        return rows.groupBy("document_id").agg(F.array_join(texts, "\n\n").alias(name))

    own = blocks.where(strip(F.col("text")) != "").dropDuplicates(["document_id", "block_id"])
    held = parents.where(F.col("text").isNotNull()).dropDuplicates(["document_id", "parent_id"])
    both = documents.select("document_id").distinct().join(joined(own, ["page_number", "reading_order", "block_id"], "_b"), "document_id", "left").join(joined(held, ["page_start", "parent_id"], "_p"), "document_id", "left")
    return both.select("document_id", content_hash(F.coalesce("_b", "_p")).alias("hash"))


def patch(rows: DataFrame, changes: DataFrame, on: str) -> DataFrame:
    """``rows`` with the values of ``changes`` that are not null (one change of a key)."""
    fields = [c for c in changes.columns if c != on]
    new = changes.select(on, *(F.col(c).alias(f"_{c}") for c in fields))
    return rows.join(new, on, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns))


def violations(documents: DataFrame) -> DataFrame:
    """rule, key of documents that break a rule of the store."""
    def bad(name: str, where: Column) -> DataFrame:
        return documents.where(where).select(F.lit(name).alias("rule"), F.col("id").cast("string").alias("key"))

    active = documents.where((F.col("status") == "active") & F.col("knowledge_base_id").isNotNull()).groupBy(*SOURCE).agg(F.count("*").alias("n")).where("n > 1")
    versions = documents.where(F.col("knowledge_base_id").isNotNull()).groupBy(*SOURCE, "version").agg(F.count("*").alias("n")).where("n > 1")
    return (
        bad("content_hash", ~F.coalesce(F.col("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)))
        .unionByName(bad("version", F.coalesce(F.col("version") < 1, F.lit(True))))
        .unionByName(bad("status", ~F.coalesce(F.col("status").isin("active", "superseded", "deleted"), F.lit(False))))
        .unionByName(active.select(F.lit("one_active").alias("rule"), F.col("source_uri").alias("key")))
        .unionByName(versions.select(F.lit("unique_version").alias("rule"), F.concat_ws("#", "source_uri", F.col("version").cast("string")).alias("key")))
    )


def parent_rows(parents: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows to store of parent chunks: own ids, tenant and version of their document, token counts that are missing from the estimate."""
    owners = documents.select(F.col("package_id").alias("document_id"), F.col("id").alias("_doc"), "tenant_id", "version", "status")
    once = parents.dropDuplicates(["document_id", "parent_id"])
    return once.join(owners, "document_id").select(
        number(F.lit("parent"), F.col("_doc"), F.col("parent_id")).alias("id"), F.col("_doc").alias("document_id"), "tenant_id", F.col("parent_id").alias("parent_key"), "title", F.col("text").alias("content"),
        page_or_null(F.col("page_start")).alias("page_start"), page_or_null(F.col("page_end")).alias("page_end"), F.coalesce("token_count", token_estimate(F.col("text"))).cast("int").alias("token_count"), "version", "status",
    )


def child_rows(chunks: DataFrame, parents: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows to store of child chunks under stored parents; chunks of an unknown parent or document give none (see chunk_faults)."""
    owners = documents.select(F.col("package_id").alias("document_id"), F.col("id").alias("_doc"), "tenant_id", "version", "status")
    held = parents.select(F.col("document_id").alias("_doc"), F.col("parent_key").alias("_key"), F.col("id").alias("_parent"))
    rows = chunks.join(owners, "document_id").join(held, ["_doc"]).where(F.col("parent_id") == F.col("_key"))
    return rows.select(
        number(F.lit("chunk"), F.col("_doc"), F.col("chunk_id")).alias("id"), F.col("_doc").alias("document_id"), "tenant_id", F.col("_parent").alias("parent_id"), F.col("chunk_id").alias("chunk_key"), F.col("_key").alias("parent_key"),
        "chunk_index", "chunk_type", F.col("text").alias("content"), content_hash(F.col("text")).alias("content_hash"), page_or_null(F.col("page_start")).alias("page_start"), page_or_null(F.col("page_end")).alias("page_end"),
        compact_json(F.struct("token_count", "block_ids")).alias("metadata"), "version", "status",
    )


def vector_records(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors with what a search filters by, from their chunk: the record that is kept for each chunk and model."""
    own = [c for c in ("tenant_id", "document_id", "parent_id", "chunk_key", "parent_key") if c in vectors.columns]
    wanted = ["tenant_id", "document_id", "parent_id", "chunk_key", "parent_key", "department", "access_level", "doc_type", "chunk_type", "template", "source_uri", "version", "status", "heading_path", "page_start", "page_end"]
    held = chunks.select(F.col("id").alias("chunk_id"), *(c for c in wanted if c in chunks.columns)).dropDuplicates(["chunk_id"])
    return vectors.drop(*own).join(held, "chunk_id")


def put_vectors(table: DataFrame, changes: DataFrame, dims: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(next state of ``table``, rules broken): vectors by chunk and model, the latest wins.

    Vectors of an unknown model, of another length than registered, or not
    finite change nothing and are named; so are keys that come twice.
    """
    from .search import usable

    known = F.create_map(*(F.lit(x) for pair in dims.items() for x in pair))
    good = changes.where(usable("embedding", "embedding_dim") & F.coalesce(F.col("embedding_dim") == F.try_element_at(known, F.col("embedding_model")), F.lit(False)))
    twice = changes.groupBy("chunk_id", "embedding_model").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("twice").alias("rule"), F.col("chunk_id").cast("string").alias("key"))
    bad = changes.join(good.select("chunk_id", "embedding_model").distinct(), ["chunk_id", "embedding_model"], "left_anti").select(F.lit("unusable").alias("rule"), F.col("chunk_id").cast("string").alias("key"))
    return upsert(table, good, ["chunk_id", "embedding_model"], "created_at"), twice.unionByName(bad)


def missing_vectors(chunks: DataFrame, vectors: DataFrame, model: str, force: bool = False) -> DataFrame:
    """Active chunks without a vector of the model: what a backfill takes next, in order of id."""
    rows = chunks.where(F.col("status") == "active")
    return rows if force else rows.join(vectors.where(F.col("embedding_model") == model).select(F.col("chunk_id").alias("id")), "id", "left_anti")
