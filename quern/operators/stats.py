"""Counts and checks over the stored collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collection_stats(bases: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Knowledge bases with their active documents, active chunks, and the latest change of a document."""
    docs = documents.groupBy("knowledge_base_id").agg(F.count_if(F.col("status") == "active").alias("documents"), F.max("updated_at").alias("last_update"), F.max_by("status", F.struct("updated_at", "id")).alias("last_status"))
    parts = chunks.where(F.col("status") == "active").groupBy("knowledge_base_id").agg(F.countDistinct("id").alias("chunks"))
    zero = F.lit(0).cast("bigint")
    return (
        bases.select(F.col("id").alias("knowledge_base_id"), "name", "status")
        .join(docs, "knowledge_base_id", "left")
        .join(parts, "knowledge_base_id", "left")
        .select("knowledge_base_id", "name", "status", F.coalesce("documents", zero).alias("documents"), F.coalesce("chunks", zero).alias("chunks"), "last_update", "last_status")
    )


def latest_per(rows: DataFrame, key: str, time: str, tie: str, *columns: str) -> DataFrame:
    """The latest row of each key, by an aggregate."""
    return rows.groupBy(key).agg(F.max(F.struct(time, tie, *columns)).alias("m")).select(key, F.col(f"m.{time}").alias(time), F.col(f"m.{tie}").alias(tie), *(F.col(f"m.{c}").alias(c) for c in columns))


def most_recent(rows: DataFrame, time: str, tie: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(time), F.desc(tie)).limit(limit)


def chunk_tree(documents: DataFrame, parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, parents, children, with_children of each document: the tree in numbers."""
    p = parents.select("document_id", "parent_id").distinct()
    c = chunks.select(F.col("parent_key").alias("parent_id"), "id").distinct().groupBy("parent_id").agg(F.count("*").alias("n"))
    tree = p.join(c, "parent_id", "left").groupBy("document_id").agg(F.count("*").alias("parents"), F.sum(F.coalesce("n", F.lit(0))).alias("children"), F.count("n").alias("with_children"))
    zero = F.lit(0).cast("bigint")
    return documents.select(F.col("package_id").alias("document_id")).distinct().join(tree, "document_id", "left").select("document_id", *(F.coalesce(x, zero).alias(x) for x in ("parents", "children", "with_children")))


def orphans(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """problem, key: chunks without a parent, parents without a chunk, chunk keys used twice in a document."""
    child = chunks.select("chunk_key", "parent_key", "document_id", "id").distinct()
    lost = child.join(parents.select(F.col("parent_id").alias("parent_key")).distinct(), "parent_key", "left_anti").select(F.lit("orphan_child").alias("problem"), F.col("chunk_key").alias("key"))
    empty = parents.select("parent_id").distinct().join(child.select(F.col("parent_key").alias("parent_id")), "parent_id", "left_anti").select(F.lit("childless_parent").alias("problem"), F.col("parent_id").alias("key"))
    twice = child.groupBy("document_id", "chunk_key").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_key").alias("problem"), F.col("chunk_key").alias("key"))
    return lost.unionByName(empty).unionByName(twice)


def quality(chunks: DataFrame, text: str = "text", limit: int = 450) -> DataFrame:
    """Per document: chunks, kinds, average, least and most tokens, chunks over the limit."""
    return chunks.groupBy("document_id").agg(
        F.count("*").alias("chunks"),
        F.countDistinct("chunk_type").alias("kinds"),
        F.round(F.avg("token_count"), 4).alias("avg_tokens"),
        F.min("token_count").cast("int").alias("min_tokens"),
        F.max("token_count").cast("int").alias("max_tokens"),
        F.count_if(F.col("token_count") > limit).alias("over_limit"),
    )


def context_coverage(context: DataFrame) -> DataFrame:
    """coverage: share of media chunks (see media_context) with a context on either side; 1.0 where there are none."""
    has = (F.col("context_before").isNotNull() | F.col("context_after").isNotNull()).cast("double")
    return context.agg(F.coalesce(F.avg(has), F.lit(1.0)).alias("coverage"))


def sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """user_id, session, start, events: runs of a user's events without a longer gap."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp").cast("double")
    far = at - F.lag(at).over(order) > gap_seconds
    marked = events.withColumn("_far", far).withColumn("session", F.sum(F.coalesce(F.col("_far").cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.count("*").alias("events"))
