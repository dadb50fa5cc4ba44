"""Retrieval end to end: many requests, one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import analyze_query, snippet, token_estimate

from . import retrieve as R
from .search import lexical_score, nearest_for_each


def answer_contexts(
    requests: DataFrame, chunks: DataFrame, vectors: DataFrame, parents: DataFrame, titles: DataFrame, allowed: Column, top_k: int = 50, final_k: int = 8, budget: int = R.CONTEXT_TOKENS, rerank: bool = True
) -> DataFrame:
    """One row for each request: status, reason, confidence, context, tokens, references, hits.

    ``requests``: request_id, question, vector. ``chunks``: stored chunks;
    ``allowed`` is the predicate that is applied before anything is ranked.
    ``vectors``: chunk_id, embedding. ``parents``: parent_key, parent_text, and
    tenant_id and status, by which parents that may not be seen are hidden.
    ``titles``: document_id, title. A request that is empty or too short is
    rejected, one without a vector has no candidates. Without ``rerank`` the
    order is that of the vectors.
    """
    asked = requests.dropDuplicates(["request_id"]).withColumn("q", analyze_query(F.col("question")))
    good = asked.where(~F.col("q.rejected"))
    shown = chunks.where(allowed).dropDuplicates(["id"]).withColumnRenamed("id", "chunk_id")
    searchable = vectors.join(shown.select("chunk_id"), "chunk_id", "left_semi")
    hits = nearest_for_each(searchable, "chunk_id", "embedding", good.where("vector is not null"), "request_id", "vector", top_k)
    hits = hits.select(F.col("request").alias("request_id"), F.col("key").alias("chunk_id"), F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    full = hits.join(shown, "chunk_id").join(good.select("request_id", F.col("q.effective").alias("_q")), "request_id")
    score = lexical_score(F.col("_q"), F.col("content")) if rerank else F.col("vector_score")
    final = R.ranked(full.withColumn("score", score), "request_id", "chunk_id", "score", F.lit(final_k))
    decision = R.refusal(final, "request_id", "score", good, R.LEAST_RERANK if rerank else R.LEAST_VECTOR)

    best = final.select("request_id", "chunk_id", "vector_rank", "document_id", "content", "source_uri", "doc_type", "page_start", "page_end", "heading_path")
    grown = R.references(R.expand_parents(final, parents, "request_id", "score"), "request_id").join(best, ["request_id", "chunk_id"]).join(titles, "document_id", "left")
    parent = R.parent_window(F.col("parent_text"), F.lit(None).cast("int"), F.col("content"), F.col("vector_rank"), F.size("children"))
    parts = [F.col(c) for c in ("ref_id", "source_uri", "page_start", "page_end", "doc_type", "heading_path")]
    blocks = grown.withColumn("whole", R.context_block(*parts, parent, F.col("content"))).withColumn("small", R.context_block(*parts, F.lit(None).cast("string"), F.col("content")))
    sized = blocks.withColumn("f", token_estimate(F.col("whole"))).withColumn("c", token_estimate(F.col("small")))
    chosen = R.within_budget(sized, "request_id", "ref", "f", "c", budget)
    lines = sized.join(chosen, ["request_id", "ref"])
    entry = F.struct("ref", F.when(F.col("form") == "full", F.col("whole")).otherwise(F.col("small")).alias("text"), "document_id", "title", "chunk_id", "parent_key", "score")
    context = lines.groupBy("request_id").agg(F.array_sort(F.collect_list(entry)).alias("r"), F.max("used").alias("tokens"))  # final_k rows at most
    summary = final.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.round("score", 6).alias("score"), snippet(F.col("content")).alias("snippet")))).alias("hits"))
    out = asked.select("request_id", "q").join(decision, "request_id", "left").join(context, "request_id", "left").join(summary, "request_id", "left")
    answered = ~F.col("q.rejected") & ~F.coalesce("refuse", F.lit(True))
    return out.select(
        "request_id",
        F.when(F.col("q.rejected"), "rejected").when(F.col("refuse"), "refused").when(F.col("r").isNull(), "refused").otherwise("retrieved").alias("status"),
        F.coalesce("q.reason", "reason", F.when(F.col("r").isNull(), "context_budget_exceeded")).alias("reason"),
        F.coalesce("confidence", F.lit("none")).alias("confidence"),
        F.when(answered, F.array_join(F.transform("r", lambda x: x["text"]), "\n\n---\n\n")).alias("context"),
        F.when(answered, F.col("tokens")).alias("tokens"),
        F.when(answered, F.transform("r", lambda x: F.struct(x["ref"].alias("ref"), x["document_id"].alias("document_id"), x["title"].alias("title"), x["chunk_id"].alias("chunk_id"), x["parent_key"].alias("parent_key")))).alias("references"),
        "hits",
    )
