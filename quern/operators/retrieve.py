"""From hits to a cited context, for many requests in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import page_label, snippet, token_estimate

#: Defaults of the retrieval settings.
LEAST_RERANK, LEAST_VECTOR, LEAST_MARGIN, CONTEXT_TOKENS, PARENT_TOKENS = 0.35, 0.6, 0.05, 24_000, 2_000


def once(candidates: DataFrame, *keys: str, latest: str) -> DataFrame:
    """One row of each key, the latest; a null time is the oldest."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(latest), F.xxhash64(*candidates.columns))
    return candidates.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def ranked(candidates: DataFrame, request: str, key: str, score: str, limit: Column | None = None) -> DataFrame:
    """Candidates with a valid score and their ``rank`` within the request; ties by key."""
    valid = candidates.where(F.col(score).isNotNull() & ~F.isnan(score))
    out = valid.withColumn("rank", F.row_number().over(Window.partitionBy(request).orderBy(F.desc(score), F.asc(key))))
    return out.where(F.col("rank") <= limit) if limit is not None else out


def refusal(ranked_rows: DataFrame, request: str, score: str, requests: DataFrame, threshold: float = LEAST_RERANK, margin: float = LEAST_MARGIN) -> DataFrame:
    """request, refuse, reason, confidence, top1, margin, above: is the evidence enough?

    Only the two best scores and a count leave each partition.
    """
    best = ranked_rows.groupBy(request).agg(
        F.max(F.when(F.col("rank") == 1, F.col(score))).alias("top1"),
        F.max(F.when(F.col("rank") == 2, F.col(score))).alias("top2"),
        F.count_if(F.col(score) >= threshold).cast("int").alias("above"),
    )
    gap = F.col("top1") - F.col("top2")
    none, low = F.col("top1").isNull(), F.col("top1") < threshold
    return (
        requests.select(request)
        .distinct()
        .join(best, request, "left")
        .select(
            request,
            (none | F.coalesce(low, F.lit(False))).alias("refuse"),
            F.when(none, "no_candidates").when(low, "low_confidence").alias("reason"),
            F.when(none, "none").when(low, "low").when(gap < margin, "medium").otherwise("high").alias("confidence"),
            "top1",
            gap.alias("margin"),
            F.coalesce("above", F.lit(0)).alias("above"),
        )
    )


def expand_parents(ranked_rows: DataFrame, parents: DataFrame, request: str, score: str) -> DataFrame:
    """One row for each request and parent: its best child, all children in order, and the parent's text if it may be seen.

    Where parents have a status, only active ones are; where both sides have a
    tenant, only those of the row's own. Without those columns nothing is
    hidden.
    """
    if "status" in parents.columns:
        parents = parents.where("status = 'active'").drop("status")
    on = ["parent_key", *(c for c in ("tenant_id",) if c in parents.columns and c in ranked_rows.columns)]
    grouped = ranked_rows.groupBy(request, *on).agg(
        F.max_by("chunk_id", F.struct(F.col(score), -F.col("chunk_id"))).alias("chunk_id"),
        F.max(score).alias("score"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("children"),  # children of one parent
    )
    return grouped.join(parents, on, "left").withColumn("parent_missing", F.col("parent_text").isNull())


def parent_window(text: Column, tokens: Column, child: Column, rank: Column, children: Column, window: int = PARENT_TOKENS) -> Column:
    """The parent's text, or where it is long a window around the child with marks at cut ends."""
    size = F.length(text)
    count = F.coalesce(tokens, token_estimate(text))
    per = F.greatest(size / F.greatest(count, F.lit(1)), F.lit(1.0))
    found = F.position(child, text)
    guess = F.floor(size * F.least(F.try_divide(F.greatest(rank - 1, F.lit(0)).cast("double"), F.greatest(children, F.lit(1)).cast("double")), F.lit(0.9)))
    at = F.when(found > 0, found - 1).otherwise(guess)
    chars = F.floor(per * window)
    start = F.greatest(at - chars, F.lit(0))
    end = F.least(at + F.length(child) + chars, size)
    cut = F.concat(F.when(start > 0, "[...] ").otherwise(""), F.trim(F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))), F.when(end < size, " [...]").otherwise(""))
    return F.when(count <= 2 * window, text).otherwise(cut)


def references(expanded: DataFrame, request: str) -> DataFrame:
    """Parents numbered by score within the request: ref_id [1], [2], ..."""
    order = Window.partitionBy(request).orderBy(F.desc("score"), F.asc("chunk_id"))
    return expanded.withColumn("ref", F.row_number().over(order)).withColumn("ref_id", F.concat(F.lit("["), F.col("ref").cast("string"), F.lit("]")))


def context_block(ref: Column, uri: Column, start: Column, end: Column, kind: Column, path: Column, parent: Column, child: Column) -> Column:
    """The text that stands for one reference in a context; null parts are left out."""
    return F.concat_ws(
        "\n",
        ref,
        F.concat(F.lit("来源: "), uri, F.lit(" | 页码: "), page_label(start, end), F.lit(" | 类型: "), kind),
        F.when(F.size(path) > 0, F.concat(F.lit("标题路径: "), F.array_join(path, " / "))),
        parent,
        F.lit("核心段落:"),
        child,
    )


def within_budget(rows: DataFrame, request: str, order: str, full: str, compact: str, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """request, ``order``, form, used: which rows fit a token budget in order, whole or compact; what fits neither is skipped.

    ``full`` and ``compact`` are token counts. The fold sees three numbers a
    row, for the rows of one request that a top-k has left.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(full).cast("bigint").alias("f"), F.col(compact).cast("bigint").alias("c"))))

    def step(state: Column, x: Column) -> Column:
        whole, small = state["used"] + x["f"] <= budget, state["used"] + x["c"] <= budget
        used = F.when(whole, state["used"] + x["f"]).when(small, state["used"] + x["c"]).otherwise(state["used"])
        row = F.struct(x["o"].alias("o"), F.when(whole, "full").when(small, "compact").alias("form"), used.alias("used"))
        return F.struct(used.alias("used"), F.concat(state["rows"], F.array(row)).alias("rows"))

    kind = rows.schema[order].dataType.simpleString()
    empty = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<struct<o:{kind},form:string,used:bigint>>").alias("rows"))
    folded = rows.groupBy(request).agg(F.aggregate(items, empty, step)["rows"].alias("rows"))
    return folded.select(request, F.explode("rows").alias("r")).select(request, F.col("r.o").alias(order), F.col("r.form").alias("form"), F.col("r.used").alias("used")).where("form is not null")


def summaries(ranked_rows: DataFrame, chunks: DataFrame, chunk_key: str = "chunk_id") -> DataFrame:
    """Hits with the snippet of their chunk; hits whose chunk is gone are dropped."""
    return ranked_rows.join(chunks.select(F.col("id").alias(chunk_key), snippet(F.col("content")).alias("snippet")), chunk_key)
