"""Exact vector and full-text search over chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import words
from quern.session import ship_package

#: Bytes of request vectors that go to the workers at a time; more requests make more passes.
REQUEST_BYTES = 64_000_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision; null where a norm is zero or the lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    return F.when(F.size(a) == F.size(b), F.try_divide(dot, norm(a) * norm(b)))


def usable(vector: str, dim: str | None = None) -> Column:
    """A vector with finite elements, not all zero, and of the stated length where one is stated."""
    e = F.col(vector)
    ok = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    return ok & (F.size(e) == F.col(dim)) if dim else ok


def nearest(chunks: DataFrame, key: str, vector: str, request: list[float], k: int, repeated: bool = False) -> DataFrame:
    """key, score, rank of the k most similar rows to one request vector; ties by key.

    Rows of one key are one row if ``repeated`` says that there may be several:
    then keys and scores are grouped, never vectors.
    """
    q = F.array(*(F.lit(float(x)) for x in request))
    scored = chunks.select(F.col(key), cosine(F.col(vector), q).alias("score")).where("score is not null")
    if repeated:
        scored = scored.groupBy(key).agg(F.max("score").alias("score"))
    scored = scored.orderBy(F.desc("score"), F.asc(key)).limit(k)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(key))))  # k rows


def nearest_for_each(chunks: DataFrame, key: str, vector: str, requests: DataFrame, request_key: str, request_vector: str, k: int, itself: bool = False) -> DataFrame:
    """request, key, score, rank of the k most similar rows to every request vector.

    Requests go to the workers in blocks of REQUEST_BYTES and are compared with
    each batch of rows in one matrix product; a partition keeps k rows a
    request, ties by key.
    """
    spark = chunks.sparkSession
    ship_package(spark)
    count, dim = requests.agg(F.count("*"), F.max(F.size(request_vector))).first()
    blocks = max(1, -(-count * (dim or 1) * 8 // REQUEST_BYTES))
    kinds = requests.schema[request_key].dataType.simpleString(), chunks.schema[key].dataType.simpleString()
    out = None
    for block in range(blocks):
        rows = requests.where(F.pmod(F.xxhash64(request_key), F.lit(blocks)) == block).select(request_key, request_vector).toArrow()
        ids, vectors = rows.column(0), _unit(rows.column(1), dim or 1)
        shared = spark.sparkContext.broadcast((ids.to_pylist(), ids.type, vectors))

        def run(batches, shared=shared):
            names, kind, q = shared.value
            there = np.asarray(pa.array(names, kind))
            best: list[tuple] = [(np.zeros(0, np.int64), None, np.zeros(0))] * -(-len(q) // 512)  # request, key, score
            floor = np.full(len(q), -np.inf)  # the k-th best score so far
            key_kind = None
            for batch in batches:
                x = _unit(pa.chunked_array([batch.column(1)]), q.shape[1])
                here, key_kind = np.asarray(batch.column(0)), batch.schema.field(0).type
                for b in range(len(best)):
                    j = b * 512
                    score = x @ q[j : j + 512].T
                    score[np.isnan(score)] = -np.inf
                    if not itself:
                        score[here[:, None] == there[None, j : j + 512]] = -np.inf
                    cut = floor[j : j + 512]
                    if len(score) > k:
                        cut = np.maximum(cut, np.partition(score, -k, axis=0)[-k])
                    row, column = np.nonzero((score >= cut) & (score > -np.inf))
                    request, key, value = best[b]
                    request, value = np.append(request, j + column), np.append(value, score[row, column])
                    key = here[row] if key is None else np.append(key, here[row])
                    order = np.lexsort((key, -value, request))
                    request, key, value = request[order], key[order], value[order]
                    first = np.searchsorted(request, request)
                    place = np.arange(len(request)) - first
                    top = place < k
                    best[b] = (request[top], key[top], value[top])
                    full = place == k - 1
                    floor[request[full]] = value[full]
            for request, key, value in best:
                if len(request):
                    yield pa.RecordBatch.from_arrays([pa.array(names, kind).take(pa.array(request)), pa.array(key, key_kind), pa.array(value)], ["request", "key", "score"])

        part = chunks.select(key, vector).mapInArrow(run, f"request {kinds[0]}, key {kinds[1]}, score double")
        out = part if out is None else out.unionByName(part)
    best = Window.partitionBy("request").orderBy(F.desc("score"), F.asc("key"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _unit(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Unit vectors in double precision; NaN rows for those that can't be compared."""
    out = np.full((len(column), dim), np.nan)
    at = np.flatnonzero(pc.equal(pc.list_value_length(column), dim).fill_null(False).to_numpy(zero_copy_only=False))
    if len(at):
        flat = pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
        with np.errstate(over="ignore", invalid="ignore"):
            n = np.sqrt((flat * flat).sum(axis=1))
        good = np.isfinite(n) & (n > 0)
        out[at[good]] = flat[good] / n[good, None]
    return out


def lexemes(c: Column) -> Column:
    """Lower-case tokens: runs of letters and digits of any script, CJK runs unsegmented."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def full_text(chunks: DataFrame, key: str, content: str, query: str, k: int | None = None) -> DataFrame:
    """key, score of rows that hold every lexeme of the query; score grows as the cover of all of them shrinks."""
    wanted = F.array_distinct(lexemes(F.lit(query)))
    tokens = lexemes(F.col(content))
    hit = chunks.withColumn("_t", tokens).where(F.size(F.array_intersect(wanted, F.col("_t"))) == F.size(wanted)).where(F.size(wanted) > 0)
    out = hit.select(key, (F.size(wanted) / least_cover(F.col("_t"), wanted)).alias("score"))
    return out.orderBy(F.desc("score"), F.asc(key)).limit(k) if k else out


def least_cover(tokens: Column, wanted: Column) -> Column:
    """Number of tokens of the shortest stretch that holds every wanted one; null if there is none.

    A fold over the tokens that knows where each wanted one stood last.
    """
    start = F.struct(F.transform(wanted, lambda w: F.lit(0)).alias("last"), F.lit(None).cast("int").alias("best"), F.lit(0).alias("at"))

    def step(state: Column, token: Column) -> Column:
        at = state["at"] + 1
        last = F.zip_with(state["last"], wanted, lambda x, w: F.when(w == token, at).otherwise(x))
        span = F.when(F.array_min(last) > 0, at - F.array_min(last) + 1)
        return F.struct(last.alias("last"), F.least(state["best"], span).alias("best"), at.alias("at"))

    return F.aggregate(tokens, start, step, lambda s: s["best"])


def lexical_score(query: Column, content: Column) -> Column:
    """Share of the query's words that the content holds: the built-in reranker."""
    q = F.array_distinct(words(F.lower(query)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, words(F.lower(content)))).cast("double"), F.size(q).cast("double")), F.lit(0.0))
