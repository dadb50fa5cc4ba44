"""The most similar vectors of every vector, by rotated one-bit codes.

Vectors are spread over the cells of a coarse index of two levels, about
CELL_ROWS to a cell whatever their number. A vector's code is the signs of its
randomly rotated direction, packed to bits, with one scalar: the inner product
of the direction and its code. From these the inner product with any other
vector is estimated without bias, with an error bound that follows from the
scalar; only vectors whose upper bound reaches the k-th best lower bound are
compared exactly. Every row is indexed in its nearest cell; how many cells a
row asks is measured on the sample that the index is fitted on, so that the
wanted recall is reached also where vectors have no clusters.

Equal vectors are searched once; of a group of copies at most k + 1 can be
among the k best of any row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.durable import settle
from quern.session import ship_package

#: Rows that a cell of the first level is divided on, and that the first level of a kind is fitted on, at most.
SAMPLE_ROWS = 16_384
#: Rows meant for one cell.
CELL_ROWS = 500
#: Rows of the sample whose neighbours tell how many cells to ask, and the fewest asked of the first level and of all.
TRIAL_ROWS, LEAST_FIRST, LEAST_CELLS = 512, 16, 8
#: Bytes of vectors of one side that a task holds at a time.
BLOCK_BYTES = 8_000_000
#: Bytes of all cells' directions up to which they go to the workers; beyond, rows and cells meet by shuffle, with the same result.
CELL_BYTES = 64_000_000
#: Standard errors that the bounds allow.
EPSILON = 2.6


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """The random orthogonal matrix of a dimension, always the same."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated directions, and the inner product of each with its code."""
    turned = u.astype(np.float32) @ rotation(u.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(np.float32(u.shape[1]))


def centroids(u: np.ndarray, cells: int, rounds: int = 4) -> np.ndarray:
    """Directions of the cells: spherical k-means from random rows, so that dense regions get many."""
    rng = np.random.default_rng(7)
    u = u.astype(np.float32)
    c = u[rng.choice(len(u), min(cells, len(u)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(u[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(u), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, u)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-6, total / np.maximum(size, 1e-6), c)
    return c


@dataclass
class Level:
    """The first level for one kind of vectors: directions of its cells, how many of them and of all cells a row asks."""

    number: int
    first: np.ndarray
    ask_first: int
    ask_cells: int


def fit(u: np.ndarray, count: int, number: int, k: int, floor: float, recall: float) -> Level:
    """The first level for ``count`` vectors, from a sample of them.

    Both levels are made over the sample, and exact neighbours of some of its
    rows tell behind how many cells, in the order in which a row asks them,
    the share ``recall`` of the neighbours is found.
    """
    cells = max(1, -(-count // CELL_ROWS))
    first = centroids(u, int(np.ceil(np.sqrt(cells))))
    x = u.astype(np.float32)
    score = x @ first.T
    home = score.argmax(axis=1)
    share = min(cells, max(1, len(u) // 8)) / len(u)
    second, owner = [], []
    for c in range(len(first)):
        own = x[home == c]
        if len(own):
            second.append(centroids(own, max(1, round(len(own) * share))))
            owner.append(np.full(len(second[-1]), c))
    second, owner = np.concatenate(second), np.concatenate(owner)
    leaf = np.concatenate([(x[i : i + 4096] @ second.T).argmax(axis=1) for i in range(0, len(x), 4096)])
    n = min(TRIAL_ROWS, len(u))
    cosine = u[:n] @ u.T
    cosine[np.arange(n), np.arange(n)] = -2
    near = np.argsort(-cosine, axis=1, kind="stable")[:, : min(k, len(u) - 1)]
    q, other = np.repeat(np.arange(n), near.shape[1]), near.reshape(-1)
    wanted = cosine[q, other] >= floor
    q, other = q[wanted], other[wanted]
    ask_first, ask_cells = min(LEAST_FIRST, len(first)), LEAST_CELLS  # there may be more cells than over the sample
    if len(q):
        place = np.argsort(np.argsort(-score[:n], axis=1, kind="stable"), axis=1)
        at = np.sort(place[q, owner[leaf[other]]])
        ask_first = max(ask_first, int(at[int(np.ceil(len(at) * (1 + recall) / 2)) - 1]) + 1)
        asked = np.where(place[:, owner] < ask_first, x[:n] @ second.T, -2)
        rank = np.argsort(np.argsort(-asked, axis=1, kind="stable"), axis=1)
        at = np.sort(rank[q, leaf[other]])
        ask_cells = max(ask_cells, int(at[int(np.ceil(len(at) * recall)) - 1]) + 1)
    return Level(number, first, ask_first, ask_cells)


def search(base_ids, base, codes, scalars, query_ids, query, k: int, floor: float):
    """(query, base, cosine) of the k best of every query with a cosine of at least ``floor``; a row doesn't find itself."""
    d = base.shape[1]
    turned = query.astype(np.float32) @ rotation(d)
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    scale = 1 / (np.sqrt(np.float32(d)) * scalars)
    error = EPSILON * np.sqrt(np.maximum(1 - scalars**2, 0)) / (scalars * np.sqrt(max(d - 1, 1)))
    out = []
    for i in range(0, len(query), 1024):
        estimate = (turned[i : i + 1024] @ signs.T) * scale
        low = estimate - error
        own = query_ids[i : i + 1024, None] == base_ids[None, :]
        low[own] = -2
        limit = np.full(len(low), floor)
        if low.shape[1] > k:
            limit = np.maximum(limit, np.partition(low, -k, axis=1)[:, -k])
        q, b = np.nonzero((estimate + error >= limit[:, None]) & ~own)
        cosine = np.einsum("ij,ij->i", query[i + q], base[b])
        keep = cosine >= floor
        q, b, cosine = q[keep], b[keep], cosine[keep]
        order = np.lexsort((base_ids[b], -cosine, q))
        q, b, cosine = q[order], b[order], cosine[order]
        new = np.append(True, q[1:] != q[:-1])[: len(q)]
        at = np.arange(len(q))
        place = at - np.maximum.accumulate(np.where(new, at, 0)) if len(q) else at
        top = place < k
        out.append((query_ids[i + q[top]], base_ids[b[top]], cosine[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def similar_vectors(df: DataFrame, key: str, vector: str, kind: list[str], dim: str, k: int = 10, floor: float = -1.0, recall: float = 0.97, asking: Column | None = None) -> DataFrame:
    """``kind`` columns, id, other, cosine, place: the k most similar usable vectors of every usable vector.

    Usable: not null, ``dim`` elements, all finite, not all zero; others take
    no part. Vectors of different ``kind`` or ``dim`` are never compared. Only
    those with a cosine of at least ``floor`` are given. ``asking``: a
    predicate on ``key`` for the rows that ask; all rows are found. ``recall``:
    share of the neighbours behind the cells that are asked. Ties go to the
    smaller key. Rows with a null key or kind are left out; rows with one key
    are one record. Keys are integers. Other columns are not read.
    """
    spark = df.sparkSession
    ship_package(spark)
    e = F.col(vector)
    asks = F.coalesce(asking, F.lit(False)) if asking is not None else F.lit(True)
    usable = (
        df.where(F.col(key).isNotNull() & e.isNotNull() & (F.size(e) == F.col(dim)) & (F.size(e) > 0))
        .where(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0))
        .select(*(F.col(c) for c in kind if c != dim), F.col(dim).alias("_dim"), F.col(key).alias("id"), asks.alias("asks"), e.cast("array<float>").alias("v"))
    )
    names = [c for c in kind if c != dim]
    for c in names:
        usable = usable.where(F.col(c).isNotNull())
    spaces = [*names, "_dim"]
    one = usable.groupBy(*spaces, "id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    hashed = one.select(*spaces, "id", "asks", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")
    grouped = hashed.groupBy(*spaces, "h1", "h2").agg(F.min("id").alias("rep"), F.max("asks").alias("asks"), F.first("v").alias("v"))
    reps = settle(grouped, "vectors")
    members = hashed.select(*spaces, "h1", "h2", "id", "asks").join(reps.select(*spaces, "h1", "h2", "rep"), [*spaces, "h1", "h2"]).select("rep", *spaces, "id", "asks")

    kinds = reps.groupBy(*spaces).count().orderBy(*spaces).collect()  # one row for each model and dimension
    index: dict[tuple, Level] = {}
    for n, r in enumerate(kinds):
        own = reps
        for c in spaces:
            own = own.where(F.col(c) == F.lit(r[c]))
        rows = own.select("rep", "v").orderBy(F.xxhash64(F.lit(7), "rep"), "rep").limit(SAMPLE_ROWS).select("v").toArrow()  # those with the least hashes
        index[tuple(r[c] for c in spaces)] = fit(unit(np.array(rows.column(0).to_pylist(), np.float32)), r["count"], n, k, floor, recall)
    shared = spark.sparkContext.broadcast(index)  # the square root of rows / CELL_ROWS directions a kind
    levels = list(index.values())
    rows_a_block = F.element_at(F.array(*(F.lit(max(1, BLOCK_BYTES // (8 * r["_dim"]))) for r in kinds)), F.col("space") + 1) if levels else F.lit(1)

    def place(batches):
        for batch in batches:
            table = [batch.column(c).to_pylist() for c in spaces]
            groups: dict[tuple, list[int]] = {}
            for i, name in enumerate(zip(*table, strict=True)):
                groups.setdefault(name, []).append(i)
            for name, at in groups.items():
                level = shared.value[name]
                own = batch.take(pa.array(at))
                flat = np.asarray(own.column("v").flatten(), np.float32).reshape(len(at), -1)
                u = unit(flat)
                code, scalar = encode(u)
                m = level.ask_first
                cells = _best(u.astype(np.float32) @ level.first.T, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), level.number, np.int32)),
                        own.column("rep"),
                        own.column("asks"),
                        _binary(flat),
                        _binary(code),
                        pa.array(scalar.astype(np.float32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * m + 1, m, dtype=np.int32)), pa.array(cells.astype(np.int32).reshape(-1))),
                    ],
                    ["space", "rep", "asks", "v", "code", "scalar", "firsts"],
                )

    id_kind = df.schema[key].dataType.simpleString()
    placed = settle(reps.select(*spaces, "rep", "asks", "v").mapInArrow(place, f"space int, rep {id_kind}, asks boolean, v binary, code binary, scalar float, firsts array<int>"), "first")

    # the second level: each cell of the first is divided by a hash sample of its own rows
    homes = placed.select("space", F.col("firsts")[0].alias("first"), "rep", "v")
    counted = homes.groupBy("space", "first").agg(F.count("*").alias("n"))

    def divide(table: pa.Table) -> pa.Table:
        c = centroids(unit(_floats(table.column("v"), table.num_rows)), max(1, -(-table.column("n")[0].as_py() // CELL_ROWS)))
        return pa.table({"space": pa.array([table.column("space")[0].as_py()] * len(c), pa.int32()), "first": pa.array([table.column("first")[0].as_py()] * len(c), pa.int32()), "second": pa.array(np.arange(len(c)), pa.int32()), "c": _binary(c.astype(np.float32))})

    sample = homes.join(counted, ["space", "first"]).where(F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / SAMPLE_ROWS)) == 0)
    seconds = settle(sample.groupBy("space", "first").applyInArrow(divide, "space int, first int, second int, c binary"), "second")

    # every row ranks the parts of the cells of the first level that it asks; the best is its own
    depth = {x.number: x.ask_cells for x in levels}
    if sum(-(-r["count"] // CELL_ROWS) * r["_dim"] * 4 for r in kinds) <= CELL_BYTES:
        located = _locate(placed, seconds, depth, id_kind)
    else:
        located = _locate_by_shuffle(placed, seconds, depth, rows_a_block, id_kind)
    located = settle(located, "cells")
    cell = ["space", "first", "second"]
    own = located.select("space", F.col("cells")[0]["first"].alias("first"), F.col("cells")[0]["second"].alias("second"), "rep", "v", "code", "scalar")
    asked = located.where("asks").select("space", "rep", "v", F.explode("cells").alias("c")).select("space", F.col("c.first").alias("first"), F.col("c.second").alias("second"), "rep", "v")
    block = F.any_value(rows_a_block)
    nb = own.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    nq = asked.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("nq"))
    sizes = nb.join(nq, cell)  # a row for each cell; a crowded cell is searched in a grid of blocks
    salt = F.xxhash64("rep")
    base = (
        own.join(sizes, cell)
        .withColumn("b", F.pmod(salt, "nb").cast("int"))
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
        .select(*cell, "b", "q", "rep", "v", "code", "scalar")
    )
    query = (
        asked.join(sizes, cell)
        .withColumn("q", F.pmod(salt, "nq").cast("int"))
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select(*cell, "b", "q", "rep", "v", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("float").alias("scalar"))
    )

    def find(table: pa.Table) -> pa.Table:
        coded = np.asarray(table.column("code").is_valid())
        home, ask = table.filter(pa.array(coded)), table.filter(pa.array(~coded))
        if home.num_rows and ask.num_rows:
            raw = [_floats(t.column("v"), t.num_rows) for t in (home, ask)]
            codes = np.frombuffer(b"".join(home.column("code").to_pylist()), np.uint8).reshape(home.num_rows, -1)
            q, o, c = search(np.asarray(home.column("rep")), unit(raw[0]), codes, np.asarray(home.column("scalar"), np.float32), np.asarray(ask.column("rep")), unit(raw[1]), k, floor)
        else:
            q = o = np.zeros(0, np.int64)
            c = np.zeros(0)
        kind = table.schema.field("rep").type
        return pa.table({"rep": pa.array(q).cast(kind), "other_rep": pa.array(o).cast(kind), "cosine": pa.array(c)})

    found = base.unionByName(query).groupBy(*cell, "b", "q").applyInArrow(find, f"rep {id_kind}, other_rep {id_kind}, cosine double")
    # a group of copies is its least k + 1 ids for whoever looks for it, itself included
    few = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1).select(F.col("rep").alias("other_rep"), F.col("id").alias("other"))
    itself = reps.where("asks").select("rep", F.col("rep").alias("other_rep"), F.lit(1.0).alias("cosine"))
    by = [F.desc("cosine"), F.asc("other")]
    listed = (
        found.unionByName(itself)
        .join(few, "other_rep")
        .withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(*by)))
        .where(F.col("place") <= k + 1)
        .select("rep", "other", "cosine")
    )
    out = (
        members.where("asks")
        .join(listed, "rep")
        .where(F.col("id") != F.col("other"))
        .withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(*by)))
        .where((F.col("place") <= k) & (F.col("cosine") >= floor))
    )
    return out.select(*names, F.col("_dim").alias(dim), "id", "other", "cosine", "place")


_CELLS = "array<struct<first:int,second:int>>"


def _ranked(u: np.ndarray, firsts: np.ndarray, directions: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    """Indexes of the cells a row asks, best first, among those whose first level it asks; -1 where there are fewer."""
    score = u.astype(np.float32) @ directions.T
    allowed = np.zeros((len(u), int(owner.max()) + 1), bool)
    np.put_along_axis(allowed, np.minimum(firsts, allowed.shape[1] - 1), True, axis=1)
    score[~allowed[:, owner]] = -2
    best = _best(score, min(depth, len(owner)))
    return np.where(np.take_along_axis(score, best, axis=1) > -2, best, -1)


def _locate(placed: DataFrame, seconds: DataFrame, depth: dict[int, int], id_kind: str) -> DataFrame:
    """``placed`` with the cells of every row, by a broadcast of all directions (CELL_BYTES at most)."""
    parts: dict[int, list] = {}
    for r in seconds.orderBy("space", "first", "second").collect():
        parts.setdefault(r.space, []).append((r.first, r.second, r.c))
    table = {k: (np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.stack([np.frombuffer(x[2], np.float32) for x in v])) for k, v in parts.items()}
    shared = placed.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            spaces = np.asarray(batch.column("space"))
            for space in np.unique(spaces):
                own = batch.take(pa.array(np.flatnonzero(spaces == space)))
                owner, number, directions = shared.value[int(space)]
                n = own.num_rows
                for i in range(0, n, 4096):
                    part = own.slice(i, 4096)
                    u = unit(_floats(pa.chunked_array([part.column("v")]), part.num_rows))
                    cells = _ranked(u, np.asarray(part.column("firsts").flatten()).reshape(part.num_rows, -1), directions, owner, depth[int(space)])
                    kept = cells >= 0
                    flat = cells[kept]
                    offsets = np.append(0, np.cumsum(kept.sum(axis=1))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(owner[flat].astype(np.int32)), pa.array(number[flat].astype(np.int32))], ["first", "second"]))
                    names = ["space", "rep", "asks", "v", "code", "scalar"]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], [*names, "cells"])

    return placed.mapInArrow(run, f"space int, rep {id_kind}, asks boolean, v binary, code binary, scalar float, cells {_CELLS}")


def _locate_by_shuffle(placed: DataFrame, seconds: DataFrame, depth: dict[int, int], rows_a_block: Column, id_kind: str) -> DataFrame:
    """The same where there are too many directions to send: rows meet the parts of each first cell they ask."""
    spread = placed.select("space", "rep", "v", F.explode("firsts").alias("first"))
    blocks = spread.groupBy("space", "first").agg(F.ceil(F.count("*") / F.any_value(rows_a_block)).cast("int").alias("nb"))
    left = spread.join(blocks, ["space", "first"]).select("space", "first", F.pmod(F.xxhash64("rep"), "nb").cast("int").alias("block"), "rep", "v")
    right = seconds.join(blocks, ["space", "first"]).select("space", "first", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"), "second", "c")

    def choose(rows: pa.Table, parts: pa.Table) -> pa.Table:
        kind = rows.schema.field("rep").type if rows.num_rows else parts.schema.field("second").type
        if not rows.num_rows or not parts.num_rows:
            return pa.table({"space": pa.array([], pa.int32()), "rep": pa.array([], kind), "first": pa.array([], pa.int32()), "second": pa.array([], pa.int32()), "score": pa.array([], pa.float32())})
        score = unit(_floats(rows.column("v"), rows.num_rows)).astype(np.float32) @ _floats(parts.column("c"), parts.num_rows).T
        space = rows.column("space")[0].as_py()
        best = _best(score, min(depth[space], parts.num_rows))
        row = np.repeat(np.arange(len(score)), best.shape[1])
        n = len(row)
        return pa.table(
            {
                "space": pa.array(np.full(n, space, np.int32)),
                "rep": rows.column("rep").take(pa.array(row)),
                "first": pa.array(np.full(n, rows.column("first")[0].as_py(), np.int32)),
                "second": parts.column("second").take(pa.array(best.reshape(-1))),
                "score": pa.array(np.take_along_axis(score, best, axis=1).reshape(-1)),
            }
        )

    keys = ["space", "first", "block"]
    chosen = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(choose, f"space int, rep {id_kind}, first int, second int, score float")
    most = F.element_at(F.array(*(F.lit(depth[k]) for k in sorted(depth))), F.col("space") + 1)
    # a row has at most as many entries as it asks first cells, times the cells it asks
    lists = chosen.groupBy("space", "rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "first", "second"))).alias("all"))
    cells = lists.select("space", "rep", F.transform(F.slice("all", F.lit(1), most), lambda x: F.struct(x["first"].alias("first"), x["second"].alias("second"))).alias("cells"))
    return placed.drop("firsts").join(cells, ["space", "rep"])


def _best(score: np.ndarray, m: int) -> np.ndarray:
    """Columns of the m highest scores of each row, highest first."""
    if m >= score.shape[1]:
        return np.argsort(-score, axis=1, kind="stable")
    top = np.argpartition(-score, m - 1, axis=1)[:, :m]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1, kind="stable"), axis=1)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


def _floats(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(n, -1)
