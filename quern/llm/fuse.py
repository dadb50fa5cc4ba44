"""One ranking from several scores that have nothing in common but their order.

Scores are reduced to places within their group (``item_places``). The order is
taken from the places as they are, or from a walk over the group's items
(``rank_walk``): from an item it picks a score at random and jumps to a random
item that is placed higher by it (staying where there is none); with
probability 1 - ``damping`` it starts anew anywhere. Its stationary share of
time orders the items. One step of the walk is a prefix sum per score over the
items in score order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.durable import settle
from quern.session import ship_package

#: Items of a group that one task walks in memory; larger groups are walked as tables.
MEMORY_ITEMS = 500_000
#: Score values of a group that one window task sorts; larger groups are cut into bins.
WINDOW_VALUES = 500_000
_BINS = 256


def rank_places(items: DataFrame, group: str, item: str, scores: list[str], window_values: int = WINDOW_VALUES) -> DataFrame:
    """``items`` with place_<score> and higher_<score>: 1 + and the number of items of the group with a strictly higher score.

    Null and NaN are placed after all valid scores. Equal scores are counted
    before anything is sorted, and groups with many values are sorted in bins,
    so neither a group nor a tie of a third of all rows lands in one task.
    """
    out = items
    for s in scores:
        clean = F.when(~F.isnan(s), F.col(s) + F.lit(0.0))  # -0.0 and 0.0 are one value
        values = out.select(group, clean.alias("_v")).groupBy(group, "_v").agg(F.count("*").alias("_n"))
        valid = values.where("_v is not null")
        large = valid.groupBy(group).agg(F.count("*").alias("_m"), F.percentile_approx("_v", [x / _BINS for x in range(1, _BINS)], 10_000).alias("_cuts")).where(F.col("_m") > window_values)
        binned = valid.join(large.select(group, "_cuts"), group, "left").withColumn(
            "_bin", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
        )
        above = Window.partitionBy(group).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
        base = binned.groupBy(group, "_bin").agg(F.sum("_n").alias("_in")).withColumn("_base", F.coalesce(F.sum("_in").over(above), F.lit(0)))
        within = Window.partitionBy(group, "_bin").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)
        placed = (
            binned.withColumn("_own", F.coalesce(F.sum("_n").over(within), F.lit(0)))
            .join(base.select(group, "_bin", "_base"), [group, "_bin"])
            .select(group, "_v", (F.col("_base") + F.col("_own")).alias("_higher"))
        )
        rest = values.groupBy(group).agg(F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0)).alias("_higher")).select(group, F.lit(None).cast("double").alias("_v"), "_higher")
        every = placed.unionByName(rest).select(F.col(group).alias("_g"), F.col("_v").alias("_w"), F.col("_higher").alias(f"higher_{s}"))
        out = out.join(every, (F.col(group) == F.col("_g")) & clean.eqNullSafe(F.col("_w"))).drop("_g", "_w")
    return out.select("*", *((F.col(f"higher_{s}") + 1).alias(f"place_{s}") for s in scores))


def item_places(df: DataFrame, group: str, item: str, scores: list[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """group, item, the scores, ``keep``, higher_<score>... and place_<score>... of every item of every group.

    Rows of one (group, item) are one record, of which the highest valid value
    of each score counts; null groups or items are left out. ``keep``: further
    aggregates by name.
    """
    best = [F.max(F.when(~F.isnan(s), F.col(s))).cast("double").alias(s) for s in scores]
    items = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(*best, *(c.alias(n) for n, c in (keep or {}).items()))
    return rank_places(items, group, item, scores)


def walk(higher: np.ndarray, damping: float, rounds: int, tolerance: float, group: np.ndarray | None = None) -> np.ndarray:
    """Stationary shares of the items of one group, or of many groups at once.

    ``higher``: items above each item, one column per score; ``group``: ascending
    numbers of the rows' groups. A step is a suffix sum over all rows in order
    of group and score, less what belongs to later groups.
    """
    n, scores = higher.shape
    group = np.zeros(n, np.int64) if group is None else group
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])[:n])
    of = np.cumsum(np.append(0, (group[1:] != group[:-1]).astype(np.int64)))[:n]
    size = np.diff(np.append(begin, n))
    stop = (begin + size)[of]
    plans = []
    for s in range(scores):
        order = np.lexsort((higher[:, s], group))
        h = higher[order, s]
        last = np.flatnonzero(np.append((h[1:] != h[:-1]) | (of[1:] != of[:-1]), True)[:n])
        below = last[np.searchsorted(last, np.arange(n))] + 1  # first row that is placed lower
        plans.append((order, h, below))
    start = (1 / size)[of]
    x = start.copy()
    for _ in range(rounds):
        y = np.zeros(n)
        for order, h, below in plans:
            xo = x[order]
            suffix = np.append(np.cumsum(np.where(h > 0, xo / np.maximum(h, 1), 0)[::-1])[::-1], 0)
            y[order] += suffix[below] - suffix[stop] + np.where(h == 0, xo, 0)
        y = (1 - damping) * start + damping * y / scores
        if np.add.reduceat(np.abs(y - x), begin).max() < tolerance:
            return y
        x = y
    return x


def rank_walk(
    df: DataFrame, group: str, item: str, scores: list[str], keep: dict[str, Column] | None = None, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-10, memory_items: int = MEMORY_ITEMS
) -> DataFrame:
    """group, item, ``keep``, place_<score>... and ``stationarity`` of every item of every group.

    Items and places are those of ``item_places``; a group of nulls or ties has
    equal shares. Groups beyond ``memory_items`` are walked by tables instead of
    in one task.
    """
    spark = df.sparkSession
    ship_package(spark)
    placed = settle(item_places(df, group, item, scores, keep), "places")
    large = placed.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > memory_items)
    many = large.limit(1).count() > 0
    small = placed.join(large, group, "left_anti") if many else placed
    names = [f"higher_{s}" for s in scores]
    columns = placed.columns

    def run(batches):
        """Whole groups, as many as come in a batch; the last one waits for its rest."""
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table):
            if table.num_rows:
                name = table.column(group).combine_chunks()
                number = np.append(0, np.cumsum(np.asarray(pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False), np.int64))) if len(name) > 1 else np.zeros(1, np.int64)
                higher = np.stack([np.asarray(table.column(c)) for c in names], axis=1)
                share = walk(higher, damping, rounds, tolerance, number)
                yield from table.append_column("stationarity", pa.array(share)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column(group)
            same = np.asarray(pc.equal(name, name[-1]).to_numpy(zero_copy_only=False), bool)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut or (held and held[-1].column(group)[-1] != name[-1]):
                yield from done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from done(pa.Table.from_batches(held))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema) + ", stationarity double"
    out = small.repartition(group).sortWithinPartitions(group).mapInArrow(run, schema)
    if many:
        out = out.unionByName(_walk_tables(placed.join(large, group), group, item, scores, damping, rounds, tolerance).select(*columns, "stationarity"))
    return out.drop(*names)


def _walk_tables(placed: DataFrame, group: str, item: str, scores: list[str], damping: float, rounds: int, tolerance: float) -> DataFrame:
    """The walk of groups that don't fit a task: each step adds up the shares by place, then sums over places in bins."""
    state = settle(placed.withColumn("stationarity", 1 / F.col("_n")), "walk")
    for _ in range(rounds):
        nxt = state.withColumn("_y", F.lit(0.0))
        for s in scores:
            h = F.col(f"higher_{s}")
            sent = state.where(h > 0).groupBy(group, "_n", h.alias("_h")).agg((F.sum("stationarity") / F.first(h)).alias("_m"))
            sent = sent.withColumn("_bin", F.floor(F.col("_h") * _BINS / F.col("_n")))
            after = Window.partitionBy(group).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
            base = sent.groupBy(group, "_bin").agg(F.sum("_m").alias("_in")).withColumn("_base", F.coalesce(F.sum("_in").over(after), F.lit(0.0))).select(group, "_bin", "_base")
            lower = Window.partitionBy(group, "_bin").orderBy(F.desc("_h")).rowsBetween(Window.unboundedPreceding, -1)
            got = sent.withColumn("_own", F.coalesce(F.sum("_m").over(lower), F.lit(0.0))).join(base, [group, "_bin"]).select(group, F.col("_h").alias(f"higher_{s}"), (F.col("_base") + F.col("_own")).alias("_got"))
            top = sent.groupBy(group).agg(F.sum("_m").alias("_all"))
            nxt = (
                nxt.join(got, [group, f"higher_{s}"], "left")
                .join(top, group, "left")
                .withColumn("_y", F.col("_y") + F.when(h == 0, F.coalesce("_all", F.lit(0.0)) + F.col("stationarity")).otherwise(F.coalesce("_got", F.lit(0.0))))
                .drop("_got", "_all")
            )
        nxt = nxt.withColumn("_new", (1 - damping) / F.col("_n") + damping * F.col("_y") / len(scores))
        state = settle(nxt.withColumn("_d", F.abs(F.col("_new") - F.col("stationarity"))).withColumn("stationarity", F.col("_new")).drop("_y", "_new"), "walk")
        far = state.groupBy(group).agg(F.sum("_d").alias("d")).agg(F.max("d")).first()[0]
        state = state.drop("_d")
        if far is None or far < tolerance:
            break
    return state


def first_of_group(df: DataFrame, group: str, item: str, order: list[Column], limit: str, salts: int = 16) -> DataFrame:
    """The first ``limit`` (a column) rows of every group, cut down within salted parts of the group first."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(salts)))
    part = Window.partitionBy(group, "_salt").orderBy(*order)
    whole = Window.partitionBy(group).orderBy(*order)
    cut = salted.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= F.col(limit))
    return cut.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= F.col(limit)).drop("_r", "_salt")
