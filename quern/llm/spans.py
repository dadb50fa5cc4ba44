"""Long exact stretches that documents share, by seed and extend.

Every document gives the anchors of its text: the k-character windows whose
hash is the least of some w windows in a row. Two texts that share k + w - 1
characters share an anchor, so a join on anchor hashes misses no stretch of
``least`` = k + w - 1 characters. Of the ``least`` characters around a shared
anchor at least half of what is beyond it lies on one side, so the join is on
the anchor with that half before it and on the anchor with that half after it:
a passage that many texts share, but that is too short, joins nothing. Each
joined pair is extended along the diagonals of its seeds and only true repeats
of ``least`` characters stay.

Texts that are equal are searched once and expanded at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.durable import settle
from quern.session import ship_package

from .chars import Hashes, codes, slices

#: Seeds of one hash that a task joins with each other; one in PROBE texts is counted to know which hashes have more.
HOT_ROWS, PROBE = 2_000, 16
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, w: int, op: np.ufunc, fill: np.uint64) -> np.ndarray:
    """op over every w values in a row, in three passes whatever w is."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, fill, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = op.accumulate(rows, axis=1).reshape(-1)
    back = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(back[:n], ahead[w - 1 : w - 1 + n])


def winnow(texts: list[str], k: int, w: int, side: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the texts: index of the text, position in it, hash.

    With ``side``, each anchor gives a hash with ``side`` characters before it
    and one with as many after it, where the text has them.

    Of a run of neighbouring anchors with one hash (a text that repeats a
    character) the first and the last are kept, so that runs of different
    length are seeded where they begin and where they end.
    """
    a, offsets = codes(texts)
    none = np.zeros(0, np.int64)
    if len(a) < k + w - 1:
        return none, none, np.zeros(0, np.uint64)
    hashes = Hashes(a)
    h = hashes.windows(k)
    ends = offsets[1:]
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))[: len(h)]
    h = np.where(np.arange(len(h)) + k <= ends[text], h, _TOP)
    if len(h) < w:
        return none, none, np.zeros(0, np.uint64)
    least = _sliding(h, w, np.minimum, _TOP)
    edge = np.zeros(w - 1, np.uint64)
    picked = _sliding(np.concatenate([edge, least, edge]), w, np.maximum, np.uint64(0))
    keep = (picked == h) & (h != _TOP)
    tied = (h[1:] == h[:-1]) & keep[1:] & keep[:-1] & (text[1:] == text[:-1])
    keep[1:-1] &= ~(tied[:-1] & tied[1:])
    at = np.flatnonzero(keep)
    if not side:
        return text[at], at - offsets[text[at]], h[at]
    before, after = at[at - side >= offsets[text[at]]], at[at + k + side <= ends[text[at]]]
    values = np.concatenate([hashes.of(before - side, before + k), ~hashes.of(after, after + k + side)])
    both = np.concatenate([before, after])
    order = np.argsort(both, kind="stable")
    both = both[order]
    return text[both], both - offsets[text[both]], values[order]


def repeats(a: np.ndarray, b: np.ndarray, seeds: set[int], least: int) -> list[tuple[int, int, int]]:
    """Maximal equal stretches of at least ``least`` on the diagonals of the seeds: start in a, start in b, length."""
    out = []
    for d in seeds:  # d = position in a - position in b
        i, j = max(d, 0), max(-d, 0)
        n = min(len(a) - i, len(b) - j)
        if n < least:
            continue
        same = np.zeros(n + 2, np.int8)
        same[1:-1] = a[i : i + n] == b[j : j + n]
        turn = np.diff(same)
        st, en = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        out += [(int(i + s), int(j + s), int(e - s)) for s, e in zip(st, en, strict=True) if e - s >= least]
    return sorted(out)


def shared_spans(df: DataFrame, key: str, text: str, least: int = 200, anchor: int | None = None, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """(spans, members) of the texts of ``df``.

    ``spans``: id_a < id_b, start_a, start_b, length of every maximal repeat
    between two different texts, each text standing for its copies under their
    least key. ``members``: rep, id, n_chars of every text of at least
    ``least`` characters, rep being the least key with the same text.

    Null, empty and short texts take no part; rows with a null key are left
    out; repeated rows count once; only ``key`` and ``text`` are read.
    """
    spark = df.sparkSession
    ship_package(spark)
    k = anchor or least // 2
    w = least - k + 1

    def anchors(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for i, j in slices(texts):
                t, pos, h = winnow(texts[i:j], k, w, -(-(w - 1) // 2))
                bounds = np.searchsorted(t, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(h.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(pos.astype(np.int32))),
                    ],
                    ["id", "same", "hash", "pos"],
                )

    rows = df.where(F.col(key).isNotNull() & (F.length(text) >= least)).select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    hashed = rows.select("id", F.unhex(F.md5("text")).alias("same"), "text")
    found = hashed.mapInArrow(anchors, f"id {kind}, same binary, hash array<bigint>, pos array<int>")
    reps = settle(found.groupBy("same").agg(F.min("id").alias("rep"), F.first("hash").alias("hash"), F.first("pos").alias("pos")), "anchors")
    members = hashed.select("id", "same", F.length("text").alias("n_chars")).join(reps.select("same", "rep"), "same").select("rep", "id", "n_chars").distinct()

    seeds = reps.select("rep", F.explode(F.arrays_zip("hash", "pos")).alias("s")).select("rep", F.col("s.hash").alias("hash"), F.col("s.pos").alias("pos"))
    some = seeds.where(F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(PROBE)) == 0).groupBy("hash").agg((F.count("*") * PROBE).alias("n")).where(F.col("n") > HOT_ROWS)
    hot = settle(some.select("hash", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("parts")), "hot")
    meet = _meet(seeds, hot) if hot.limit(1).count() else _join_seeds(seeds, ["hash"])
    pairs = meet.groupBy("id_a", "id_b").agg(F.collect_set("diagonal").alias("diagonals"))
    # rows of one key are one record; a caller who knows that keys are unique saves this shuffle of whole texts
    texts = rows if unique else rows.groupBy("id").agg(F.first("text").alias("text"))
    joined = pairs.join(texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a").join(
        texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b"
    )

    def extend(batches):
        for batch in batches:
            out = ([], [], [], [], [])
            ids_a, ids_b, diagonals = (batch.column(n).to_pylist() for n in ("id_a", "id_b", "diagonals"))
            for x, y, ds, ta, tb in zip(ids_a, ids_b, diagonals, batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                for span in repeats(codes([ta])[0], codes([tb])[0], set(ds), least):
                    for column, value in zip(out, (x, y, *span), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.schema.field("id_a").type), pa.array(out[1], batch.schema.field("id_b").type), *(pa.array(c, pa.int32()) for c in out[2:])],
                ["id_a", "id_b", "start_a", "start_b", "length"],
            )

    spans = joined.select("id_a", "id_b", "diagonals", "text_a", "text_b").mapInArrow(extend, f"id_a {kind}, id_b {kind}, start_a int, start_b int, length int")
    return spans, members


def _join_seeds(seeds: DataFrame, on: list[str], also: Column | None = None) -> DataFrame:
    a, b = seeds.alias("a"), seeds.alias("b")
    cond = F.col("a.rep") < F.col("b.rep")
    for c in on:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, cond & also if also is not None else cond).select(F.col("a.rep").alias("id_a"), F.col("b.rep").alias("id_b"), (F.col("a.pos") - F.col("b.pos")).alias("diagonal"))


def _meet(seeds: DataFrame, hot: DataFrame) -> DataFrame:
    """Pairs of seeds with one hash; the seeds of hot hashes are spread over a triangle of cells, where two parts meet in one cell."""
    own = F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("parts").cast("bigint")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(F.least("part", other).alias("row"), F.greatest("part", other).alias("column")))
    spread = seeds.join(hot, "hash").withColumn("part", own).select("hash", "rep", "pos", "part", F.explode(cells).alias("cell")).select("hash", "rep", "pos", "part", "cell.row", "cell.column")
    within = (F.col("a.row") == F.col("a.column")) | (F.col("a.part") != F.col("b.part"))
    return _join_seeds(seeds.join(hot, "hash", "left_anti"), ["hash"]).unionByName(_join_seeds(spread, ["hash", "row", "column"], within))


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of ids behind pairs of representatives, and the pairs of copies: id_a < id_b."""
    ma = members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    mb = members.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    across = pairs.select(F.col("id_a").alias("rep_a"), F.col("id_b").alias("rep_b")).join(ma, "rep_a").join(mb, "rep_b").select("x", "y")
    copied = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    own = members.join(copied, "rep", "left_semi").select("rep", "id")
    within = own.select("rep", F.col("id").alias("x")).join(own.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    both = across.where("x <> y").unionByName(within)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def shared_share(spans: DataFrame, members: DataFrame) -> DataFrame:
    """id, n_chars, copies, partners, shared_chars: how much of every text stands in another one too.

    A text with copies is shared whole. Overlapping stretches count once.
    """
    sides = spans.select(F.col("id_a").alias("rep"), F.col("id_b").alias("other"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e")).unionByName(
        spans.select(F.col("id_b").alias("rep"), F.col("id_a").alias("other"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("length")).alias("e"))
    )
    from pyspark.sql import Window

    before = Window.partitionBy("rep").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        sides.select("rep", "s", "e")
        .distinct()
        .withColumn("upto", F.coalesce(F.max("e").over(before), F.lit(0)))
        .groupBy("rep")
        .agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "upto"))).cast("int").alias("shared"))
    )
    partners = sides.groupBy("rep").agg(F.countDistinct("other").cast("int").alias("partners"))
    groups = members.groupBy("rep").agg(F.count("*").cast("int").alias("copies"))
    return (
        members.join(groups, "rep")
        .join(covered, "rep", "left")
        .join(partners, "rep", "left")
        .select(
            "id",
            "n_chars",
            (F.col("copies") - 1).alias("copies"),
            F.coalesce("partners", F.lit(0)).alias("partners"),
            F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0))).alias("shared_chars"),
        )
    )
