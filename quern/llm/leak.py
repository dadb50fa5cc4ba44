"""Held-out passages inside training documents, by a prefix-filtered join.

Of every ``window`` consecutive characters of a passage the rarest shingle (by
its count over the whole corpus) must stand in a document that contains the
window. Only these necessary shingles are looked for; where one is met, the
alignment must leave room for a whole window on both sides, and the passage is
then compared with the document's stretch of its own size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import ship_package

from .chars import Hashes, alnum_table, codes, slices

#: Characters of passages that go to the workers at once; more are done in blocks of this size.
BLOCK_CHARS = 4_000_000
_BITS = 22


def squeeze(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of the lower-cased texts end to end, and the offsets of the texts."""
    a, offsets = codes([t.lower() for t in texts])
    keep = alnum_table()[a]
    count = np.zeros(len(a) + 1, np.int64)
    np.cumsum(keep, out=count[1:])
    return a[keep], count[offsets]


def _grams(a: np.ndarray, offsets: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, position and text of every shingle that lies within one text."""
    h = Hashes(a).windows(q)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(h)]
    at = np.flatnonzero(np.arange(len(h)) + q <= offsets[1:][text])
    return h[at], at, text[at]


class Probe:
    """A set of hashes with a bit table in front of it."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.sorted & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that are in the set, and which of the set they are."""
        at = np.flatnonzero(self.table[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        if not len(self.sorted) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        ok = self.sorted[which] == h[at]
        return at[ok], which[ok]


def prefix_tokens(h: np.ndarray, item: np.ndarray, rarity: np.ndarray, span: int) -> np.ndarray:
    """Indexes of the shingles that are the rarest of some ``span`` in a row of one item."""
    chosen = set()
    order = np.lexsort((h, rarity))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    bounds = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else []
    for s, e in zip(bounds, [*bounds[1:], len(item)], strict=True):
        if e - s >= span:
            view = np.lib.stride_tricks.sliding_window_view(rank[s:e], span)
            chosen.update((s + np.arange(len(view)) + view.argmin(axis=1)).tolist())
    return np.array(sorted(chosen), np.int64)


def leaked(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, window: int = 60, shingle: int = 24) -> DataFrame:
    """``doc_key``, ``item_key`` and the longest shared stretch (``matched``) of every leak.

    A leak is a document that holds ``window`` consecutive characters of the
    passage, after lower-casing and dropping all but letters and digits. Null
    texts and passages shorter than ``window`` match nothing; null keys are
    left out; repeated rows give one row; the passages are taken in blocks of
    BLOCK_CHARS characters, the documents are never collected.
    """
    spark = docs.sparkSession
    ship_package(spark)
    passages = items.where(F.col(item_key).isNotNull() & (F.length(item_text) >= window)).select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).distinct()
    total = passages.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_CHARS)
    rows = docs.where(F.col(doc_key).isNotNull() & (F.length(doc_text) >= window)).select(F.col(doc_key).alias("d"), F.col(doc_text).alias("t"))
    kinds = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    out = spark.createDataFrame([], f"d {kinds[0]}, k {kinds[1]}, matched int")
    for block in range(blocks):
        own = passages.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == block).orderBy("k", "t").collect()
        out = out.unionByName(_block(rows, [r.k for r in own], [r.t for r in own], window, shingle, kinds))
    return out.groupBy("d", "k").agg(F.max("matched").alias("matched")).select(F.col("d").alias(doc_key), F.col("k").alias(item_key), "matched")


def _block(rows: DataFrame, keys: list, texts: list[str], window: int, q: int, kinds: tuple[str, str]) -> DataFrame:
    spark = rows.sparkSession
    body, bounds = squeeze(texts)
    h, at, item = _grams(body, bounds, q)
    every = spark.sparkContext.broadcast(Probe(h))

    def count(batches):
        total = np.zeros(len(every.value.sorted), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in slices(texts):
                a, offsets = squeeze(texts[i:j])
                total += np.bincount(every.value.find(_grams(a, offsets, q)[0])[1], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["gram", "n"])

    counts = rows.select("t").mapInArrow(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    known = np.zeros(len(every.value.sorted), np.int64)  # as many as the block has shingles
    for r in counts.collect():
        known[r.gram] = r.n
    rarity = known[np.searchsorted(every.value.sorted, h)]
    need = prefix_tokens(h, item, rarity, window - q + 1)
    order = need[np.argsort(h[need], kind="stable")]
    probe = Probe(h[order])
    first = np.append(np.searchsorted(h[order], probe.sorted), len(order))
    shared = spark.sparkContext.broadcast((probe, first, item[order], at[order] - bounds[item[order]], body, bounds))

    def search(batches):
        probe, first, items, places, body, bounds = shared.value
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            best: dict[tuple, int] = {}
            for i, j in slices(texts):
                a, offsets = squeeze(texts[i:j])
                g, pos, doc = _grams(a, offsets, q)
                where, which = probe.find(g)
                for p, d, w in zip(pos[where].tolist(), doc[where].tolist(), which.tolist(), strict=True):
                    lo, hi = int(offsets[d]), int(offsets[d + 1])
                    for x in range(first[w], first[w + 1]):
                        it, o = int(items[x]), int(places[x])
                        size = int(bounds[it + 1] - bounds[it])
                        left, right = min(o, p - lo), min(size - o, hi - p)
                        if left + right < window or best.get((ids[i + d], keys[it]), 0) >= size:
                            continue
                        base = int(bounds[it]) + o
                        same = np.flatnonzero(a[p - left : p + right] != body[base - left : base + right])
                        k = int(np.searchsorted(same, left))
                        run = (int(same[k]) if k < len(same) else left + right) - (int(same[k - 1]) + 1 if k else 0)
                        if run >= window:
                            pair = (ids[i + d], keys[it])
                            best[pair] = max(best.get(pair, 0), run)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in best], batch.schema.field(0).type), pa.array([y for _, y in best], _arrow(kinds[1])), pa.array(list(best.values()), pa.int32())], ["d", "k", "matched"]
            )

    return rows.mapInArrow(search, f"d {kinds[0]}, k {kinds[1]}, matched int")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
