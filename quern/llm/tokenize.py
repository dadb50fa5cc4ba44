"""Whole-corpus encoding with a byte-level BPE vocabulary.

Two tiers. Pre-tokens are hashed where they stand and looked up, all at once,
in a minimal perfect hash of the vocabulary. Those that miss are cut at the
byte pairs that no vocabulary entry contains (no merge can cross them), looked
up again, and what is left is merged with a heap over linked bytes, once per
distinct piece.
"""

from __future__ import annotations

import base64
import heapq
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import ship_package

from .chars import LETTER, OTHER, SPACE, U64, Hashes, class_table, codes, mix, ragged, slices

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_MEMO_LIMIT = 400_000


class MinimalPerfectHash:
    """Distinct 64-bit keys to 0..n-1 by hash and displace, with the keys kept for the membership test."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        bucket = (keys % U64(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(n, bool)
        self.keys = np.zeros(n, U64)
        sizes = np.diff(first)
        for b in np.argsort(-sizes, kind="stable"):
            own = keys[order[first[b] : first[b + 1]]]
            if len(own) == 0:
                break
            if len(own) == 1:
                break
            d, slot = self._fit(own, free)
            free[slot] = False
            self.keys[slot] = own
            self.shift[b] = d
        single = np.flatnonzero(sizes == 1)  # a bucket of one key names its slot itself
        spare = np.flatnonzero(free)[: len(single)]
        self.keys[spare] = keys[order[first[single]]]
        self.shift[single] = -spare - 1

    def _fit(self, own: np.ndarray, free: np.ndarray) -> tuple[int, np.ndarray]:
        """The first shift that sends all keys of a bucket to different free slots; 256 are tried at a time."""
        first = 1
        while True:
            shifts = np.arange(first, first + 256)
            slots = self._slot(own[None, :], shifts[:, None])
            for i in np.flatnonzero(free[slots].all(axis=1)):
                if len(set(slots[i].tolist())) == len(own):
                    return int(shifts[i]), slots[i]
            first += 256

    def _slot(self, keys: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix(keys + d.astype(U64) * U64(0x9E3779B97F4A7C15)) % U64(self.n)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not in the set."""
        d = self.shift[(keys % U64(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, self._slot(keys, d))
        return np.where(self.keys[slot] == keys, slot, -1)


class Vocabulary:
    """Ranks, the perfect hash over whole pre-tokens and the byte pairs that merges can cross."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        words, ids = [], []
        for word, rank in self.ranks.items():
            try:
                words.append(word.decode("utf-8"))
            except UnicodeDecodeError:
                continue
            ids.append(rank)
        a, offsets = codes(words)
        keys = Hashes(a).of(offsets[:-1], offsets[1:])
        self.hash = MinimalPerfectHash(keys)
        self.ids = np.zeros(len(ids), np.int32)
        self.ids[self.hash.find(keys)] = ids
        self.joins = np.zeros((256, 256), bool)
        for word in self.ranks:
            for x, y in zip(word, word[1:], strict=False):
                self.joins[x, y] = True

    def merge(self, piece: bytes) -> list[int]:
        """Byte-pair merges of one piece, lowest rank first, leftmost first among equals."""
        ranks = self.ranks
        n = len(piece)
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 1, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, m, e = heapq.heappop(heap)
            if end[i] != m or m >= n or end[m] != e:
                continue  # one of its halves has been merged since
            end[i], end[m] = e, -1
            nxt[i] = nxt[m]
            if e < n:
                prv[e] = i
                r = ranks.get(piece[i : end[e]])
                if r is not None:
                    heapq.heappush(heap, (r, i, e, end[e]))
            p = prv[i]
            if p >= 0:
                r = ranks.get(piece[p:e])
                if r is not None:
                    heapq.heappush(heap, (r, p, i, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


def token_starts(a: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks the first character of every pre-token.

    The split is the public one of this vocabulary: contractions, then runs of
    letters, of digits and of other signs, each with one space before it, then
    white space, whose last character stays with what follows.
    """
    n = len(a)
    cls = class_table()[a]
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    head = begin[:n]
    start = head.copy()
    start[1:] |= cls[1:] != cls[:-1]
    space = cls == SPACE
    last = np.zeros(n, bool)  # last white space of a run that something of the same text follows
    last[:-1] = space[:-1] & ~space[1:] & ~begin[1:n]
    start |= last
    joined = last & (a == 32)
    start[1:] &= ~joined[:-1]
    at = np.flatnonzero((a == 39) & start & (cls == OTHER))
    at = at[at + 1 < n]
    at = at[~begin[at + 1]]
    if len(at):
        c1 = a[at + 1]
        two = at + 2 < n
        c2 = np.where(two & ~begin[np.minimum(at + 2, n)], a[np.minimum(at + 2, n - 1)], 0)
        long = ((c2 == 101) & ((c1 == 114) | (c1 == 118))) | ((c1 == 108) & (c2 == 108))
        short = np.isin(c1, [115, 116, 109, 100])
        size = np.where(short, 1, np.where(long, 2, 0))
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        stop = at + 1 + size
        stop = stop[stop < n]
        start[stop[(cls[stop] == LETTER)]] = True
    return start


def encode(texts: list[str], vocab: Vocabulary, memo: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and how many each text has."""
    a, offsets = codes(texts)
    n = len(a)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    start = token_starts(a, offsets)
    h = Hashes(a)

    def look(st: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        en = np.append(st[1:], n)
        keys = h.of(st, en)
        return en, keys, vocab.hash.find(keys)

    st = np.flatnonzero(start)
    en, keys, slot = look(st)
    missed = np.flatnonzero((slot < 0) & (en - st > 1))
    if len(missed):
        inside = ragged(st[missed] + 1, en[missed] - st[missed] - 1)
        left, right = _last_byte(a[inside - 1]), _first_byte(a[inside])
        start[inside[~vocab.joins[left, right]]] = True
        st = np.flatnonzero(start)
        en, keys, slot = look(st)
    hit = slot >= 0
    counts = np.ones(len(st), np.int64)
    rest = np.flatnonzero(~hit)
    if len(rest):
        distinct, first, inverse = np.unique(keys[rest], return_index=True, return_inverse=True)
        if len(memo) > _MEMO_LIMIT:
            memo.clear()
        lists = []
        for key, i in zip(distinct.tolist(), rest[first].tolist(), strict=True):
            ids = memo.get(key)
            if ids is None:
                ids = memo[key] = vocab.merge(a[st[i] : en[i]].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8"))
            lists.append(ids)
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((x for ids in lists for x in ids), np.int32, int(size.sum()))
        at = np.cumsum(size) - size
        counts[rest] = size[inverse]
    place = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    out[place[hit]] = vocab.ids[slot[hit]]
    if len(rest):
        out[ragged(place[rest], counts[rest])] = flat[ragged(at[inverse], counts[rest])]
    total = np.append(0, np.cumsum(counts))
    bounds = total[np.searchsorted(st, offsets)]
    return out, np.diff(bounds)


def _first_byte(c: np.ndarray) -> np.ndarray:
    return np.where(c < 0x80, c, np.where(c < 0x800, 0xC0 | (c >> 6), np.where(c < 0x10000, 0xE0 | (c >> 12), 0xF0 | (c >> 18)))).astype(np.int64)


def _last_byte(c: np.ndarray) -> np.ndarray:
    return np.where(c < 0x80, c, 0x80 | (c & 0x3F)).astype(np.int64)


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str | None = None, out: str = "ids") -> DataFrame:
    """``key`` and the ids of ``text`` for every row of ``df``.

    Null and empty texts get the empty list; a null key stays null; repeated
    rows each give a row; other columns of ``df`` are not read. The vocabulary
    has a fixed size and goes to the workers as a broadcast.
    """
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(vocabulary or os.environ.get("QUERN_VOCABULARY", DEFAULT_VOCABULARY)))

    def run(batches):
        vocab, memo = shared.value, {}
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for i, j in slices(texts):
                ids, counts = encode(texts[i:j], vocab, memo)
                offsets = np.zeros(j - i + 1, np.int32)
                np.cumsum(counts, out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["_key", "_ids"]
                )

    kind = df.schema[key].dataType.simpleString()
    done = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, _ids array<int>")
    return done.select(F.col("_key").alias(key), F.col("_ids").alias(out))
