"""Near-duplicate texts by a multi-index Hamming join over b-bit signatures.

A text is the multiset of its pairs of adjacent tokens. Its signature is a row
of ``symbols`` min-hashes of ``BITS`` bits each over that multiset. The row is
cut into chunks; every chunk gives one key for each choice of ``errors``
symbols that may differ (those are left out of the key). If two signatures
differ in at most (chunks x (errors + 1) - 1) symbols, one chunk differs in at
most ``errors`` by pigeonhole, so the two share a key: the join loses no pair
up to that distance. Eight chunks of four symbols with one error make it 15 of
32, and texts of equal size at the similarity 0.7 differ in 14.8 of 32 on
average. The low NARROW bits of these and 16 more symbols travel with the
keys, and the join itself keeps only pairs within ``reach`` on them; those are
then checked exactly on the texts.

Rows of a key that many texts have are spread over a triangle of cells, so
that no task joins more than about HOT_ROWS of them with each other.

Equal texts are searched once, under their least id.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.durable import settle
from quern.session import ship_package

from .chars import U64, Hashes, alnum_table, codes, mix, slices

BITS, NARROW = 16, 4
_GOLD = U64(0x9E3779B97F4A7C15)
#: Texts of one key that a task joins with each other; one in PROBE texts is counted to know which keys have more.
HOT_ROWS, PROBE = 2_000, 16
#: Keys have 48 bits; two that collide cost one more check of a pair.
_KEY_MASK = U64((1 << 48) - 1)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0 separates, 1 belongs to a run, 2 is a token of its own (U+4E00 to U+9FFF)."""
    table = alnum_table().astype(np.uint8)
    table[0x4E00:0xA000] = 2
    return table


def token_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, text, tokens): a 64-bit value for each adjacent pair of tokens that
    also counts how often the pair has come before in its text, the text it
    belongs to, and the number of tokens of every text. Sorted by text, value."""
    a, offsets = codes([t.lower() for t in texts])
    n = len(a)
    kind = _kinds()[a]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    one = kind == 1
    start, stop = kind == 2, kind == 2
    begins = one.copy()
    begins[1:] &= ~one[:-1] | edge[1:n]
    ends = one.copy()
    ends[:-1] &= ~one[1:] | edge[1:n]
    st, en = np.flatnonzero(start | begins), np.flatnonzero(stop | ends) + 1
    h = Hashes(a).of(st, en)
    text = np.searchsorted(offsets, st, side="right") - 1
    tokens = np.bincount(text, minlength=len(texts))
    same = text[1:] == text[:-1]
    pair = mix(h[:-1] * U64(3) + mix(h[1:]))[same]
    text = text[1:][same]
    if not len(pair):
        return pair, text, tokens
    order = np.lexsort((pair, text))
    pair, text = pair[order], text[order]
    at = np.arange(len(pair))
    new = np.append(True, (pair[1:] != pair[:-1]) | (text[1:] != text[:-1]))
    seen = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(pair + seen.astype(U64) * _GOLD), text, tokens


def signatures(texts: list[str], least_tokens: int, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the texts with enough tokens, and their signatures (uint16, one row each)."""
    pair, text, tokens = token_pairs(texts)
    keep = tokens[text] >= max(least_tokens, 2)
    pair, text = pair[keep], text[keep]
    if not len(pair):
        return np.zeros(0, np.int64), np.zeros((0, symbols), np.uint16)
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    out = np.empty((len(first), symbols), np.uint16)
    draws = np.random.default_rng(20240229).integers(1, 1 << 62, symbols, dtype=np.uint64)
    for k in range(symbols):
        x = pair * (draws[k] * U64(2) + U64(1))
        x ^= x >> U64(32)
        out[:, k] = mix(np.minimum.reduceat(x, first)) & U64(0xFFFF)
    return text[first], out


def chunk_keys(sig: np.ndarray, chunk: int, errors: int) -> np.ndarray:
    """All keys of every signature: one column for each chunk and each choice of left-out symbols."""
    columns = []
    for c in range(0, sig.shape[1], chunk):
        for kept in combinations(range(c, c + chunk), chunk - errors):
            key = np.full(len(sig), len(columns) + 1, U64)
            for s in kept:
                key = mix(key * _GOLD + sig[:, s].astype(U64))
            columns.append(key & _KEY_MASK)
    return np.stack(columns, axis=1)


def narrow(sig: np.ndarray) -> np.ndarray:
    """The low NARROW bits of every symbol, two symbols to a byte."""
    low = (sig & ((1 << NARROW) - 1)).astype(np.uint8)
    if low.shape[1] % 2:
        low = np.pad(low, ((0, 0), (0, 1)))
    return low[:, ::2] | (low[:, 1::2] << NARROW)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of symbols that differ between narrow signatures."""
    x = a ^ b
    return ((x & 15) != 0).sum(axis=1) + ((x >> NARROW) != 0).sum(axis=1)


def overlaps(left: list[str], right: list[str]) -> np.ndarray:
    """Common pairs of each two texts over the larger number of pairs."""
    n = len(left)
    a, ta, _ = token_pairs(left)
    b, tb, _ = token_pairs(right)
    value, text = np.concatenate([a, b]), np.concatenate([ta, tb])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    both = (value[1:] == value[:-1]) & (text[1:] == text[:-1])
    common = np.bincount(text[1:][both], minlength=n)
    most = np.maximum(np.bincount(ta, minlength=n), np.bincount(tb, minlength=n))
    return common / np.maximum(most, 1)


def near_duplicates(
    df: DataFrame, key: str, text: str, similarity: float = 0.7, least_tokens: int = 20, chunks: int = 8, chunk: int = 4, errors: int = 1, symbols: int = 48, reach: int = 29
) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs rep_a < rep_b, similarity of different texts that
    are alike, and rep, id of every text, rep being the least id with the same
    text.

    Null and short texts take no part; rows with a null key are left out;
    repeated rows count once; only ``key`` and ``text`` are read. The keys find
    every pair whose signatures differ in at most chunks * (errors + 1) - 1
    symbols and most beyond; ``reach`` is the largest distance checked on the
    texts.
    """
    spark = df.sparkSession
    ship_package(spark)
    symbols = max(symbols, chunks * chunk)
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull() & (F.length(text) >= least_tokens)).select(F.col(key).alias("id"), F.unhex(F.md5(text)).alias("same"), F.col(text).alias("text"))

    def sign(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices(texts):
                which, sig = signatures(texts[i:j], least_tokens, symbols)
                own = batch.slice(i, j - i).take(pa.array(which))
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("same"), _rows(sig)], ["id", "same", "sig"])

    signed = rows.mapInArrow(sign, f"id {kind}, same binary, sig binary")
    reps = settle(signed.groupBy("same").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "signatures")
    members = rows.select("id", "same").join(reps.select("same", "rep"), "same").select("rep", "id").distinct()

    words = [f"w{i}" for i in range(-(-symbols // 16))]  # 16 narrow symbols each

    def keyed(batches):
        for batch in batches:
            sig = _matrix(batch.column("sig"), symbols)
            keys = chunk_keys(sig[:, : chunks * chunk], chunk, errors)
            low = narrow(sig)
            low = np.ascontiguousarray(np.pad(low, ((0, 0), (0, 8 * len(words) - low.shape[1])))).view(np.int64)
            ids = np.repeat(np.arange(len(keys)), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), batch.column("rep").take(pa.array(ids)), *(pa.array(low[ids, i]) for i in range(len(words)))], ["key", "rep", *words])

    def keys_of(rows: DataFrame) -> DataFrame:
        return rows.select("rep", "sig").mapInArrow(keyed, f"key bigint, rep {kind}, " + ", ".join(f"{w} bigint" for w in words))

    probe = keys_of(reps.where(F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(PROBE)) == 0)).groupBy("key").agg((F.count("*") * PROBE).alias("n"))
    hot = settle(probe.where(F.col("n") > HOT_ROWS).select("key", F.least(F.lit(1 << 7), F.ceil(F.col("n") / HOT_ROWS)).cast("int").alias("parts")), "hot")
    keys = _spread(keys_of(reps), hot) if hot.limit(1).count() else keys_of(reps)
    a, b = keys.alias("a"), keys.alias("b")
    # cells off the diagonal join the rows of one part with those of another
    cell = F.shiftright("a.key", 48)
    parts, diagonal = F.shiftright(cell, 14).bitwiseAND(F.lit(127)) + 1, cell.bitwiseAND(F.lit(127)) == F.shiftright(cell, 7).bitwiseAND(F.lit(127))
    apart = (cell == 0) | diagonal | (_part(F.col("a.rep"), parts) != _part(F.col("b.rep"), parts))
    apart_by = reduce(add, (_symbols_apart(F.col(f"a.{w}"), F.col(f"b.{w}")) for w in words))
    near = (
        a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & apart & (apart_by <= reach))
        .select(F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b"))
        .repartition("rep_a")  # serves both the distinct and the next join
        .distinct()
    )

    texts = rows.select("id", "text")  # a repeated row repeats a pair, which the last step undoes
    checked = near.join(texts.select(F.col("id").alias("rep_a"), F.col("text").alias("text_a")), "rep_a").join(
        texts.select(F.col("id").alias("rep_b"), F.col("text").alias("text_b")), "rep_b"
    )

    def check(batches):
        for batch in batches:
            left, right = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            for i, j in slices([x + y for x, y in zip(left, right, strict=True)]):
                value = overlaps(left[i:j], right[i:j])
                at = pa.array(i + np.flatnonzero(value >= similarity - 1e-12))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep_a").take(at), batch.column("rep_b").take(at), pa.array(value[value >= similarity - 1e-12])], ["rep_a", "rep_b", "similarity"]
                )

    pairs = checked.select("rep_a", "rep_b", "text_a", "text_b").mapInArrow(check, f"rep_a {kind}, rep_b {kind}, similarity double")
    return pairs.groupBy("rep_a", "rep_b").agg(F.max("similarity").alias("similarity")), members


def _symbols_apart(a: Column, b: Column) -> Column:
    """How many of the 16 four-bit symbols of two words differ."""
    x = a.bitwiseXOR(b)
    any_bit = reduce(lambda u, v: u.bitwiseOR(v), (F.shiftrightunsigned(x, i) for i in range(1, NARROW)), x)
    return F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))


def _part(rep: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), rep), parts.cast("bigint"))


def _spread(keys: DataFrame, hot: DataFrame) -> DataFrame:
    """``keys`` with the rows of hot keys in the cells of their part: bits above the key hold parts - 1, row and column of the cell.

    Two rows of different parts meet in one cell, two of one part in the
    diagonal one and, where the join's condition bars them, in others.
    """
    own = _part(F.col("rep"), F.col("parts")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.col("key").bitwiseOR(F.shiftleft(((F.col("parts") - 1) * 16384 + F.least(own, other) * 128 + F.greatest(own, other)).cast("bigint"), 48)),
    )
    return keys.join(hot, "key", "left").select(F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(cells)).alias("key"), *(c for c in keys.columns if c != "key"))


def _rows(sig: np.ndarray) -> pa.Array:
    width = sig.shape[1] * sig.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(sig), [None, pa.py_buffer(np.ascontiguousarray(sig).tobytes())]).cast(pa.binary())


def _bytes(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1) if rows else np.zeros((0, 1), np.uint8)


def _matrix(column: pa.Array, symbols: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, symbols)
