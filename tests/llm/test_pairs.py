"""Near duplicates and similar vectors against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import neardup, vectors
from quern.llm.neardup import chunk_keys, distance, narrow, near_duplicates, overlaps, signatures, token_pairs
from quern.llm.spans import expand_pairs
from quern.llm.vectors import encode, search, similar_vectors, unit


def pairs_of(text):
    t = re.findall(r"[一-鿿]|[^\W_一-鿿]+", text.lower())
    return len(t), Counter(zip(t, t[1:], strict=False))


def brute_similar(texts, least=0.7):
    out = set()
    sets = {i: pairs_of(t) for i, t in texts.items() if t}
    for a, (na, x) in sets.items():
        for b, (nb, y) in sets.items():
            if a < b and na >= 20 and nb >= 20 and sum((x & y).values()) >= least * max(x.total(), y.total()) - 1e-9:
                out.add((a, b))
    return out


def test_token_pairs_count_like_the_definition():
    texts = ["A_b a-B 中文中文", "", "one", "x x x x"]
    pair, text, tokens = token_pairs(texts)
    assert tokens.tolist() == [pairs_of(t)[0] for t in texts]
    assert np.bincount(text, minlength=4).tolist() == [pairs_of(t)[1].total() for t in texts]
    assert len(set(pair[text == 3].tolist())) == 3  # repetitions differ


def test_overlaps_are_exact():
    a, b = "a b c d e f", "a b c x e f"
    assert overlaps([a, a], [b, a]).tolist() == [3 / 5, 1.0]


def test_pigeonhole_bound_holds():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, 40, dtype=np.uint16)
    for _ in range(200):
        other = base.copy()
        at = rng.choice(40, 15, replace=False)
        other[at] ^= 1 + rng.integers(0, 1 << 15, 15, dtype=np.uint16)
        keys = chunk_keys(np.stack([base, other]), 5, 1)
        assert (keys[0] == keys[1]).any()


def test_narrow_distance_counts_symbols():
    a = np.array([[1, 2, 3, 0x14]], np.uint16)
    b = np.array([[1, 7, 3, 0x24]], np.uint16)
    assert distance(narrow(a), narrow(b)).tolist() == [1]


def test_near_duplicates_match_brute_force(spark, prose):
    texts = {}
    for k in range(12):
        words = prose(60).split()
        texts[10 * k] = " ".join(words)
        for j in range(1, 4):
            w = list(words)
            for at in range(0, 60, max(1, 60 // (2 * j))):
                w[at] = f"edit{k}{j}{at}"
            texts[10 * k + j] = " ".join(w)
        texts[10 * k + 4] = texts[10 * k]
    texts |= {900: None, 901: "", 902: "too short to count", 903: "same " * 30, 904: "same " * 31}
    df = spark.createDataFrame([(k, v, "z") for k, v in texts.items()] * 2, "id long, content string, key string")
    pairs, members = near_duplicates(df, "id", "content")
    found = {tuple(r) for r in expand_pairs(pairs.selectExpr("rep_a as id_a", "rep_b as id_b"), members).distinct().collect()}
    expected = brute_similar(texts)
    assert found <= expected and len(found) >= 0.97 * len(expected) > 20
    pairs, members = near_duplicates(df.where("false"), "id", "content")
    assert pairs.count() == members.count() == 0


def test_signatures_are_the_same_in_any_batch(prose):
    texts = [prose(30) for _ in range(5)]
    _, together = signatures(texts, 20, 8)
    assert (together[3] == signatures(texts[3:4], 20, 8)[1][0]).all()


def brute_nearest(rows, k, floor):
    out = set()
    kinds = {(m, d) for _, _, m, d in rows.values()}
    for m, d in kinds:
        own = [(i, np.array(v, float)) for i, v, mm, dd in rows.values() if (mm, dd) == (m, d) and v and len(v) == d and np.isfinite(np.array(v, float)).all() and np.any(v)]
        for i, x in own:
            near = sorted(((-x @ y / np.linalg.norm(x) / np.linalg.norm(y), j) for j, y in own if j != i))[:k]
            out |= {(min(i, j), max(i, j)) for c, j in near if -c >= floor}
    return out


def test_similar_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, n = {}, 0
    for _ in range(30):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 14)):
            n += 1
            rows[n] = (n, (centre + 0.1 * rng.standard_normal(16)).astype(np.float32).tolist(), "m", 16)
    for v in ([1.0] * 16, None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15):
        for _ in range(15 if v == [1.0] * 16 else 1):
            n += 1
            rows[n] = (n, v, "m", 16)
    rows[n + 1] = (n + 1, [1.0] * 16, "other", 16)
    df = spark.createDataFrame([(*r, 0) for r in rows.values()] + [(*rows[1], 1)], "id long, v array<float>, model string, dim int, cosine int")
    out = similar_vectors(df, "id", "v", ["model"], "dim", 10, 0.9).collect()
    found = {(min(r.id, r.other), max(r.id, r.other)) for r in out}
    expected = brute_nearest(rows, 10, 0.9)
    assert len(found & expected) >= 0.98 * len(expected) and len(found - expected) <= 0.02 * len(expected)
    assert max(r.place for r in out) == 10
    assert similar_vectors(df.where("false"), "id", "v", ["model"], "dim", 10, 0.9).count() == 0


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(2)
    u, q = unit(rng.standard_normal((400, 64))), unit(rng.standard_normal((50, 64)))
    codes, scalars = encode(u)
    ids = np.arange(400)
    a, b, c = search(ids, u, codes, scalars, 1000 + np.arange(50), q, 5, -1.0)
    exact = q @ u.T
    hits = sum(len(set(b[a == 1000 + i].tolist()) & set(np.argsort(-exact[i])[:5].tolist())) for i in range(50))
    assert hits >= 0.97 * 250 and np.allclose(c, exact[a - 1000, b])


@pytest.mark.parametrize("shape", ["gauss", "clusters", "plane"])
def test_recall_without_a_floor(spark, shape, monkeypatch):
    """Recall of the ids divisible by 20 against all rows, with an index of many cells fitted on part of the rows."""
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", 2_000)
    monkeypatch.setattr(vectors, "CELL_ROWS", 100)
    rng = np.random.default_rng(3)
    n = 6_000
    x = {"gauss": lambda: rng.standard_normal((n, 32)), "clusters": lambda: rng.standard_normal((300, 32))[rng.integers(0, 300, n)] + 0.7 * rng.standard_normal((n, 32)), "plane": lambda: rng.standard_normal((n, 8)) @ rng.standard_normal((8, 32))}[shape]()
    df = spark.createDataFrame([(i, v, "m", 32) for i, v in enumerate(x.astype(np.float32).tolist())], "id long, v array<float>, model string, dim int")
    found = {(r.id, r.other) for r in similar_vectors(df, "id", "v", ["model"], "dim", 10, asking=F.col("id") % 20 == 0).collect()}
    u = unit(x.astype(np.float32))
    ask = np.arange(0, n, 20)
    cosine = u[ask] @ u.T
    cosine[np.arange(len(ask)), ask] = -2
    best = np.argsort(-cosine, axis=1)[:, :10]
    expected = {(int(i), int(j)) for i, js in zip(ask, best, strict=True) for j in js}
    assert len(found & expected) >= 0.93 * len(expected) and {i for i, _ in found} == set(ask.tolist())


def test_index_is_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 16))[rng.integers(0, 40, 800)] + 0.3 * rng.standard_normal((800, 16))
    df = spark.createDataFrame([(i, v, "m", 16) for i, v in enumerate(x.astype(np.float32).tolist())], "id long, v array<float>, model string, dim int")

    def found():
        return {(r.id, r.other, r.place) for r in similar_vectors(df, "id", "v", ["model"], "dim", 5).collect()}

    sent = found()
    monkeypatch.setattr(vectors, "CELL_BYTES", 0)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 16 * 8 * 50)
    assert len(sent) == 4000 and len(found() ^ sent) <= 80


@pytest.mark.parametrize(("similarity", "least"), [(0.70, 0.96), (0.72, 0.97), (0.75, 0.98), (0.8, 0.99)])
def test_recall_of_keys_and_narrow_check_by_band(similarity, least):
    """Pairs at just this similarity that share a key and stay within reach."""
    rng = np.random.default_rng(6)
    left, right = [], []
    for _ in range(1500):
        words = [f"w{x}" for x in rng.integers(1 << 40, size=101)]
        kept = round(100 * similarity) + 1
        left.append(" ".join(words))
        right.append(" ".join([*words[:kept], *(f"w{x}" for x in rng.integers(1 << 40, size=101 - kept))]))
    (_, a), (_, b) = signatures(left, 20, 48), signatures(right, 20, 48)
    found = (chunk_keys(a[:, :32], 4, 1) == chunk_keys(b[:, :32], 4, 1)).any(axis=1) & (distance(narrow(a), narrow(b)) <= 29)
    assert found.mean() >= least


def test_hot_keys_are_spread_and_lose_no_pair(spark, prose, monkeypatch):
    base = prose(40)
    texts = {i: f"{base} extra{i}" for i in range(60)} | {100 + i: prose(30) for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), "id long, content string")
    expected = brute_similar(texts)
    for rows in (2_000, 8):
        monkeypatch.setattr(neardup, "HOT_ROWS", rows)
        monkeypatch.setattr(neardup, "PROBE", 1)
        pairs, _ = near_duplicates(df, "id", "content")
        found = [(r.rep_a, r.rep_b) for r in pairs.collect()]
        assert len(found) == len(set(found)) and set(found) == expected and len(expected) >= 60 * 59 // 2
