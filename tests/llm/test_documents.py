"""Tokenizing, leaks and shared spans against brute force."""

import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.chars import Hashes, codes
from quern.llm.leak import leaked, squeeze
from quern.llm import spans as spans_module
from quern.llm.spans import expand_pairs, shared_share, shared_spans, winnow
from quern.llm.tokenize import DEFAULT_VOCABULARY, Vocabulary, encode, encode_texts


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary()


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as p

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(DEFAULT_VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["", " ", "\n\n", "don't we'll I've 're 'tis x's  's 'S", "  a  b\n\n c \t d  ", "''s a' é'll", "🙂🙂 日本語の'd カタカナー", "it's\n'll", "12ab３４ ½", "<|endoftext|>", "a" * 500, "\x1c y\u3000z"]


def test_encoding_is_the_public_one(vocabulary, public):
    ids, counts = encode(HARD, vocabulary, {})
    at = 0
    for text, n in zip(HARD, counts, strict=True):
        assert ids[at : at + n].tolist() == public.encode_ordinary(text), text
        at += n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_encoding_of_any_text(vocabulary, public, texts):
    ids, counts = encode(texts, vocabulary, {})
    assert ids.tolist() == [i for t in texts for i in public.encode_ordinary(t)]
    assert counts.tolist() == [len(public.encode_ordinary(t)) for t in texts]


def test_perfect_hash_is_minimal_and_rejects_others(vocabulary):
    h = vocabulary.hash
    assert sorted(h.find(h.keys).tolist()) == list(range(h.n))
    assert (h.find(h.keys + 1) < 0).sum() > h.n - 5


def test_encode_texts_of_null_empty_and_repeated_rows(spark):
    rows = [(1, "a b", 9), (1, "a b", 9), (2, None, 9), (3, "", 9), (None, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _ids int")
    out = sorted(encode_texts(df, "doc_id", "text").collect(), key=str)
    assert len(out) == 5 and [r.ids for r in out if r.doc_id in (2, 3)] == [[], []]
    assert encode_texts(df.where("false"), "doc_id", "text").count() == 0


def test_equal_substrings_have_equal_hashes():
    a, _ = codes(["abcabcxabc"])
    h = Hashes(a).windows(3)
    assert h[0] == h[3] == h[7] and len(set(h.tolist())) == len({"abcabcxabc"[i : i + 3] for i in range(8)})


def test_winnow_gives_every_long_match_a_common_anchor(prose):
    shared = prose(60)[:200]
    a, b = prose(30) + shared + prose(40), prose(50) + shared + prose(10)
    t, _, h = winnow([a, b], 100, 101)
    assert set(h[t == 0].tolist()) & set(h[t == 1].tolist())


def brute_spans(texts: dict, least: int) -> set:
    grams: dict[str, set] = {}
    for i, t in texts.items():
        for k in range(len(t or "") - least + 1):
            grams.setdefault(t[k : k + least], set()).add(i)
    return {(min(a, b), max(a, b)) for s in grams.values() for a in s for b in s if a != b}


def test_shared_spans_match_brute_force(spark, prose):
    shared, other = prose(50)[:230], prose(50)[:199]
    texts = {1: prose(20) + shared + prose(20), 2: shared + prose(30), 3: prose(30) + other, 4: other + prose(30), 5: None, 6: "", 7: "a" * 300, 8: "b" + "a" * 250, 9: prose(20) + shared + prose(20)}
    texts[9] = texts[1]
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()] + [(1, texts[1], "x")], "id long, text string, rep string")
    spans, members = shared_spans(df, "id", "text", 200)
    found = {tuple(r) for r in expand_pairs(spans.select("id_a", "id_b").distinct(), members).collect()}
    assert found == brute_spans(texts, 200)
    share = {r.id: r for r in shared_share(spans, members).collect()}
    assert share[2].shared_chars == 230 and share[1].copies == 1 and share[1].shared_chars == share[1].n_chars and share[4].shared_chars == 0
    spans, members = shared_spans(df.where("false"), "id", "text", 200)
    assert spans.count() == members.count() == 0


def test_leaks_match_brute_force(spark, prose):
    passages = {i: prose(14) for i in range(1, 7)} | {7: None, 8: "short", 9: None}
    passages[9] = passages[1]
    docs = {1: prose(40) + " " + passages[1].upper() + prose(5), 2: prose(5) + passages[2][10:95].replace(" ", "-") + prose(5), 3: passages[3][:50], 4: prose(80), 5: None, 6: "", 7: passages[4]}
    d = spark.createDataFrame([(k, v, 1) for k, v in docs.items()] * 2, "doc_id long, text string, matched int")
    i = spark.createDataFrame(list(passages.items()), "item_id long, passage string")
    found = {(r.doc_id, r.item_id) for r in leaked(d, "doc_id", "text", i, "item_id", "passage").collect()}

    def flat(t):
        return "".join(c for c in (t or "").lower() if c.isalnum())

    expected = {(a, b) for a, t in docs.items() for b, p in passages.items() if any(flat(p)[k : k + 60] in flat(t) for k in range(len(flat(p)) - 59))}
    assert found == expected and len(expected) >= 4
    assert leaked(d, "doc_id", "text", i.where("false"), "item_id", "passage").count() == 0
    assert leaked(d.where("false"), "doc_id", "text", i, "item_id", "passage").count() == 0


def test_squeeze_keeps_letters_and_digits():
    a, offsets = squeeze(["A-b c!", "", "中 1"])
    assert a.tobytes().decode("utf-32-le") == "abc中1" and offsets.tolist() == [0, 3, 3, 5]


@pytest.mark.parametrize("rows", [2_000, 3])
def test_hot_hashes_and_runs_of_one_character(spark, prose, monkeypatch, rows):
    monkeypatch.setattr(spans_module, "HOT_ROWS", rows)
    monkeypatch.setattr(spans_module, "PROBE", 1)
    shared = prose(60)[:260]
    texts = {i: prose(15) + shared + prose(15) for i in range(12)}
    texts |= {20: prose(5) + "." * 150 + shared[:90] + prose(5), 21: prose(5) + "." * 230 + shared[:90] + prose(5), 22: prose(5) + shared[:90] + "." * 130 + prose(5), 23: prose(5) + shared[:90] + "." * 260 + prose(5)}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    spans, members = shared_spans(df, "id", "text", 200)
    found = [tuple(r) for r in expand_pairs(spans.select("id_a", "id_b").distinct(), members).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_spans(texts, 200)
