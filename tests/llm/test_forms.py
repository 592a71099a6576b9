"""One form for texts that look the same."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronostrata.llm import forms

WORDS = [("replaces", 9), ("слово", 7), ("control-panel", 3), ("naïve", 4), ("file", 5), ("cop", 5), ("сор", 6), ("й", 2)]
FORMER = forms.Former(WORDS)
PLAIN = forms.Former([])


@pytest.mark.parametrize("a,b", [
    ("replaces", "replаcеs"), ("replaces", "ｒｅｐｌａｃｅｓ"), ("replaces", "re​pla­ces"), ("file", "ﬁle"), ("naïve", "naïve"),
    ("a b", " a 　\t\n b "), ("K-12", "K‐12"), ("X‑22", "‍X-‍22"), ("слово", "cлoвo"), ("й", "й"), ("ё", "ë"),
    ("Ǻ", "Ǻ"), ("ộ", "ộ"), ("！", "!"), ("５", "5"), ("cop", "сор"),
])
def test_same(a, b):
    for f in (FORMER, PLAIN):
        assert f.text(a) == f.text(b)


@pytest.mark.parametrize("a,b", [
    ("Replaces", "replaces"), ("naïve", "naive"), ("m²", "m2"), ("a,b", "a;b"), ("ab", "a b"), ("K–12", "K-12"), ("x", "y"), ("O", "0"), ("l", "1"), ("½", "1/2"), ("ł", "l"), ("в", "b"), ("й", "и"), ("①", "1"),
])
def test_different(a, b):
    for f in (FORMER, PLAIN):
        assert f.text(a) != f.text(b)


def test_canonical_spelling_is_the_most_frequent_word():
    assert FORMER.text("cлoвo") == "слово" and FORMER.text("cop") == "сор" and FORMER.text("rеplaces") == "replaces"
    assert PLAIN.text("слово") == "cлoвo"  # by table: every look-alike becomes Latin


def test_nothing_visible_and_null():
    assert FORMER.text("​ ­﻿\t") == "" and FORMER.text("") == "" and FORMER.text(None) is None


ALPHABET = "abceорcxХХABВекı ﬁﬂ​̣́̈ éйё²-‐Ａ０Kмnнo"


@given(st.text(alphabet=ALPHABET, max_size=14), st.text(alphabet=ALPHABET, max_size=14))
@settings(max_examples=500, deadline=None)
def test_vocabulary_joins_and_parts_nothing(a, b):
    words = forms.Former([(forms.unicodedata.normalize("NFC", w), 2) for w in (*a.split(), "око", "oko") if w])
    assert (words.text(a) == words.text(b)) == (PLAIN.text(a) == PLAIN.text(b))


def brute_cost(a, b):
    same = lambda x, y: forms.DRAWN_LIKE.get(x, x) == forms.DRAWN_LIKE.get(y, y)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (not same(x, y))))
        row = now
    return row[-1]


def test_weighted_automaton_against_dynamic_programming():
    rng = random.Random(2)
    words = [("".join(rng.choice("abоoc") for _ in range(rng.randrange(1, 6))), rng.randrange(1, 9)) for _ in range(40)]
    trie = forms.Trie(words)
    count = dict()
    for w, n in words:
        count[w] = max(n, count.get(w, 0))
    for _ in range(300):
        token = "".join(rng.choice("abоoc​") for _ in range(rng.randrange(1, 6)))
        for most in (0, 1, 2):
            costs = {w: brute_cost(token.replace("​", ""), w) for w in count}
            near = [w for w in costs if costs[w] <= most]
            want = min(near, key=lambda w: (costs[w], -count[w], w)) if near else None
            assert trie.nearest(token, most) == want


def test_pairs(spark):
    rows = [(1, "The bell"), (2, "Тhe bell"), (3, "The  bell "), (4, "The bell"), (5, "the bell"), (6, None), (7, ""), (8, "​"), (None, "The bell"), (9, "x" * 9000), (10, "x" * 8999 + "х")]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string")  # repeated rows give no pairs of their own
    want = {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (9, 10)}
    got = [tuple(r) for r in forms.same_looking_pairs(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert forms.same_looking_pairs(df.limit(0), "doc_id", "text").count() == 0
    classes = sorted(tuple(r) for r in forms.same_looking_classes(df, "doc_id", "text").collect())
    assert classes == [(1, 1, 2), (2, 1, 3), (3, 1, 3), (4, 1, 2), (5, 5, 0), (9, 9, 1), (10, 9, 1)]
    assert forms.same_looking_classes(df.limit(0), "doc_id", "text").count() == 0


def test_a_hot_text_is_handled_in_parts(spark, monkeypatch):
    monkeypatch.setattr(forms, "HOT_ROWS", 50)
    df = spark.createDataFrame([(i, "hot text") for i in range(600)] + [(1000 + i, "hоt text") for i in range(3)] + [(2000 + i, f"text {i}") for i in range(900)], "doc_id long, text string")
    found = forms.looks(df, "doc_id", "text")
    assert found.hot.count() == 1 and found.salts > 20
    assert found.scattered(found.rows, "t", "s").where("s > 0").select("s").distinct().count() > 20
    assert forms.same_looking_pairs(df, "doc_id", "text").count() == 1800
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in forms.same_looking_classes(df, "doc_id", "text").collect()}
    assert len(got) == 1503 and got[5] == (0, 3) and got[1001] == (0, 600) and got[2007] == (2007, 0)


def test_copies_are_not_paired_with_each_other(spark):
    df = spark.createDataFrame([(i, "hot text") for i in range(3000)] + [(5000, "hоt text")], "doc_id long, text string")
    assert forms.same_looking_pairs(df, "doc_id", "text").count() == 3000


def test_vocabulary_counts_all_documents(spark):
    df = spark.createDataFrame([("тест test x1",), ("test teѕt",), (None,), ("тест",)], "text string")
    assert forms.vocabulary(df, "text") == [("test", 2), ("тест", 2)]
    assert forms.vocabulary(df, "text", 1) == [("test", 2)]


def test_skeleton_is_stable():
    for code in range(0x20, 0x3000):
        s = forms.by_table(chr(code))
        assert forms.by_table(s) == s and unicodedata.normalize("NFC", s) == s
