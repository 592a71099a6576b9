"""Leaked passages against brute force; the embedding's and the hashing's properties; recall with edits."""

import random

import numpy as np
import pytest

from chronostrata.llm import leaks

WORDS = [f"w{i}" for i in range(60)]


def brute(docs, items, width):
    def windows(t):
        w = [x for token in (t or "").split() for x in leaks.words_of(token)]
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    held = {i: windows(t) for i, t in items if i is not None}
    return {(d, i) for d, t in docs if d is not None for i, w in held.items() if windows(t) & w}


def test_words():
    assert leaks.words_of("K-1378,") == ["k", "1378"] and leaks.words_of("_x_") == ["x"]
    assert leaks.words_of("В") == leaks.words_of("в") == leaks.words_of("B") and leaks.words_of("ＡＢ​С") == ["abc"]
    assert leaks.words_of("НОМЕР") == leaks.words_of("номер") and leaks.words_of("—") == []


@pytest.mark.parametrize("seed,held", [(1, None), (2, 0)])
def test_against_brute_force(spark, monkeypatch, seed, held):
    """With the items sent around, and with a join by bucket."""
    if held is not None:
        monkeypatch.setattr(leaks, "HELD", held)
    rng = random.Random(seed)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(0, 30)))) for i in range(10)] + [(90, None), (91, ""), (None, "w1 " * 30)]
    docs = []
    for d in range(150):
        body = text(rng.randrange(0, 60))
        if rng.random() < 0.6:
            src = rng.choice(items)[1] or ""
            words = src.split()
            n = rng.randrange(3, 14)
            at = rng.randrange(0, max(1, len(words) - n))
            part = words[at : at + n]
            if rng.random() < 0.3 and part:
                part.insert(rng.randrange(len(part)), "between")
            body[rng.randrange(0, len(body) + 1) : 0] = [p.upper() if rng.random() < 0.3 else p for p in part]
        docs.append((d, rng.choice([" ", " ", " , "]).join(body)))
    docs += [(1000, None), (1001, ""), (1002, "z " * 20_000 + items[3][1]), (None, items[3][1])] + docs[:20]
    want = brute(docs, items, 6)
    d = spark.createDataFrame(docs, "id long, text string")
    i = spark.createDataFrame(items + items[:2], "id long, text string")
    got = [tuple(r) for r in leaks.leaks(d, i, "id", "text", "id", "text", width=6).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert leaks.leaks(d.limit(0), i, "id", "text", "id", "text").count() == 0
    assert leaks.leaks(d, i.limit(0), "id", "text", "id", "text").count() == 0


def embed(walk, ids, hashes, trial):
    bits, at, out = walk.bits(hashes, trial), 0, []
    for j in range(walk.steps):
        w = ids[at] if at < walk.length else -1
        out.append(w)
        at += bits[j, w] if w >= 0 else 0
    return out


def test_embedding_keeps_small_distances_small():
    rng = np.random.default_rng(3)
    hashes = leaks.word_hashes([f"w{i}" for i in range(60)])
    near, far = [], []
    for trial in range(200):
        walk = leaks.Walk(20, 0)
        a = rng.integers(1, 58, 20)
        b = np.append(np.delete(a, 5), 58)
        c = rng.integers(1, 58, 20)
        ham = lambda x, y, walk=walk, trial=trial: sum(p != q for p, q in zip(embed(walk, x, hashes, trial), embed(walk, y, hashes, trial), strict=True))
        assert ham(a, a) == 0
        near.append(ham(a, b))
        far.append(ham(a, c))
    assert np.median(near) * 2 < np.median(far)


def test_signatures_follow_the_embedding():
    rng = np.random.default_rng(4)
    ids, walk, hashes = rng.integers(0, 5, 300), leaks.Walk(8, 1, 5, 7), leaks.word_hashes([f"w{i}" for i in range(5)])
    starts = np.arange(len(ids) - 8)
    for trial in range(walk.trials):
        sign = walk.signatures(ids, starts, hashes, trial)
        sampled = [tuple(np.array(embed(walk, ids[s : s + 9], hashes, trial))[walk.places(trial)]) for s in starts]
        assert len({(x, y) for x, y in zip(sign.tolist(), sampled, strict=True)}) == len(set(sign.tolist())) == len(set(sampled))


def distance(x, y):
    """Of y from the nearest beginning of x."""
    row = list(range(len(x) + 1))
    for i, p in enumerate(y, 1):
        now = [i]
        for j, q in enumerate(x, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (p != q)))
        row = now
    return min(row)


def test_exact_edit_verification():
    rng = np.random.default_rng(5)
    for limit in (0, 1, 2, 3):
        a, b = rng.integers(0, 3, (200, 6 + limit)), rng.integers(0, 3, (200, 6))
        want = [x[:6].tolist() == y.tolist() if not limit else distance(x, y) <= limit for x, y in zip(a, b, strict=True)]
        assert leaks.edit_distance_within(a, b, limit).tolist() == want


@pytest.mark.parametrize("edits,held,most", [(1, None, 20), (2, None, 60), (1, 0, 20)])
def test_recall_with_inserted_deleted_and_substituted_words(spark, monkeypatch, edits, held, most):
    """At the default width: of each kind at least nine in ten leaks are found, and nothing that isn't one."""
    if held is not None:
        monkeypatch.setattr(leaks, "HELD", held)
    rng = random.Random(edits)
    vocabulary = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(10))) for i in range(600)]
    docs = []
    for i, text in items:
        words = text.split()
        for _ in range(edits):
            at = rng.randrange(len(words))
            if i % 3 == 0:
                words.insert(at, rng.choice([*vocabulary, "strange"]))
            elif i % 3 == 1:
                del words[at]
            else:
                words[at] = rng.choice(["strange", rng.choice(vocabulary)])
        before, after = ([rng.choice(vocabulary) for _ in range(rng.choice([0, 7]))] for _ in range(2))
        docs.append((i, " ".join([*before, *words, *after])))
    assert 1 < leaks.planned(10, edits, 0.95, 20_240_101).trials <= most and leaks.planned(10, 0, 0.95, 1).trials == 1
    made = lambda rows: spark.createDataFrame(rows, "id long, text string").repartition(2)
    got = {tuple(r) for r in leaks.leaks(made(docs), made(items), "id", "text", "id", "text", max_edits=edits).collect()}
    near = lambda d, i: min(distance(w[s : s + 10 + edits], items[i][1].split()) for w in [docs[d][1].split()] for s in range(len(w)))
    assert all(near(d, i) <= edits for d, i in got)
    for kind in range(3):
        planted = {i for i, _ in items if i % 3 == kind}
        assert len({d for d, i in got if d == i} & planted) >= 0.9 * len(planted), kind
