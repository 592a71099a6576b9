"""Token ids against the public tokenizer, and the rank queue against a heap."""

import heapq
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronostrata.llm import bpe

PATH = bpe.tokenizer_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary.load(PATH))


def test_rank_queue_gives_least_rank_then_leftmost():
    rng = random.Random(1)
    for size in (1, 63, 64, 65, 5000, 300_000):
        q, heap = bpe.RankQueue(size), []
        for _ in range(3000):
            if heap and rng.random() < 0.5:
                assert q.pop() == heapq.heappop(heap)
            else:
                x = (rng.randrange(min(size, 200)) * (size // min(size, 200)), rng.randrange(1000))
                q.push(*x)
                heapq.heappush(heap, x)
        while heap:
            assert q.pop() == heapq.heappop(heap)
        assert q.pop() is None and not any(any(words) for words in q.levels)


@given(st.text(max_size=200))
@settings(max_examples=400, deadline=None)
def test_any_text(encoder, public, text):
    assert encoder.encode(text) == public(text)


@pytest.mark.parametrize("text", ["", " ", "\n\n  x", "it's I'LL don't", "<|endoftext|> is text", "a" * 20_000, "ab" * 5000 + "​", "=" * 3000, "Übungssimulator übergibt 5152 m²", "группа замеров", "👩‍👩‍👧‍👦" * 50, " " * 1000])
def test_hard_texts(encoder, public, text):
    assert encoder.encode(text) == public(text)


def test_long_repetitive_pre_token_is_not_quadratic(encoder):
    import time

    t = time.perf_counter()
    got = encoder.piece("lorem" * 100_000)
    assert len(got) < 500_000 and time.perf_counter() - t < 30


def test_column(spark, public):
    rows = [(1, "The signal tower"), (2, None), (3, ""), (4, "The signal tower"), (None, "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r["ids"] for r in df.select("doc_id", bpe.token_ids(spark, F.col("text")).alias("ids")).collect()}
    assert got == {k: public(t) if t else [] for k, t in rows}
    assert df.limit(0).select(bpe.token_ids(spark, F.col("text"))).count() == 0
