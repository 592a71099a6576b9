"""Range-sorted scans with carried state: islands, as-of, stretches, running maxima; against brute force."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from chronostrata.operators import asof, axis, islands, rangescan

DAY = 86_400_000_000
T0 = datetime(2021, 1, 1)


def skewed(rng, keys=("hot", "hot", "hot", "a", "b", "ü")):
    return rng.choice(keys)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_islands(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        k, s, n = skewed(rng), rng.randrange(0, 500), rng.choice([-2, 0, 1, 2, 3, 40 if rng.random() < 0.05 else 1, None if rng.random() < 0.02 else 2])
        end = None if n is None else T0 + timedelta(days=s + n)
        rows += [(k if rng.random() > 0.03 else None, T0 + timedelta(days=s) if rng.random() > 0.03 else None, end if rng.random() > 0.003 else datetime(9999, 12, 31), rng.random())] * rng.choice([1, 1, 2])
    df = spark.createDataFrame(rows, "kind string, s timestamp_ntz, e timestamp_ntz, key double")
    want, by = set(), {}
    for k, s, e, _ in rows:
        if k is not None and s is not None and (e is None or e > s):
            by.setdefault(k, []).append((s, datetime.max if e is None or e.year == 9999 else e))
    for k, v in by.items():
        merged = []
        for s, e in sorted(v):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want |= {(k, "period", s, None if e == datetime.max else e) for s, e in merged}
        want |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:], strict=False)}
    moment = lambda us: None if us is None else datetime(1970, 1, 1) + timedelta(microseconds=us)
    found = islands.periods_and_gaps(df, ["kind"], "s", "e").collect()
    got = [(r[0], r[1], moment(r["from_us"]), moment(r["until_us"])) for r in found]
    assert len(got) == len(set(got)) and set(got) == want


def test_islands_of_composite_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "x", T0, T0 + timedelta(1)), (1, "x", T0 + timedelta(1), None), (2, "x", T0, T0 + timedelta(1))], "a int, b string, s timestamp_ntz, e timestamp_ntz")
    got = islands.periods_and_gaps(df, ["a", "b"], "s", "e")
    assert {(r["a"], r["b"], r["until_us"] is None) for r in got.collect()} == {(1, "x", True), (2, "x", False)}
    assert islands.periods_and_gaps(df.limit(0), ["a", "b"], "s", "e").count() == 0


def test_segmented_cummax():
    assert islands.segmented_cummax(np.array([5, 1, 2**63 - 1, 0, 3, 2]), np.array([0, 0, 0, 1, 1, 1])).tolist() == [5, 5, 2**63 - 1, 0, 3, 3]


def test_previous_later():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(0, 60))
        until, seg = rng.integers(0, 20, n), np.sort(rng.integers(0, 3, n))
        got = asof.previous_later(until, seg)
        for i in range(n):
            want = next((j for j in range(i - 1, -1, -1) if seg[j] == seg[i] and until[j] > until[i]), -1)
            assert got[i] == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_of(spark, seed):
    rng = random.Random(seed)
    versions, events = [], []
    for i in range(150):
        f = rng.choice([rng.randrange(0, 200), rng.randrange(0, 200), None])
        versions += [(i, skewed(rng) if rng.random() > 0.05 else None, f, None if f is None or rng.random() < 0.1 else f + rng.choice([-1, 0, 1, 3, 10, 60, 150]), f"v{i}")] * rng.choice([1, 1, 2])
    for i in range(250):
        events.append((i, skewed(rng, ("hot", "hot", "a", "b", "ü", "none", None)), rng.choice([rng.randrange(-5, 260), rng.randrange(0, 200), None]), f"e{i}"))
    want = set()
    for i, k, t, _ in events:
        held = [(f, v) for v, k2, f, u, _ in versions if k is not None and k2 == k and f is not None and t is not None and f <= t and (u is None or t < u)]
        want.add((i, max(held)[1] if held else None))
    e = spark.createDataFrame(events, "id long, k string, t long, tag string")
    v = spark.createDataFrame(versions, "id long, k string, f long, u long, tag string")
    left = asof.as_of(e, v, ["k"], "t", "f", "u", "id")
    assert left.columns == ["id", "k", "t", "tag", "id_1", "f", "u", "tag_1"]
    got = left.collect()
    assert len(got) == len(events) and {(r["id"], r["id_1"]) for r in got} == want
    assert all(r["tag_1"] == (None if r["id_1"] is None else f"v{r['id_1']}") and r["tag"] == f"e{r['id']}" for r in got)
    inner = asof.as_of(e, v, ["k"], "t", "f", "u", "id", "inner", ["id"], ["id"])
    assert {tuple(r) for r in inner.collect()} == {x for x in want if x[1] is not None}
    assert asof.as_of(e.limit(0), v, ["k"], "t", "f", "u", "id").count() == 0
    assert {r["id_1"] for r in asof.as_of(e, v.limit(0), ["k"], "t", "f", "u", "id").collect()} == {None}


def test_as_of_carries_nested_versions_over_partitions_and_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        v = spark.createDataFrame([(1, "k", 0, 1000), (2, "k", 10, 500), (3, "k", 20, 30), (4, "k", 40, 45)], "id long, k string, f long, u long")
        e = spark.createDataFrame([(t, "k", t) for t in range(0, 1100, 5)], "id long, k string, t long")
        got = {r[0]: r[1] for r in asof.as_of(e, v, ["k"], "t", "f", "u", "id", "left", ["id"], ["id"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert all(got[t] == (4 if 40 <= t < 45 else 3 if 20 <= t < 30 else 2 if 10 <= t < 500 else 1 if t < 1000 else None) for t in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_stretches_and_maximum_before(spark, seed):
    rng = random.Random(seed)
    rows = [(i, skewed(rng, ("hot", "hot", "a", None)), rng.randrange(0, 40), rng.randrange(-50, 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, key string, t long, v long")
    want = set()
    for k in {r[1] for r in rows}:
        points = sorted({r[2] for r in rows if r[1] == k})
        want |= {(k, a, b, n) for n, (a, b) in enumerate(zip(points, points[1:], strict=False))}
    assert {tuple(r) for r in axis.stretches(df).collect()} == want
    before = {(i, max((v2 for _, k2, t2, v2 in rows if k2 == k and t2 < t), default=None)) for i, k, t, _ in rows}
    assert {tuple(r) for r in axis.maximum_before(df, ["id"]).collect()} == before


def test_composite_keys_survive_as_text(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (None, "null")], "a int, b string")
    text = df.select(rangescan.entity_text(df, ["a", "b"]).alias("t"))
    assert text.distinct().count() == 3
    assert {tuple(r) for r in text.select(*rangescan.entity_columns(df, ["a", "b"], "t")).collect()} == {(1, None), (1, "a"), (None, "null")}


def test_one_interval_over_very_many_stretches(spark, monkeypatch):
    """An interval that lasts over a million stretches is never one row of a million numbers."""
    from pyspark.sql import functions as F

    from chronostrata.operators import interlace as module

    n = 1_100_000
    at = lambda c: F.timestamp_seconds(F.col(c)).cast("timestamp_ntz")
    short = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("a"), at("id").alias("valid_from"), F.timestamp_seconds(F.col("id") + 1).cast("timestamp_ntz").alias("valid_until"))
    whole = spark.range(1).select(F.lit("k").alias("key"), F.lit("open").alias("b"), at("id").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_until"))
    got = module.interlace([short, whole], "key")
    assert got.agg(F.count(F.lit(1)), F.countDistinct("a"), F.count_if(F.expr("b = 'open'")), F.count_if(F.expr("valid_until IS NULL"))).first()[:] == (n + 1, n, n + 1, 1)
    sizes = spark.range(1).select(F.size(module.blocks(F.lit(5).cast("bigint"), F.lit(10**9).cast("bigint"), 3))).first()[0]
    assert sizes < 6_000


@pytest.mark.parametrize("bits", [1, 2])
def test_blocks_cover_every_range_once(spark, monkeypatch, bits):
    from pyspark.sql import functions as F

    from chronostrata.operators import interlace as module

    monkeypatch.setattr(module, "BITS", bits)
    ranges = spark.createDataFrame([(a, b) for a in range(20) for b in range(a, 20)], "a long, b long")
    for row in ranges.select("a", "b", module.blocks(F.col("a"), F.col("b"), 3).alias("x")).collect():
        numbers = [n for z, k in row["x"] for n in range(k << (bits * z), (k + 1) << (bits * z))]
        assert sorted(numbers) == list(range(row["a"], row["b"] + 1))
