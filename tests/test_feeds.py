"""Change feeds and watermarks: order, repetition, failures."""

import random

import pytest

from chronostrata.operators import watermark
from chronostrata.operators.cow import BucketedTable
from chronostrata.sources.manifest import CommitConflict, Manifests

SCHEMA = "k string, seq long, gone boolean, bucket string, v double"


def table(spark, tmp_path, buckets=7):
    return BucketedTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, ["k"], "seq", "gone", buckets)


def state(t, **how):
    return {(r["k"], r["seq"], r["bucket"], r["v"]) for r in t.read(**how).collect()}


def brute(rows):
    best = {}
    for k, seq, gone, b, v in rows:
        if k is not None and seq is not None:
            rank = (seq, bool(gone), "" if b is None else b, float("-inf") if v is None else v)
            if k not in best or rank > best[k][0]:
                best[k] = (rank, (k, seq, b, v))
    return {x for r, x in best.values() if not r[1]}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_repetition(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "a", "b", "c", "d", None]), rng.choice([None, *range(12)]), rng.choice([True, False, False, None]), rng.choice(["x", "y", None]), rng.choice([1.0, 2.0, None])) for _ in range(120)]
    feed = rows + rows[:30]
    rng.shuffle(feed)
    t = table(spark, tmp_path)
    for i in range(0, len(feed), 50):
        t.apply(spark.createDataFrame(feed[i : i + 50], SCHEMA))
        assert state(t) == brute(feed[: i + 50])
    before = state(t)
    t.apply(spark.createDataFrame(feed, SCHEMA))  # all of it again
    assert state(t) == before == brute(feed)
    t.vacuum()
    assert state(table(spark, tmp_path)) == before


def test_only_touched_buckets_are_replaced(spark, tmp_path):
    t = table(spark, tmp_path, buckets=16)
    assert t.apply(spark.createDataFrame([(f"k{i}", 1, False, "x", 1.0) for i in range(100)], SCHEMA)) == 1
    before = t.manifests.read()["at"]
    t.apply(spark.createDataFrame([("k3", 2, True, None, None)], SCHEMA))
    after = t.manifests.read()["at"]
    assert sum(after[b] != before[b] for b in before) == 1
    assert len(state(t)) == 99 and len(state(t, tombstones=True)) == 100 and len(state(t, version=1)) == 100
    t.apply(spark.createDataFrame([("k3", 1, False, "late", 5.0)], SCHEMA))  # a late insert brings nothing back
    assert len(state(t)) == 99


def test_buckets_grow_with_the_table(spark, tmp_path, monkeypatch):
    """Buckets double in number; an old one is split when a change touches it, and several tasks write a large one."""
    from chronostrata.operators import buckets

    monkeypatch.setattr(buckets, "TASK_ROWS", 10)
    made = lambda: BucketedTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, ["k"], "seq", "gone", 2, bucket_rows=40)
    rows = [(f"k{i}", 1, False, "x", 1.0) for i in range(60)]
    t = made()
    t.apply(spark.createDataFrame(rows, SCHEMA))
    assert t.buckets == 2
    more = [(f"k{i}", 1, False, "y", 2.0) for i in range(60, 65)] + [(f"m{i}", 1, False, "y", 2.0) for i in range(200)]
    t.apply(spark.createDataFrame(more, SCHEMA))
    assert made().buckets == 8 and state(made()) == brute(rows + more)
    t.apply(spark.createDataFrame([(f"z{i}", 1, False, "z", 1.0) for i in range(400)], SCHEMA))
    before = t.manifests.read()
    t.apply(spark.createDataFrame([("k3", 2, False, "w", None)], SCHEMA))
    after = t.manifests.read()
    assert after["modulus"] == before["modulus"] == 32 and len(set(before["at"]) - set(after["at"])) <= 1
    assert sum(e["v"] == after["version"] for e in after["at"].values()) == 1  # a small delivery, one bucket
    assert sum(e["rows"] for e in after["at"].values()) == 665
    old = made()
    old.bucket_rows = 5  # grows, but only the touched bucket is split
    old.apply(spark.createDataFrame([("k3", 3, False, "v", None)], SCHEMA))
    assert len({buckets.split(k)[0] for k in old.manifests.read()["at"]}) == 2 and len(state(old)) == 665
    first = t.manifests.read(1)
    files = [f for e in {f"{tmp_path}/t/data/v1/{t.bucket}={buckets.split(k)[1]}" for k in first["at"]} for f in __import__("os").listdir(e) if f.endswith(".parquet")]
    assert len(files) > 2


def test_nothing_to_apply(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.apply(spark.createDataFrame([], SCHEMA)) is None and t.apply(spark.createDataFrame([(None, 1, False, "", 1.0), ("a", None, False, "", 1.0)], SCHEMA)) is None
    assert state(t) == set()


def test_a_lost_job_leaves_the_version_before(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.apply(spark.createDataFrame([("a", 1, False, "x", 1.0)], SCHEMA))
    monkeypatch.setattr(Manifests, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.apply(spark.createDataFrame([("a", 2, False, "y", 2.0)], SCHEMA))
    monkeypatch.undo()
    assert state(t) == {("a", 1, "x", 1.0)}
    t.apply(spark.createDataFrame([("a", 2, False, "y", 2.0)], SCHEMA))
    assert state(t) == {("a", 2, "y", 2.0)}


def test_of_two_writers_one_fails(spark, tmp_path):
    m = Manifests(spark, f"file://{tmp_path}/m")
    assert m.read() is None
    m.commit(1, {"a": 1})
    with pytest.raises(CommitConflict):
        m.commit(1, {"a": 2})
    assert m.read()["a"] == 1 and m.versions() == [1]


def test_watermark_export_skips_and_repeats_nothing(spark, tmp_path, monkeypatch):
    rows = [(i, i if i % 7 else None, i + 3 if i % 5 else None) for i in range(50)]
    source = spark.createDataFrame(rows, "id long, a long, b long")
    export = watermark.WatermarkExport(spark, f"file://{tmp_path}/x")
    with pytest.raises(LookupError):
        export.read()
    assert export.watermark() is None and export.export(source, ["a", "b"], 10) == 1
    monkeypatch.setattr(Manifests, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):  # output was written, but not committed
        export.export(source, ["a", "b"], 20)
    monkeypatch.undo()
    assert export.watermark() == 10
    assert export.export(source, ["a", "b"], 30) == 2 and export.export(source, ["a", "b"], 30) is None and export.export(source, ["a", "b"], 25) is None
    inside = lambda lo, hi: {i for i, a, b in rows if any(x is not None and lo <= x < hi for x in (a, b))}
    assert {r["id"] for r in export.read(1).collect()} == inside(-1, 10)
    assert {r["id"] for r in export.read(2).collect()} == inside(10, 30) and export.read(2).count() == len(inside(10, 30))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_of_a_log(spark, seed):
    rng = random.Random(seed)
    runs = []
    for run in range(60):
        entity, bound, start = rng.choice(["hot", "hot", "a", "b", None]), rng.choice([*range(0, 300, 7), None]), rng.choice([*range(40), None])
        runs += [(run, entity, bound, start, rng.choice([True, True, False, None]))] * rng.choice([1, 2])
        if rng.random() < 0.2:
            runs.append((run, entity, bound, start, None))
    records = [(i, rng.choice(["hot", "hot", "a", "b", "c", None]), rng.choice([None, rng.randrange(0, 320)]), rng.choice([None, rng.randrange(0, 320)])) for i in range(200)] * 2
    done = {}
    for run, entity, bound, start, ok in runs:
        if None not in (entity, bound, start):
            done.setdefault((run, entity, bound, start), []).append(ok)
    good = [k for k, oks in done.items() if any(oks)]
    want = set()
    for run, entity, bound, start in good:
        low = max((b for _, e, b, s in good if e == entity and s < start), default=None)
        want |= {(run, i) for i, e, a, b in records if e == entity and any(x is not None and x < bound and (low is None or x >= low) for x in (a, b))}
    from pyspark.sql import functions as F

    r = spark.createDataFrame(runs, "run long, entity string, bound long, start long, success boolean")
    x = spark.createDataFrame(records, "record long, entity string, a long, b long").select("record", "entity", F.array("a", "b").alias("instants"))
    got = [tuple(v) for v in watermark.replay(r, x).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert watermark.replay(r.limit(0), x).count() == 0 and watermark.replay(r, x.limit(0)).count() == 0


def test_runs_of_a_log_one_commit_after_the_other(spark, tmp_path, monkeypatch):
    """Tables with different bounds, a driver that dies between writing and committing, and requests that come again."""
    from pyspark.sql import functions as F

    runs = [(1, "a", 10, 1, True), (2, "b", 50, 2, True), (3, "a", 30, 3, False), (4, "a", 20, 4, True), (5, "b", 60, 5, True), (6, "a", 70, 6, True), (7, "c", 5, 7, True)]
    records = [(i, e, t, t + 7 if t % 3 else None) for i, (e, t) in enumerate((e, t) for e in ("a", "b", "c", None) for t in range(0, 80, 3))]
    x = spark.createDataFrame(records, "rec long, entity string, a long, b long").select("rec", "entity", F.array("a", "b").alias("instants"))
    part = lambda lo, hi: spark.createDataFrame([r for r in runs if lo <= r[3] <= hi], "run long, entity string, bound long, start long, success boolean")
    want, low = set(), {}
    for run, e, bound, _, ok in runs:
        if ok:
            want |= {(run, i) for i, en, *ts in records if en == e and any(t is not None and low.get(e, -1) <= t < bound for t in ts)}
            low[e] = bound
    export = watermark.WatermarkExport(spark, f"file://{tmp_path}/x")
    assert export.run(x, part(1, 3)) == 1 and (export.watermark("a"), export.watermark("b"), export.watermark("c")) == (10, 50, None)
    monkeypatch.setattr(Manifests, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        export.run(x, part(4, 5))
    monkeypatch.undo()
    assert export.watermark("a") == 10
    export = watermark.WatermarkExport(spark, f"file://{tmp_path}/x")  # the successor
    assert export.run(x, part(4, 5)) == 2 and export.run(x, part(1, 5)) is None and export.run(x, part(6, 7)) == 3
    got = [tuple(r) for r in export.read().select("run", "rec").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r["entity"]: r["bound"] for r in export.watermarks().collect()} == low
    with pytest.raises(ValueError, match="go back"):
        export.commit(export.read(), spark.createDataFrame([("b", 5)], watermark.MARKS))
    assert export.run(x, part(3, 3)) is None and export.manifests.versions() == [1, 2, 3]
