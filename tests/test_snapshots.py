"""History and differences of full snapshots, against brute force."""

import random

import pytest

from chronostrata.operators import merkle, snapdiff, snapshots

SCHEMA = "row_id long, entity_name string, who string, a double, b double, said string, writer_id int, got timestamp_ntz, branch string"


def made(spark, rows):
    from datetime import datetime, timedelta

    start = datetime(2021, 1, 1)
    return spark.createDataFrame([(i, e, k, a, b, None if s is None else s if isinstance(s, str) else (start + timedelta(days=s)).strftime("%Y-%m-%d %H:%M:%S"), 1, None if g is None else start + timedelta(hours=g), "x") for i, (e, k, a, b, s, g) in enumerate(rows)], SCHEMA)


def records(spark, rows):
    writers = spark.createDataFrame([(1, "UTC", "dmy")], "writer_id int, tz string, date_order string")
    return snapshots.delivered(made(spark, rows), writers, "entity_name", "who", "said", "got", "row_id", ["a", "b"])


def brute(rows):
    last = {}
    for i, (e, k, a, b, s, g) in enumerate(rows):
        if e is not None and k is not None and isinstance(s, int):
            at = (e, s, k)
            if at not in last or (-1 if g is None else g, i) >= last[at][0]:
                last[at] = ((-1 if g is None else g, i), (a, b))
    calendar = {}
    for e, s, _ in last:
        calendar.setdefault(e, set()).add(s)
    versions, diffs = set(), set()
    for e, days in calendar.items():
        days = sorted(days)
        held = [{k: v for (x, s, k), (_, v) in last.items() if x == e and s == d} for d in days]
        for i, d in enumerate(days):
            before = held[i - 1] if i else {}
            for k in {*held[i], *before}:
                if i and (k in held[i]) != (k in before):
                    diffs.add((e, k, d, "added" if k in held[i] else "removed"))
                elif i and held[i][k] != before[k]:
                    diffs.add((e, k, d, "changed"))
                if k in held[i] and (k not in before or before[k] != held[i][k]):
                    j = i
                    while j < len(days) and held[j].get(k, 0) == held[i][k]:
                        j += 1
                    versions.add((e, k, d, days[j] if j < len(days) else None))
    return versions, diffs


def days(us):
    return None if us is None else (us // 86_400_000_000) - 18_628


def compare(spark, rows):
    want_versions, want_diffs = brute(rows)
    r = records(spark, rows)
    got = [(x["entity"], x["key"], days(x["from_us"]), days(x["until_us"])) for x in merkle.history(r).collect()]
    assert len(got) == len(set(got)) and set(got) == want_versions
    found = [(x["entity"], x["key"], days(x["at"]), x["kind"]) for x in snapdiff.consecutive(r).collect()]
    assert len(found) == len(set(found)) and set(found) == want_diffs


@pytest.mark.parametrize("seed,leaf,unit", [(1, 64, 10**6), (2, 1, 10**6), (3, 1, 30)])
def test_random_snapshots(spark, monkeypatch, seed, leaf, unit):
    """Trees of the root alone, deep trees, and every entity divided."""
    monkeypatch.setattr(snapshots, "LEAF_ROWS", leaf)
    monkeypatch.setattr(snapshots, "BRANCH_ROWS", unit)
    monkeypatch.setattr(merkle, "FANOUT", 2)
    monkeypatch.setattr(snapshots, "FANOUT", 2)
    rng = random.Random(seed)
    rows = []
    for d in range(12):
        for e in ("e0", "e1", "e2", None):
            if rng.random() < 0.15:
                continue
            for k in range(9):
                if rng.random() < 0.85:
                    value = lambda: rng.choice([1.0, 2.0, None, None])
                    rows += [(e, rng.choice([f"k{k}"] * 9 + [None]), value() if rng.random() < 0.2 else 1.0, value() if rng.random() < 0.2 else None, rng.choice([d] * 12 + [None, "", "pending"]), rng.choice([0, 1, 2, None]))] * rng.choice([1, 1, 1, 2])
    rng.shuffle(rows)
    compare(spark, rows)


def test_a_hot_entity_is_divided(spark):
    rows = [("hot", f"k{i % 50}", float(i // 400), None, i // 50, 0) for i in range(1000)] + [(f"e{i}", "k", 1.0, None, i % 3, 0) for i in range(200)]
    sizes = spark.createDataFrame([(e, e, 1) for e, *_ in rows], "entity string, at string, n long")
    heavy = snapshots.divided(sizes, 4, len(rows))
    assert [r["entity"] for r in heavy.collect()] == ["hot"] and heavy.first()["branches"] > 4
    compare(spark, rows)


def test_two_large_snapshots_of_one_entity(spark):
    """Thousands of keys in each of two snapshots: deep trees, many branches, and no row that holds more than one record."""
    base = [("one", f"k{i}", float(i % 7), None, 0, 0) for i in range(4000)]
    rows = base + [("one", f"k{i}", float(i % 7 if i % 400 else -1), None, 5, 0) for i in range(100, 4100)]
    r = records(spark, rows)
    assert r.depth >= 1 and r.calendar.count() > 8
    want_versions, want_diffs = brute(rows)
    assert {(x["entity"], x["key"], days(x["from_us"]), days(x["until_us"])) for x in merkle.history(r).collect()} == want_versions
    assert {(x["entity"], x["key"], days(x["at"]), x["kind"]) for x in snapdiff.consecutive(r).collect()} == want_diffs


def test_only_differing_leaves_are_compared(spark):
    rows = [("e", f"k{i}", 1.0 if (i, d) != (7, 2) else 2.0, None, d, 0) for i in range(600) for d in range(4)]
    r = records(spark, rows)
    leaves = merkle.differing(merkle.trees(merkle.dated(r), r.depth))
    by_day = {}
    for x in leaves.collect():
        by_day[days(x["at"])] = by_day.get(days(x["at"]), 0) + 1
    assert by_day.pop(0) > 10 and by_day == {2: 1, 3: 1}  # all of the first snapshot, then the one leaf that changed and changed back


def test_plans_keep_records_where_they_lie(spark):
    rows = [("hot", f"k{i % 50}", float(i // 400), None, i // 50, 0) for i in range(1000)]
    r = records(spark, rows)
    for found in (merkle.history(r), snapdiff.consecutive(r)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "FullOuter" in plan
        moved = [x.split("hashpartitioning(")[1].split(", 4)")[0] for x in plan.splitlines() if "+- Exchange hashpartitioning(entity" in x and "REPARTITION" not in x]
        shapes = {tuple(c.split("#")[0] for c in m.split(", ")) for m in moved}
        # to be reduced; the changes alone, by their keys; and the calendar or the list of leaves, to where the records lie
        assert shapes <= {("entity", "branch", "at", "key"), ("entity", "branch", "key"), ("entity", "branch")}, shapes
    assert plan.count("Generate replicaterows") == 2  # both EXCEPT ALLs


def test_empty_and_single(spark):
    assert merkle.history(records(spark, [])).count() == 0
    assert snapdiff.consecutive(records(spark, [])).count() == 0
    compare(spark, [("e", "k", 1.0, None, 0, 0)])
    compare(spark, [("e", "k", 1.0, None, 0, 0), ("e", "j", None, 1.0, 5, 0)])  # null payloads don't trade places


def test_null_payloads_are_told_apart(spark):
    df = spark.createDataFrame([(1.0, None), (None, 1.0), (None, None)], "a double, b double")
    assert df.select(*snapshots.payload_hashes(["a", "b"])).distinct().count() == 3


def test_between_two_snapshots(spark):
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 3), (None, 4), ("same", None)], "k string, _gone int")
    after = spark.createDataFrame([("a", 1), ("b", 5), ("c", 3), (None, 7), ("new", 1), ("same", None)], "k string, _gone int")
    got = {(r["k"], r["kind"]) for r in snapdiff.between(before, after, ["k"]).collect()}
    assert got == {("b", "changed"), ("c", "changed"), (None, "changed"), ("new", "added")}
    assert snapdiff.between(before, before.limit(0), ["k"]).where("kind = 'removed'").count() == 5
    assert snapdiff.between(before, before, ["k"]).count() == 0
