"""The stored Merkle history against the closed form, and what it looks at and replaces."""

import random
from datetime import datetime, timedelta

import pytest

from chronostrata.operators.merkle_store import HashTree, MerkleHistory

SCHEMA = "k string, j int, leaf string, from_ts double"  # clashing names on purpose


def opened(spark, tmp_path, **how):
    return MerkleHistory(spark, f"file://{tmp_path}/h", spark.createDataFrame([], SCHEMA).schema, ["k", "j"], **how)


def test_random_snapshots(spark, tmp_path):
    rng = random.Random(1)
    held, want, day = {}, [], datetime(2022, 1, 1)
    for step in range(6):
        if step == 3:
            snap = {}
        else:
            snap = {(f"k{i}", i % 3): (rng.choice(["x", None]), rng.choice([1.0, None])) for i in range(40) if rng.random() < 0.9}
        rows = [(*k, *v) for k, v in snap.items()] * 2 + [(None, 1, "x", 1.0)]
        now = day + timedelta(days=step)
        opened(spark, tmp_path, fanout=4, depth=2).apply(spark.createDataFrame(rows, SCHEMA), now)
        for k in list(held):
            if k not in snap or snap[k] != held[k][0]:
                v, since = held.pop(k)
                want.append((*k, *v, since, now))
        for k, v in snap.items():
            held.setdefault(k, (v, now))
    want += [(*k, *v, since, None) for k, (v, since) in held.items()]
    table = opened(spark, tmp_path)
    assert table.fanout == 4
    got = table.read()
    assert got.columns == ["k", "j", "leaf", "from_ts", "from_ts_1", "until_ts"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_only_differing_leaves_are_replaced(spark, tmp_path):
    h = opened(spark, tmp_path, fanout=8, depth=2)
    rows = [(f"k{i}", 0, "x", 1.0) for i in range(300)]
    assert h.apply(spark.createDataFrame(rows, SCHEMA), "2022-01-01")["leaves"] > 40
    first = h.manifests.read()["held"]
    assert h.apply(spark.createDataFrame(rows, SCHEMA), "2022-01-02") == {"nodes": 1, "leaves": 0}  # the roots are equal
    assert h.apply(spark.createDataFrame([*rows[1:], ("k0", 0, "y", 1.0)], SCHEMA), "2022-01-03") == {"nodes": 1 + 8 + 8, "leaves": 1}
    assert sum(first[k] != v for k, v in h.manifests.read()["held"].items()) == 1
    assert h.read().count() == 301
    with pytest.raises(ValueError, match="later"):
        h.apply(spark.createDataFrame(rows, SCHEMA), "2022-01-03")


def test_hash_trees():
    a, b = HashTree({(16, 0): (1, 1, 1), (16, 9): (2, 2, 1)}, 4), HashTree({(16, 0): (1, 1, 1), (16, 9): (3, 2, 1), (16, 15): (7, 7, 2)}, 4)
    assert a.differing(b, 16)[0] == [9, 15] and a.differing(a, 16) == ([], 1) and HashTree({}, 4).differing(a, 16)[0] == [0, 9]
    shallow = HashTree({(4, 0): (1, 1, 1), (4, 1): (2, 2, 1)}, 4)  # the same records, in fewer leaves
    assert a.differing(shallow, 16) == ([], 1)
    assert b.differing(shallow, 16)[0] == [1, 5, 9, 13, 15]  # the old leaf as a whole, and the new one where the old tree has nothing


def test_trees_grow_with_the_table(spark, tmp_path):
    made = lambda: MerkleHistory(spark, f"file://{tmp_path}/g", spark.createDataFrame([], SCHEMA).schema, ["k", "j"], fanout=4, depth=1, leaf_rows=20)
    rows = lambda n, v: [(f"k{i}", 0, v if i == 5 else "x", 1.0) for i in range(n)]
    made().apply(spark.createDataFrame(rows(60, "x"), SCHEMA), "2022-01-01")
    assert made().manifests.read()["modulus"] == 4
    made().apply(spark.createDataFrame(rows(400, "x"), SCHEMA), "2022-01-02")
    assert made().manifests.read()["modulus"] == 64
    assert made().apply(spark.createDataFrame(rows(400, "y"), SCHEMA), "2022-01-03")["leaves"] == 1
    got = made().read()
    assert got.count() == 401 and got.where("until_ts IS NULL").count() == 400 and got.where("from_ts_1 = '2022-01-01'").count() == 60


def test_nothing_yet(spark, tmp_path):
    h = opened(spark, tmp_path)
    assert h.read().count() == 0
    h.apply(spark.createDataFrame([], SCHEMA), "2022-01-01")
    assert h.read().count() == 0
