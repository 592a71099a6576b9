"""Joins, key filters, checksums, unite, interlace and row changes."""

import random
from datetime import datetime

import pytest

from chronostrata.functions.checksum import digest_to_checksum, unite
from chronostrata.operators import joins, keys, rows
from chronostrata.operators.interlace import interlace


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def xy(spark):
    x = spark.createDataFrame([("1", "strA"), ("2", None), (None, "strB")], "number string, t string")
    y = spark.createDataFrame([("A", None), ("B", "2"), ("A", "1"), ("B", "1")], "letter string, number string")
    return x, y


@pytest.mark.parametrize("how,n", [("left", 4), ("right", 4), ("inner", 4), ("full", 4)])
def test_null_matching(xy, how, n):
    assert joins.join(*xy, how, na_by="number").count() == n


def test_null_rejecting(xy):
    x, y = xy
    assert joins.inner_join(x, y, by="number").count() == 3 and joins.left_join(x, y, by="number").where("letter IS NULL").count() == 1
    full = got(joins.full_join(x, y, by="number"))
    assert len(full) == 5 and ("1", "strA", "A") in full and (None, None, "A") in full and (None, "strB", None) in full
    assert got(joins.semi_join(x, y, na_by="number")) == got(x) and joins.anti_join(x, y, by="number").count() == 1


def test_both_kinds_of_keys_and_unmatched_right_rows(spark):
    x = spark.createDataFrame([("05-01", "1", 3), ("05-01", None, None), ("05-02", None, None), ("05-02", "1", None)], "date string, region string, n_start int")
    y = spark.createDataFrame([("05-02", "1", 4), ("05-03", None, 7), ("05-03", None, 7)], "date string, region string, n_add int")
    right = got(joins.right_join(x, y, by="date", na_by="region"))
    assert right == sorted([("05-02", "1", None, 4), ("05-03", None, None, 7), ("05-03", None, None, 7)], key=str)
    assert joins.full_join(x, y, by="date", na_by="region").count() == 6  # repeated rows stay
    named = joins.left_join(x.withColumnRenamed("date", "day"), y, by={"day": "date"}, na_by=["region"])
    assert named.columns == ["day", "region", "n_start", "n_add"] and named.count() == 4


def test_names_that_clash_and_conditions(spark):
    x, y = spark.createDataFrame([(1, 5)], "k int, v int"), spark.createDataFrame([(1, 6), (2, 7)], "k int, v int")
    assert joins.inner_join(x, y, by="k").columns == ["k", "v", "v.y"]
    assert got(joins.left_join(x, y, on="RHS.v > LHS.v")) == [(1, 5, 1, 6), (1, 5, 2, 7)]
    assert joins.join(x, y.withColumnRenamed("k", "j").withColumnRenamed("v", "k"), "left").count() == 1  # the common column
    with pytest.raises(ValueError):
        joins.join(x, y, "cross", by="k")
    with pytest.raises(ValueError):
        joins.join(x, y.toDF("a", "b"))


def test_not_in(spark):
    x, y = spark.createDataFrame([(1,), (2,), (None,)], "a int"), spark.createDataFrame([(1,), (None,)], "a int")
    assert got(joins.not_in(x, y.where("a = 1"), "a")) == [(2,)] and joins.not_in(x, y, "a").count() == 0 and joins.not_in(x, y.limit(0), "a").count() == 3


def test_filter_keys(spark):
    df = spark.createDataFrame([(i, ["a", "b", None][i % 3], i % 2) for i in range(12)], "i int, g string, p int")
    assert keys.filter_keys(df, None).count() == 12
    assert keys.filter_keys(df, spark.createDataFrame([("a",)], "g string")).count() == 4
    assert keys.filter_keys(df, spark.createDataFrame([("a", 0), ("b", 1)], "g string, p int")).count() == 4
    assert keys.filter_keys(df, spark.createDataFrame([(None,)], "g string")).count() == 4  # an all-null column matches nulls
    assert keys.filter_keys(df, spark.createDataFrame([("a",), (None,)], "g string")).count() == 4  # a partly null one doesn't
    assert keys.filter_keys(df, spark.createDataFrame([], "g string")).count() == 0
    assert keys.filter_keys(df, spark.createDataFrame([("a",), ("a",)], "g string")).count() == 8
    extra = keys.filter_keys(df, spark.createDataFrame([("a", "x")], "g string, note string"), by="g")
    assert extra.columns == ["i", "g", "p", "note"]
    with pytest.raises(ValueError):
        keys.filter_keys(df, spark.createDataFrame([("a",)], "g string"), by="h")
    assert keys.nrow(df) == 12 and not keys.is_historical(df) and keys.is_historical(df.withColumnRenamed("g", "from_ts"))


def test_checksums(spark):
    df = spark.createDataFrame([("A", None), (None, "A"), ("A", ""), ("a_b", "c"), ("a", "b_c")], "x string, y string")
    c = [r["checksum"] for r in digest_to_checksum(df).collect()]
    assert c[0] != c[1] and c[0] == c[2] and c[3] == c[4] and all(len(v) == 32 for v in c)
    assert len({r["checksum"] for r in digest_to_checksum(df, safe=True).collect()}) == 5
    twice = digest_to_checksum(df)
    with pytest.warns(UserWarning, match="overwritten"):
        assert got(digest_to_checksum(twice)) == got(twice)
    assert digest_to_checksum(df, col="h", exclude=["y"]).columns == ["x", "y", "h"]
    with pytest.raises(TypeError):
        digest_to_checksum(spark.createDataFrame([([1],)], "a array<int>"))
    assert digest_to_checksum(df.limit(0)).count() == 0
    assert {len(r["checksum"]) for r in digest_to_checksum(df, algorithm="sha256").collect()} == {64}
    with pytest.raises(ValueError):
        digest_to_checksum(df, algorithm="crc")


def test_unite(spark):
    df = spark.createDataFrame([(1, "a", None, 2.5), (2, None, None, None)], "i int, x string, y string, z double")
    assert got(unite(df, "u", ["x", "z"]).select("u")) == [("a_2.5",), (None,)]
    assert unite(df, "u", ["x", "z"]).columns == ["i", "u", "y"]
    assert unite(df, "u", ["x", "z"], remove=False).columns == ["i", "u", "x", "y", "z"]
    assert got(unite(df, "u", sep="")) == [("1a2.5",), ("2",)]


D = lambda m: datetime(2021, m, 1)


def test_interlace_golden(spark):
    t1 = spark.createDataFrame([("A", 1, D(1), D(2)), ("A", 2, D(2), D(3)), ("B", 2, D(1), None)], "key string, obs_1 int, valid_from timestamp_ntz, valid_until timestamp_ntz")
    t2 = spark.createDataFrame([("A", "a", D(1), D(4)), ("B", "b", D(1), None)], "key string, obs_2 string, valid_from timestamp_ntz, valid_until timestamp_ntz")
    want = sorted([("A", 1, "a", D(1), D(2)), ("A", 2, "a", D(2), D(3)), ("A", None, "a", D(3), D(4)), ("B", 2, "b", D(1), None)], key=str)
    assert got(interlace([t1, t2], "key")) == want
    swapped = interlace([t2, t1], "key")
    assert swapped.columns == ["key", "obs_2", "obs_1", "valid_from", "valid_until"] and got(swapped.select("key", "obs_1", "obs_2", "valid_from", "valid_until")) == want
    assert interlace([t1], "key") is t1
    with pytest.raises(ValueError):
        interlace([t1, t1], "key")
    with pytest.raises(ValueError):
        interlace([t1, t2], [])
    assert interlace([t1.limit(0), t2.limit(0)], "key").count() == 0


def test_interlace_with_overlaps_nulls_and_composite_keys(spark):
    rng = random.Random(4)
    tables = []
    for name in ("a", "b", "c"):
        rows_ = []
        for i in range(40):
            f = rng.randrange(1, 10)
            rows_.append((rng.choice(["h", "h", None]), rng.choice([1, 1, 2]), f"{name}{i}", None if rng.random() < 0.05 else D(f), rng.choice([None, D(min(12, f + rng.randrange(0, 3)))])))
        tables.append(rows_)
    dfs = [spark.createDataFrame(r, f"k string, j int, {n} string, valid_from timestamp_ntz, valid_until timestamp_ntz") for r, n in zip(tables, "abc", strict=True)]
    want = []
    far = datetime(9999, 1, 1)
    for key in {r[:2] for t in tables for r in t}:
        ends = sorted({x or far for t in tables for r in t if r[:2] == key for x in r[3:]})
        for f, u in zip(ends, ends[1:], strict=False):
            held = [[r[2] for r in t if r[:2] == key and r[3] is not None and r[3] <= f and u <= (r[4] or far)] or [None] for t in tables]
            want += [(*key, a, b, c, f, None if u == far else u) for a in held[0] for b in held[1] for c in held[2]]
    assert got(interlace(dfs, ["k", "j"])) == sorted(want, key=str)


def test_row_changes(spark):
    x = spark.createDataFrame([(1, "a"), (2, None), (None, "n"), (3, "c"), (3, "c")], "k int, v string")
    y = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N"), (4, "D"), (4, "D")], "k int, v string")
    assert got(rows.rows_update(x, y, ["k"])) == got(spark.createDataFrame([(1, "a"), (2, "B"), (None, "N"), (3, "C"), (3, "C")], "k int, v string"))
    assert got(rows.rows_patch(x, y, ["k"])) == got(spark.createDataFrame([(1, "a"), (2, "B"), (None, "n"), (3, "c"), (3, "c")], "k int, v string"))
    assert got(rows.rows_upsert(x, y, ["k"])) == got(spark.createDataFrame([(1, "a"), (2, "B"), (None, "N"), (3, "C"), (3, "C"), (4, "D")], "k int, v string"))
    assert rows.rows_insert(x, y, ["k"]).count() == 6 and rows.rows_append(x, y).count() == 10
    assert got(rows.rows_delete(x, y, ["k"])) == [(1, "a")]
    assert got(rows.rows_delete(x, y.limit(0), ["k"])) == got(x)
