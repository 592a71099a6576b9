"""Snapshot updates and point-in-time reads: golden scenarios, and random sequences against the closed form."""

import random
from datetime import date, datetime

import pytest

from chronostrata import engine
from chronostrata.functions.timestamps import db_timestamp, to_ts
from chronostrata.operators import history
from chronostrata.sources.locks import lock_table
from chronostrata.sources.logs import Logger, LoggerNull

COLS = "col1 string, col2 double"
T = "test.tmp"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def rows_of(df):
    return sorted(((r["col1"], r["col2"], str(r["from_ts"])[:16], None if r["until_ts"] is None else str(r["until_ts"])[:16]) for r in df.collect()), key=str)


def update(spark, store, rows, t, **how):
    return engine.update_snapshot(frame(spark, rows), store, T, t, **how)


def test_flip_flop(spark, store):
    for year, v in zip((2000, 2010, 2020, 2030, 2040), (2.0, 1.0, 2.0, 1.0, 2.0), strict=True):
        update(spark, store, [("A", v)], f"{year}-01-01")
    got = store.get_table(T, None).orderBy("from_ts").collect()
    assert [r["col2"] for r in got] == [2.0, 1.0, 2.0, 1.0, 2.0]
    assert [r["until_ts"] for r in got] == [r["from_ts"] for r in got[1:]] + [None]


T0, T1, T2 = [("A", None), ("B", None)], [("A", 1.0), ("B", None), ("C", None)], [("A", 1.0), ("B", 2.0), ("C", 3.0)]


def test_two_updates_at_one_instant_leave_no_empty_records(spark, store):
    update(spark, store, T0, "2022-01-01 08:00:00")
    update(spark, store, T1, "2022-01-01 08:10:00", collapse_continuous_records=True)
    update(spark, store, T2, "2022-01-01 08:10:00", collapse_continuous_records=True)
    got = [(r["col1"], r["col2"]) for r in store.get_table(T, None).collect()]
    assert sorted(got, key=str) == sorted([("A", 1.0), ("A", None), ("B", 2.0), ("B", None), ("C", 3.0)], key=str)


def test_out_of_order(spark, store):
    update(spark, store, T0, "2022-01-01")
    update(spark, store, T2, "2022-03-01")
    with pytest.raises(RuntimeError, match="earlier than latest"):
        update(spark, store, T1, "2022-02-01")
    update(spark, store, T1, "2022-02-01", enforce_chronological_order=False)
    a, b, c = "2022-01-01 00:00", "2022-02-01 00:00", "2022-03-01 00:00"
    assert rows_of(store.get_table(T, None)) == sorted([("A", None, a, b), ("A", 1.0, b, None), ("B", None, a, c), ("B", 2.0, c, None), ("C", None, b, c), ("C", 3.0, c, None)], key=str)


def test_counts_of_a_sequence(spark, store):
    """32 records: all new, 15 changed, 8 more at the same instant, and one update in between."""
    base = [(f"car{i:02}", float(100 + i * 2)) for i in range(32)]
    step2 = [(n, v - 10 if i >= 17 else v) for i, (n, v) in enumerate(base)]
    step3 = [(n, v - 10 if i >= 24 else v) for i, (n, v) in enumerate(step2)]
    assert update(spark, store, base, "2022-10-01 09:00:00") == {"n_insertions": 32, "n_deactivations": 0}
    assert update(spark, store, base, "2022-10-01 09:00:00") == {"n_insertions": 0, "n_deactivations": 0}
    assert update(spark, store, step2, "2022-10-03 09:00:00") == {"n_insertions": 15, "n_deactivations": 15}
    assert update(spark, store, step3, "2022-10-03 09:00:00") == {"n_insertions": 8, "n_deactivations": 8}
    mid = [(n, v - 10 if i >= 28 else v) for i, (n, v) in enumerate(base)]
    update(spark, store, mid, "2022-10-02 09:00:00", enforce_chronological_order=False)
    for t, want in (("2022-10-01 09:00:00", base), ("2022-10-02 09:00:00", mid), ("2022-10-03 09:00:00", step3)):
        assert sorted(tuple(r) for r in store.get_table(T, t).collect()) == sorted(want)
    assert store.get_table(T, "2022-09-30").count() == 0


def test_same_instant_there_and_back(spark, store):
    for v in (1.0, 2.0, 1.0):
        update(spark, store, [("A", v)], "2022-01-01")
    assert [tuple(r) for r in store.get_table(T).collect()] == [("A", 1.0)]
    assert store.get_table(T, None).count() == 1


@pytest.mark.parametrize("seed", range(4))
def test_any_order_gives_the_closed_form(spark, store, seed):
    rng = random.Random(seed)
    days = [rng.randrange(1, 8) for _ in range(6)]
    final, order = {}, []
    for d in days:
        rows = [(c, rng.choice([1.0, None])) for c in "ABC" if rng.random() < 0.6]
        final[d] = rows
        order.append((d, rows))
    for d, rows in order:
        update(spark, store, rows, datetime(2022, 1, d), enforce_chronological_order=False)
    want = history.islands([(frame(spark, r), datetime(2022, 1, d)) for d, r in final.items()], ["col1", "col2"])
    assert rows_of(store.get_table(T, None)) == rows_of(want)


def test_filters_touch_only_their_records(spark, store):
    only_a = spark.createDataFrame([("A",)], "col1 string")
    update(spark, store, T0, "2022-01-01")
    update(spark, store, [("A", 5.0), ("B", 9.0)], "2022-02-01", filters=only_a)
    assert sorted((tuple(r) for r in store.get_table(T).collect()), key=str) == sorted([("A", 5.0), ("B", None)], key=str)
    with pytest.raises(ValueError, match="other filters"):
        update(spark, store, T0, "2022-01-15", enforce_chronological_order=False)
    update(spark, store, [("A", 4.0)], "2022-01-15", filters=only_a, enforce_chronological_order=False)
    a, m, b = "2022-01-01 00:00", "2022-01-15 00:00", "2022-02-01 00:00"
    assert rows_of(store.get_table(T, None)) == sorted([("A", None, a, m), ("A", 4.0, m, b), ("A", 5.0, b, None), ("B", None, a, None)], key=str)
    update(spark, store, [("A", 9.0)], "2022-03-01", filters=only_a.limit(0))
    assert store.get_table(T).count() == 2


def test_errors_leave_no_lock(spark, store):
    update(spark, store, T0, "2022-01-01")
    with pytest.raises(RuntimeError, match="Columns do not match"):
        engine.update_snapshot(spark.createDataFrame([("A",)], "col1 string"), store, T, "2022-02-01")
    store.write_table(frame(spark, T0), "test.plain")
    with pytest.raises(RuntimeError, match="does not seem like a historical table"):
        engine.update_snapshot(frame(spark, T0), store, "test.plain", "2022-02-01")
    with pytest.raises(ValueError, match="metadata"):
        engine.update_snapshot(spark.createDataFrame([("A", "x")], "col1 string, checksum string"), store, "test.new", "2022-02-01")
    update(spark, store, T1, "2022-02-01")
    assert lock_table(store, T, pid=1) is True  # free; process 1 lives and keeps it
    with pytest.raises(RuntimeError, match="lock"):
        update(spark, store, T1, "2022-03-01")


def test_a_lost_update_leaves_the_version_before(spark, store, monkeypatch):
    update(spark, store, T0, "2022-01-01")
    before = rows_of(store.get_table(T, None))
    monkeypatch.setattr("chronostrata.sources.manifest.Manifests.commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        update(spark, store, T2, "2022-02-01", logger=LoggerNull())
    monkeypatch.undo()
    assert rows_of(store.get_table(T, None)) == before
    update(spark, store, T2, "2022-02-01")
    assert store.get_table(T).count() == 3


def test_in_order_updates_keep_the_closed_files(spark, store):
    for d in range(1, 5):
        update(spark, store, [("A", float(d)), ("B", 0.0)], datetime(2022, 1, d))
    closed = [p["path"] for p in store.state(T)["parts"] if not p["is_open"]]
    assert len(closed) == 3
    assert store.get_table(T, None).count() == 5
    store.compact(T)
    assert store.get_table(T, None).count() == 5 and len(store.state(T)["parts"]) == 2


def test_empty_snapshot_and_nulls(spark, store):
    update(spark, store, [(None, None), (None, None), ("A", 1.0)], "2022-01-01")
    assert store.get_table(T).count() == 2  # repeated rows count once
    update(spark, store, [], "2022-02-01")
    assert store.get_table(T).count() == 0 and store.get_table(T, "2022-01-15").count() == 2
    update(spark, store, [("A", 1.0)], "2022-01-10", enforce_chronological_order=False)  # the empty one is remembered
    assert store.get_table(T).count() == 0


def test_log_of_updates(spark, store):
    logger = Logger(T, "2022-01-01", output_to_console=False, log_table_id="test.logs", store=store)
    update(spark, store, T0, "2022-01-01", logger=logger, message="first")
    logger = Logger(T, "2022-02-01", output_to_console=False, log_table_id="test.logs", store=store)
    with pytest.raises(RuntimeError):
        update(spark, store, T0, "2021-02-01", logger=logger)
    got = {(r["date"], r["n_insertions"], r["success"], r["message"]) for r in store.get_table("test.logs").collect()}
    assert got == {(datetime(2022, 1, 1), 2, True, "first"), (datetime(2021, 2, 1), None, False, None)}


def test_slices(spark):
    t = lambda d: datetime(2022, 6, d)
    df = spark.createDataFrame([(i, t(1 if i < 20 else 15), None) for i in range(32)], "i int, valid_from timestamp_ntz, valid_until timestamp_ntz")
    count = lambda when: history.slice_time(df, when, "valid_from", "valid_until").count()
    assert [count(w) for w in ("2022-05-01", "2022-06-01", "2022-06-15")] == [0, 20, 32]
    ended = spark.createDataFrame([(t(1), t(2))], "from_ts timestamp_ntz, until_ts timestamp_ntz")
    assert [history.slice_time(ended, t(d)).count() for d in (1, 2)] == [1, 0]


def test_all_spellings_of_an_instant_are_equal(spark):
    for v in (date(2024, 3, 1), datetime(2024, 3, 1), "2024-03-01", "2024-03-01 00:00", "2024-03-01 00:00:00", "2024-03-01T00:00:00Z", "2024/03/01"):
        assert to_ts(v) == datetime(2024, 3, 1)
        assert spark.range(1).select(db_timestamp(v)).first()[0] == datetime(2024, 3, 1)
    assert spark.range(1).select(db_timestamp(None)).first()[0] is None
    for bad in ("yesterday", "2024-13-01", 5, None):
        with pytest.raises(ValueError):
            to_ts(bad)


def test_literal_rules(spark, store):
    """The older rules lose the later part of a record that a late snapshot lacks, and know no end for what it adds."""
    x = lambda *names: [(n, None) for n in names]
    update(spark, store, x("X"), "2022-01-01", literal=True)
    update(spark, store, x("X", "Y"), "2022-03-01", literal=True)
    counts = update(spark, store, x("Z"), "2022-02-01", literal=True, enforce_chronological_order=False)
    assert counts == {"n_insertions": 1, "n_deactivations": 1}
    a, b, c = "2022-01-01 00:00", "2022-02-01 00:00", "2022-03-01 00:00"
    assert rows_of(store.get_table(T, None)) == sorted([("X", None, a, b), ("Y", None, c, None), ("Z", None, b, None)], key=str)


def test_literal_rules_agree_in_order(spark, store):
    for k, (rows, t) in enumerate(((T0, "2022-01-01"), (T1, "2022-02-01"), (T2, "2022-03-01"), (T1, "2022-04-01"))):
        for table, literal in (("test.a", True), ("test.b", False)):
            engine.update_snapshot(frame(spark, rows), store, table, t, literal=literal)
        assert rows_of(store.get_table("test.a", None)) == rows_of(store.get_table("test.b", None)), k
    engine.update_snapshot(frame(spark, T0), store, "test.a", "2022-04-01", literal=True)
    assert store.get_table("test.a", None).where("from_ts = until_ts").count() > 0  # records of zero length stay
    engine.update_snapshot(frame(spark, T2), store, "test.a", "2022-04-01", literal=True, collapse_continuous_records=True)
    assert store.get_table("test.a", None).where("from_ts = until_ts").count() == 0


def test_slice_max_keeps_ties(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), (None, 5, 4), (None, None, 5), ("b", None, 6)], "g string, o int, i int")
    assert sorted(r["i"] for r in history.slice_max(df, "o", ["g"]).collect()) == [2, 3, 4]


ODD = [("a_b", "c"), ("a", "b_c"), ("", "z"), (None, "z"), ("", None), (None, None)]


def test_records_of_one_checksum_are_all_kept(spark, store):
    """'_' in values, empty texts and nulls: payloads that share a checksum are different records all the same."""
    made = lambda rows: spark.createDataFrame(rows, "_id string, _in string")
    pairs = lambda df: sorted(((r["_id"], r["_in"]) for r in df.collect()), key=str)
    assert engine.update_snapshot(made(ODD * 2), store, T, "2022-01-01") == {"n_insertions": 6, "n_deactivations": 0}
    assert pairs(store.get_table(T)) == sorted(ODD, key=str) and store.get_table(T, None).select("checksum").distinct().count() == 3
    assert engine.update_snapshot(made(ODD[::2]), store, T, "2022-03-01") == {"n_insertions": 0, "n_deactivations": 3}
    engine.update_snapshot(made(ODD[1:]), store, T, "2022-02-01", enforce_chronological_order=False)
    for t, want in (("2022-01-01", ODD), ("2022-02-01", ODD[1:]), ("2022-03-01", ODD[::2])):
        assert pairs(store.get_table(T, t)) == sorted(want, key=str), t
    islands = history.islands([(made(ODD), "2022-01-01"), (made(ODD[1:]), "2022-02-01"), (made(ODD[::2]), "2022-03-01")], ["_id", "_in"])
    assert sorted(map(str, islands.collect())) == sorted(map(str, store.get_table(T, None).collect()))
    engine.delta_load(store, "test.copy", [engine.delta_export(store, T, "2022-02-01"), engine.delta_export(store, T, "2022-01-01", "2022-02-01")])
    assert sorted(map(str, store.get_table("test.copy", None).collect())) == sorted(map(str, store.get_table(T, None).collect()))
    engine.update_snapshot(made([("", "z")]), store, T, "2022-04-01", filters=spark.createDataFrame([("",)], "_id string"))
    assert pairs(store.get_table(T)) == [("", "z"), ("a_b", "c")]
    with pytest.raises(ValueError, match="literal rules"):
        engine.update_snapshot(made(ODD), store, T, "2022-05-01", literal=True)
