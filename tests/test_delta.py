"""Deltas: sizes, replay in any order and repeatedly, logs, and registry transport."""

from itertools import permutations

import pytest

from chronostrata import engine
from chronostrata.operators.delta import export_delta
from chronostrata.sources.logs import Logger

COLS = "col1 string, col2 double"
T = "test.source"
STEPS = [("2022-01-01 08:00:00", [("A", None), ("B", None)]), ("2022-01-01 08:10:00", [("A", 1.0), ("B", None), ("C", None)]), ("2022-01-01 08:20:00", [("A", None), ("B", 2.0), ("C", 3.0)])]


def content(store, t=T):
    return sorted((tuple(map(str, r)) for r in store.get_table(t, None).collect()))


@pytest.fixture
def source(spark, store):
    for t, rows in STEPS:
        engine.update_snapshot(spark.createDataFrame(rows, COLS), store, T, t)
    return store


def bounded(store, t):
    return engine.delta_export(store, T, t, t[:-2] + "01")


def test_sizes(spark, store):
    for (t, rows), n in zip(STEPS, (2, 3, 6), strict=True):
        engine.update_snapshot(spark.createDataFrame(rows, COLS), store, T, t)
        assert engine.delta_export(store, T, t).data.count() == n


def test_all_orders_and_repetition(source):
    deltas = [bounded(source, t) for t, _ in STEPS]
    for k, order in enumerate(permutations(range(3))):
        target = f"test.copy{k}"
        engine.delta_load(source, target, [deltas[i] for i in (*order, order[0])])
        assert content(source, target) == content(source)
        assert source.state(target)["registry"] == source.state(T)["registry"]


def test_one_batch_and_open_ended(source):
    engine.delta_load(source, "test.batch", engine.delta_export(source, T, STEPS[0][0], "2022-01-01 08:20:01"))
    assert content(source, "test.batch") == content(source)
    engine.delta_load(source, "test.open", bounded(source, STEPS[0][0]))
    engine.delta_load(source, "test.open", engine.delta_export(source, T, STEPS[1][0]))
    assert content(source, "test.open") == content(source)


def test_ends_after_the_bound_aren_t_known(source):
    d = export_delta(source.get_table(T, None), STEPS[0][0], "2022-01-01 08:05:00").data
    assert d.count() == 2 and d.where("until_ts IS NOT NULL").count() == 0
    d = export_delta(source.get_table(T, None), STEPS[0][0], STEPS[1][0]).data
    assert d.where("until_ts IS NOT NULL").count() == 1  # an end at the bound itself is kept


def test_log_counts(source):
    logger = Logger("test.logged", None, output_to_console=False, log_table_id="test.logs", store=source)
    engine.delta_load(source, "test.logged", engine.delta_export(source, T, STEPS[0][0]), logger)
    got = {(str(r["date"]), r["n_insertions"], r["n_deactivations"]) for r in source.get_table("test.logs").collect()}
    assert got == {("2022-01-01 08:00:00", 2, 0), ("2022-01-01 08:10:00", 2, 1), ("2022-01-01 08:20:00", 3, 3)}


def test_loading_wrong_columns(spark, source):
    source.create_table(spark.createDataFrame([], "x int"), "test.other")
    with pytest.raises(ValueError, match="Columns do not match"):
        engine.delta_load(source, "test.other", bounded(source, STEPS[0][0]))


def test_an_update_after_a_delta_that_ends_later(spark, source):
    """The delta knows an end at its own bound, though no snapshot of then: an update before it isn't in order."""
    d = engine.delta_export(source, T, STEPS[0][0], STEPS[1][0])
    engine.delta_load(source, "test.late", d)
    with pytest.raises(RuntimeError, match="earlier than latest"):
        engine.update_snapshot(spark.createDataFrame(STEPS[0][1], COLS), source, "test.late", "2022-01-01 08:05:00")
