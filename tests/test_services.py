"""Identifiers, catalog, store, locks, logs, connectors and streams."""

import os
import subprocess
import sys
from datetime import datetime

import pytest

from chronostrata import engine
from chronostrata.operators.cow import BucketedTable
from chronostrata.sources import connectors
from chronostrata.sources.ident import TableId, unique_table_name
from chronostrata.sources.locks import break_lock, lock_table, locks, unlock_table
from chronostrata.sources.logs import Logger, LoggerNull, create_logs_if_missing
from chronostrata.sources.store import LATEST, close_connection, get_connection, table_signature, temporary_view
from chronostrata.streaming.sink import change_sink, snapshot_sink


def test_identifiers(spark, store):
    assert TableId.parse("cars") == TableId("cars") and TableId.parse("test.cars") == TableId("cars", "test") and TableId.parse("c.test.cars") == TableId("cars", "test", "c")
    assert store.id("cars") == TableId("cars", "main", "chronostrata") and store.id("test.cars") == TableId("cars", "test", "chronostrata")
    assert store.id("chronostrata.test.cars") == TableId("cars", "test", "chronostrata")
    assert store.id("nowhere.cars") == TableId("nowhere.cars", "main", "chronostrata")
    with pytest.raises(LookupError):
        TableId.parse("nowhere.cars", store, allow_table_only=False)
    assert str(TableId("t", "s", "c")) == "c.s.t" and TableId("a`b", "s").quoted() == "`s`.`a``b`"
    assert TableId.from_row(spark.createDataFrame([("s", "t")], "schema string, table string")) == TableId("t", "s")
    with pytest.raises(ValueError):
        TableId("")
    assert unique_table_name("x") != unique_table_name("x") and unique_table_name("x").startswith("x_")


def test_catalog(spark, store):
    cars = spark.createDataFrame([(1.0, 2.0)], "speed double, dist double")
    assert not store.table_exists("test.cars") and store.schema_exists("test") and store.schema_exists("main") and not store.schema_exists("none")
    empty = store.create_table(cars, "test.cars")
    assert empty.columns == ["speed", "dist", "checksum", "from_ts", "until_ts"] and empty.count() == 0
    assert [k for _, k in empty.dtypes][2:] == ["string", "timestamp_ntz", "timestamp_ntz"]
    with pytest.raises(ValueError, match="already exists"):
        store.create_table(cars, "test.cars")
    store.write_table(cars, "plain")
    assert store.table_exists("plain") and store.table_exists("main.plain") and store.table_exists("test.cars") and not store.table_exists(TableId("cars", "main"))
    assert {(r["schema"], r["table"]) for r in store.get_tables(show_temporary=False).collect()} == {("test", "cars"), ("main", "plain")}
    assert [r["table"] for r in store.get_tables("^test[.]c", False).collect()] == ["cars"] and store.get_table().count() >= 2
    with temporary_view(cars, "a_view"):
        assert store.table_exists("a_view") and store.get_table("a_view").count() == 1
    assert not store.table_exists("a_view")
    with pytest.raises(LookupError):
        store.get_table("test.none")
    store.drop("test.cars")
    assert not store.table_exists("test.cars")


def test_ambiguous_names(spark, store):
    one = spark.createDataFrame([(1,)], "a int")
    store.create_schema("test.one")
    store.write_table(one, TableId("one.two", "test"))
    store.write_table(one, TableId("two", "test.one"))
    with pytest.raises(LookupError, match="More than one table"):
        store.table_exists("test.one.two")
    assert store.table_exists(TableId("two", "test.one"))


def test_index_is_a_check(spark, store):
    store.write_table(spark.createDataFrame([(1, 1), (1, 2)], "a int, b int"), "t")
    store.create_index("t", ["a", "b"])
    assert store.state("t")["key"] == ["a", "b"] and store.get_table("t").count() == 2
    with pytest.raises(ValueError, match="not unique"):
        store.create_index("t", ["a"])


def test_types_survive(spark, store):
    df = spark.sql("SELECT DATE'2024-01-01' AS d, TIMESTAMP_NTZ'2024-01-01 10:00:00' AS p, 'x' AS c, 1 AS i, 1.5D AS n, true AS l, 1.25BD AS z")
    engine.update_snapshot(df, store, "test.types", "2024-01-01")
    assert [k for _, k in store.get_table("test.types").dtypes] == [k for _, k in df.dtypes] and store.get_table("test.types").collect() == df.collect()


def test_signatures(spark):
    df = spark.createDataFrame([], "checksum binary, a date, from_ts string, until_ts timestamp")
    assert table_signature(df) == {"checksum": "string", "a": "date", "from_ts": "timestamp_ntz", "until_ts": "timestamp_ntz"}
    assert table_signature(df.drop("until_ts"))["from_ts"] == "string"


def test_old_versions_go(spark, store, monkeypatch):
    for i in range(3):
        engine.update_snapshot(spark.createDataFrame([(i,)], "a int"), store, "test.kept", datetime(2024, 1, 1 + i))
    store.keep = 2
    store._retire(store.manifests("test.kept"))
    assert len(store.manifests("test.kept").versions()) == 4  # none is a day old
    store.keep, store.retain = 5, 0
    for i in range(9):
        engine.update_snapshot(spark.createDataFrame([(i,)], "a int"), store, "test.t", datetime(2024, 1, 1 + i))
    m = store.manifests("test.t")
    assert len(m.versions()) == store.keep
    assert store.get_table("test.t", None).count() == 9 and store.get_table("test.t", LATEST, True).count() == 1


def test_closed_parts_are_merged_in_tiers(spark, store, monkeypatch):
    from chronostrata.sources import store as module

    monkeypatch.setattr(module, "TIER", 3)
    for i in range(8):
        engine.update_snapshot(spark.createDataFrame([(i,)], "a int"), store, "test.t", datetime(2024, 1, 1 + i))
    closed = [p.get("tier", 0) for p in store.state("test.t")["parts"] if not p["is_open"]]
    assert len(closed) < 5 and max(closed) == 1
    got = sorted((r["a"], r["until_ts"] is None) for r in store.get_table("test.t", None).collect())
    assert got == [(i, i == 7) for i in range(8)]


def test_tables_know_their_names(spark, store):
    store.write_table(spark.createDataFrame([(1,)], "a int"), "test.t")
    t = store.get_table("test.t")
    assert store.id(t) == TableId("t", "test", "chronostrata") and store.table_exists(t) and store.table_exists(spark.createDataFrame([("test", "t")], "schema string, table string"))
    assert not store.table_exists(spark.createDataFrame([("test", "u")], "schema string, table string"))
    assert (store.get_schema(t), store.get_schema(TableId("x", "y")), store.get_schema(None), store.get_schema(store), store.get_catalog(t), store.get_catalog(None), store.get_catalog(TableId("x"))) == ("test", "y", None, "main", "chronostrata", None, None)
    with pytest.raises(ValueError, match="know its name"):
        store.table_exists(t.where("a = 1"))
    for bad in (5, None, ["test.t"]):
        with pytest.raises(TypeError):
            store.table_exists(bad)


def test_a_database(spark, tmp_path):
    """A real one: the database that Spark brings along."""
    url = connectors.jdbc_url("derby", f"{tmp_path}/db;create=true")
    assert connectors.can_connect(spark, url) and not connectors.can_connect(spark, connectors.jdbc_url("derby", f"{tmp_path}/none")) and not connectors.can_connect(spark, connectors.jdbc_url("postgresql", "none"))
    rows = spark.range(1000).selectExpr("id AS i", "CASE WHEN id % 3 > 0 THEN concat('n', id) END AS s")
    connectors.write_jdbc(rows, url, "app.things", "overwrite")
    connectors.write_jdbc(rows.where("i < 5").selectExpr("i + 1000 AS i", "s"), url, "app.things")
    assert [tuple(r) for r in connectors.jdbc_tables(spark, url, "THINGS$").collect()] == [("APP", "THINGS")]
    got = connectors.read_jdbc(spark, url, "app.things", "i", partitions=4)
    sizes = got.rdd.glom().map(len).collect()
    assert got.count() == 1005 and len(sizes) == 4 and max(sizes) < 300 and got.where("s IS NULL").count() == 336
    assert connectors.read_jdbc(spark, url, '(SELECT "i" FROM app.things WHERE "i" < 0) AS few', "i").count() == 0
    with pytest.raises(ValueError):
        connectors.jdbc_tables(spark, "jdbc:oracle:x")


def test_scratch_is_cleaned(spark):
    from chronostrata.session import clean, scratch

    path = scratch(spark, "x")
    spark.range(3).write.parquet(path)
    assert clean(spark)
    with pytest.raises(Exception, match="(?i)path_not_found|does not exist"):
        spark.read.parquet(path).count()


def test_connection(spark, tmp_path):
    s = get_connection(spark, f"file://{tmp_path}/x", schema="dflt")
    assert s.get_schema() == "dflt" and s.get_schema(temporary=True) is None and s.get_catalog() == "chronostrata"
    close_connection(s)
    assert not s.valid


def test_locks(spark, store):
    assert lock_table(store, "test.t") and lock_table(store, "test.t")
    assert [(r["schema"], r["table"], r["pid"]) for r in locks(store).collect()] == [("test", "t", os.getpid())]
    assert not unlock_table(store, "test.t", pid=1) and unlock_table(store, "test.t") and not unlock_table(store, "test.t")
    assert lock_table(store, "test.t", pid=1) and lock_table(store, "test.t") is False  # process 1 lives
    unlock_table(store, "test.t", pid=1)
    dead = subprocess.Popen([sys.executable, "-c", ""])
    dead.wait()
    lock_table(store, "test.t", pid=dead.pid)
    with pytest.raises(RuntimeError, match="is gone"):
        lock_table(store, "test.t")
    assert break_lock(store, "test.t") and not break_lock(store, "test.t")


def test_a_lock_of_another_machine_is_a_lease(spark, store, monkeypatch):
    from chronostrata.sources import locks as module

    with monkeypatch.context() as elsewhere:
        elsewhere.setattr(module.socket, "gethostname", lambda: "elsewhere")
        assert lock_table(store, "test.t", pid=7, lease=3600)
    assert lock_table(store, "test.t") is False and not break_lock(store, "test.t")
    with monkeypatch.context() as later:
        now = module.time.time()
        later.setattr(module.time, "time", lambda: now + 3601)
        with pytest.raises(RuntimeError, match="is gone"):
            lock_table(store, "test.t")
        assert break_lock(store, "test.t") and lock_table(store, "test.t")


def test_logger(spark, store, tmp_path, capsys):
    with pytest.warns(UserWarning, match="NO file or database logging"):
        Logger("test.t", "2024-01-01")
    log = Logger("test.t", "2024-01-01", log_table_id="test.logs", store=store, log_path=str(tmp_path), start_time=datetime(2024, 5, 1, 10, 30))
    assert log.log_filename == "20240501.1030.2024_01_01.chronostrata.test.t.log"
    line = log.log_info("rows:", 5, tic=datetime(2024, 5, 1, 10, 31))
    assert line.startswith("2024-05-01 10:31:00") and line.endswith(" - INFO - rows: 5") and line in capsys.readouterr().err
    log.log_info("silent", output_to_console=False)
    assert "silent" not in capsys.readouterr().err
    with pytest.warns(UserWarning, match="careful"):
        log.log_warn("careful")
    with pytest.raises(RuntimeError, match="broken"):
        log.log_error("broken")
    assert len(open(log.log_realpath).readlines()) == 4
    log.log_to_db(n_insertions=3, message="m")
    with pytest.raises(ValueError):
        log.log_to_db(nothing=1)
    log.finalize_db_entry(datetime(2024, 5, 1, 10, 32))
    log.finalize_db_entry()
    with pytest.raises(RuntimeError, match="closed"):
        log.log_to_db(n_insertions=4)
    log.set_timestamp("2024-01-01 00:00")  # the same instant
    assert log.finalized
    row = log.log_tbl.first()
    assert len(log.log_tbl.columns) == 12 and (row["n_insertions"], row["success"], row["duration"], row["log_file"], row["table"]) == (3, True, "120.00 secs", log.log_filename, "t")
    with pytest.raises(FileExistsError):
        Logger("test.t", "2024-01-01", store=store, log_path=str(tmp_path), start_time=datetime(2024, 5, 1, 10, 30)).log_filename
    log.set_timestamp("2024-02-01")
    log.finalize_db_entry()
    assert log.log_tbl.count() == 2 and create_logs_if_missing(store, "test.logs").count() == 2
    with pytest.raises(AttributeError):
        log.log_path = "x"
    null = LoggerNull("test.t")
    null.log_info("x"), null.log_to_db(a=1), null.finalize_db_entry()
    with pytest.raises(RuntimeError):
        null.log_error("still raises")


def test_settings_give_a_logger_its_table(spark, store):
    spark.conf.set("chronostrata.log_table_id", "test.logs")
    try:
        assert Logger("test.t", "2024-01-01", store=store).log_tbl.count() == 0
    finally:
        spark.conf.unset("chronostrata.log_table_id")


def test_files_and_urls(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    for kind in ("parquet", "orc", "csv", "json"):
        connectors.write_files(df, f"{tmp_path}/{kind}", kind)
        assert sorted(map(tuple, connectors.read_files(spark, f"{tmp_path}/{kind}", kind, "i int, s string").collect())) == [(1, "a"), (2, None)]
    assert connectors.jdbc_url("postgresql", "db") == "jdbc:postgresql://localhost:5432/db" and connectors.jdbc_url("sqlite", "/x.db") == "jdbc:sqlite:/x.db"
    for bad in (lambda: connectors.jdbc_url("oracle", "x"), lambda: connectors.jdbc_url("postgresql", "x", port=0), lambda: connectors.read_files(spark, "x", "xml")):
        with pytest.raises(ValueError):
            bad()


def test_streams(spark, store, tmp_path):
    batches = [[("A", 1, "2024-01-01")], [("A", 3, "2024-03-01")], [("A", 2, "2024-02-01"), ("B", 2, "2024-02-01")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, v int, t string").coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("k string, v int, t string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    when = lambda b, _: (r := b.first()) and r["t"]
    snapshot_sink(stream, store, "test.s", when, ["k", "v"], f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
    got = {(r["k"], r["v"], str(r["from_ts"])[5:7], None if r["until_ts"] is None else str(r["until_ts"])[5:7]) for r in store.get_table("test.s", None).collect()}
    assert got == {("A", 1, "01", "02"), ("A", 2, "02", "03"), ("B", 2, "02", "03"), ("A", 3, "03", None)}
    schema = spark.createDataFrame([], "k string, seq int, gone boolean").schema
    table = BucketedTable(spark, f"file://{tmp_path}/b", schema, ["k"], "seq", "gone", 4)
    change_sink(stream.selectExpr("k", "v AS seq", "k = 'B' AS gone"), table, f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in table.read().collect()] == [("A", 3, False)]
