"""Queries over the operators of the engine itself, each with the same question in SQL.

Instants are given as text on both sides. The snapshots S1-S3 are made of all rows of ``customer``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronostrata import engine
from chronostrata.functions.checksum import digest_to_checksum, unite
from chronostrata.functions.timestamps import db_timestamp
from chronostrata.operators import delta as deltas
from chronostrata.operators import history, joins, keys, rows, snapdiff
from chronostrata.operators.interlace import interlace
from chronostrata.operators.merkle_store import MerkleHistory
from chronostrata.session import load, scratch
from chronostrata.sources.store import LATEST, Store

T1, T2, T3 = "2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-03-01 00:00:00"
TABLE = "test.customers"
#: The events that each of the interlaced tables is made of.
_KINDS = {"a": "event_type <> 'view'", "b": "value > 100", "c": "event_type = 'click'"}


# -- Spark ----------------------------------------------------------------------------------------------------------


def _text(df: DataFrame, *more: str) -> DataFrame:
    """Timestamps, and numbers of the columns in ``more``, as text: numbers that can be null have no common form elsewhere."""
    return df.select(*[(F.col(f"`{c}`").cast("string") if k.startswith("timestamp") or c in more else F.col(f"`{c}`")).alias(c) for c, k in df.dtypes])


def _snapshot(spark: SparkSession, d: str, i: int) -> DataFrame:
    where, changed = {1: ("c_nationkey < 20", "false"), 2: ("c_nationkey < 23", "c_acctbal < 1500"), 3: ("c_nationkey >= 2", "c_acctbal < 700")}[i]
    c = load(spark, d, "customer").where(where)
    return c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.when(F.expr(changed), "CHANGED").otherwise(F.col("c_mktsegment")).alias("m"))


def _store(spark: SparkSession) -> Store:
    store = Store(spark, scratch(spark, "tables"))
    store.create_schema("test")
    return store


def _updated(spark: SparkSession, d: str, order: tuple[int, ...] = (1, 2, 3)) -> Store:
    store = _store(spark)
    for i in order:
        engine.update_snapshot(_snapshot(spark, d, i), store, TABLE, (T1, T2, T3)[i - 1], enforce_chronological_order=False)
    return store


def _islands(spark: SparkSession, d: str) -> DataFrame:
    return history.islands([(_snapshot(spark, d, i), t) for i, t in ((1, T1), (2, T2), (3, T3))], ["k", "n", "m"])


def scd_history(spark: SparkSession, d: str) -> DataFrame:
    return _text(_updated(spark, d).get_table(TABLE, None))


def scd_out_of_order(spark: SparkSession, d: str) -> DataFrame:
    return _text(_updated(spark, d, (3, 1, 2)).get_table(TABLE, None))


def scd_islands(spark: SparkSession, d: str) -> DataFrame:
    return _text(_islands(spark, d))


def scd_first_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return _text(_updated(spark, d, (1,)).get_table(TABLE, LATEST, include_slice_info=True))


def scd_current(spark: SparkSession, d: str) -> DataFrame:
    return _updated(spark, d).get_table(TABLE)


def scd_slice_t2(spark: SparkSession, d: str) -> DataFrame:
    return _updated(spark, d).get_table(TABLE, "2024-02-15 12:00")


def scd_noop_update(spark: SparkSession, d: str) -> DataFrame:
    return _text(_updated(spark, d, (1, 2, 2)).get_table(TABLE, None))


def scd_same_timestamp(spark: SparkSession, d: str) -> DataFrame:
    store = _updated(spark, d, (1,))
    for i in (2, 3):
        engine.update_snapshot(_snapshot(spark, d, i), store, TABLE, T2, collapse_continuous_records=True)
    return _text(store.get_table(TABLE, None))


def scd_update_counts(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark)
    got = [(i, *engine.update_snapshot(_snapshot(spark, d, i), store, TABLE, (T1, T2, T3)[i - 1]).values()) for i in (1, 2, 3)]
    return spark.createDataFrame(got, "step int, n_insertions int, n_deactivations int")


def scd_filtered_update(spark: SparkSession, d: str) -> DataFrame:
    store = _updated(spark, d, (1,))
    segment = spark.createDataFrame([("BUILDING",), ("CHANGED",)], "m string")
    engine.update_snapshot(_snapshot(spark, d, 3), store, TABLE, T2, filters=segment)
    return _text(store.get_table(TABLE, None))


def merkle_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same history, kept up one snapshot at a time by Merkle comparison."""
    schema = _snapshot(spark, d, 1).schema
    table = MerkleHistory(spark, scratch(spark, "merkle"), schema, ["k"], fanout=8)
    for i, t in ((1, T1), (2, T2), (3, T3)):
        table.apply(_snapshot(spark, d, i), t)
    return _text(table.read())


def slice_custom_cols(spark: SparkSession, d: str) -> DataFrame:
    return history.slice_time(load(spark, d, "slice_time"), "2022-01-01", "from_ts", "until_ts").select("rec_id", "region_id").distinct()


def slice_multi_cols(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "observations").withColumn("end_a", F.col("obs_ts") + F.expr("INTERVAL 1 DAY"))
    return history.slice_time(o, "2022-01-01", ["obs_ts", "received_at"], "end_a").select("obs_id").distinct()


def _people(spark: SparkSession, d: str) -> DataFrame:
    """All customers without their balance, and all of them again without a segment."""
    c = load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return c.unionByName(c.withColumn("c_mktsegment", F.lit(None).cast("string")))


def checksum_all(spark: SparkSession, d: str) -> DataFrame:
    return digest_to_checksum(_people(spark, d))


def checksum_exclude(spark: SparkSession, d: str) -> DataFrame:
    return digest_to_checksum(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), exclude=["o_orderkey"])


def unite_default(spark: SparkSession, d: str) -> DataFrame:
    return unite(load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "both", ["c_name", "c_mktsegment"])


def unite_keep(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "interlace").select("row_id", "key_id", "obs_2")
    return unite(c, "both", ["key_id", "obs_2"], sep="-", remove=False)


def unite_all(spark: SparkSession, d: str) -> DataFrame:
    return unite(_people(spark, d), "everything")


def _allowed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 2), ("MACHINERY", 3)], "c_mktsegment string, c_nationkey int")


def filter_keys_single(spark: SparkSession, d: str) -> DataFrame:
    return keys.filter_keys(load(spark, d, "customer"), _allowed(spark).select("c_mktsegment").distinct()).select("c_custkey", "c_mktsegment")


def filter_keys_composite(spark: SparkSession, d: str) -> DataFrame:
    return keys.filter_keys(load(spark, d, "customer"), _allowed(spark)).select("c_custkey", "c_mktsegment", "c_nationkey")


def filter_keys_null_key(spark: SparkSession, d: str) -> DataFrame:
    rows_ = load(spark, d, "interlace").select("row_id", "key_id", "obs_2")
    return keys.filter_keys(rows_, spark.createDataFrame([(None,)], "obs_2 string"))


def filter_keys_nulls_match(spark: SparkSession, d: str) -> DataFrame:
    rows_ = load(spark, d, "interlace").select("row_id", "key_id", "obs_2")
    return keys.filter_keys(rows_, rows_.select("obs_2").distinct(), nulls_match=True)


def filter_keys_empty(spark: SparkSession, d: str) -> DataFrame:
    return keys.filter_keys(load(spark, d, "customer"), _allowed(spark).limit(0)).agg(F.count(F.lit(1)).alias("n"))


def _xy(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = load(spark, d, "customer").select("c_custkey", F.expr("nullif(c_nationkey, 0)").alias("g"), F.col("c_mktsegment").alias("s"), F.col("c_name").alias("label"))
    y = load(spark, d, "nation").select(F.expr("nullif(n_regionkey * 10, 0)").alias("g"), F.expr("CASE WHEN n_regionkey < 3 THEN 'BUILDING' ELSE 'NONE' END").alias("s"), F.col("n_name").alias("label"), "n_nationkey")
    return x, y


def _join(how: str, kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        x, y = _xy(spark, d)
        if kind == "by":
            out = joins.join(x.drop("s"), y.drop("s"), how, by="g")
        elif kind == "na_by":
            out = joins.join(x.drop("s"), y.drop("s"), how, na_by="g")
        else:
            out = joins.join(x, y, how, by="s", na_by="g")
        return _text(out.withColumnsRenamed({"label.y": "label_y"}), "c_custkey", "g", "n_nationkey")

    return query


def join_theta(spark: SparkSession, d: str) -> DataFrame:
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    return _text(joins.join(n, r, "left", on="LHS.n_nationkey BETWEEN RHS.r_regionkey * 4 AND RHS.r_regionkey * 5"), "r_regionkey")


def not_in_null_aware(spark: SparkSession, d: str) -> DataFrame:
    """y holds nulls, so no row of x is known not to be in it; an empty y holds none."""
    x, y = _xy(spark, d)
    some, none = (joins.not_in(x.select("c_custkey", "g"), z.select("g"), "g") for z in (y, y.limit(0)))
    return _text(some.withColumn("y", F.lit("nulls")).unionByName(none.withColumn("y", F.lit("empty"))), "g")


def not_in_without_nulls(spark: SparkSession, d: str) -> DataFrame:
    x, y = _xy(spark, d)
    return joins.not_in(x.select("c_custkey", "g"), y.where("g IS NOT NULL").select("g"), "g").select("c_custkey", "g")


def _stays(spark: SparkSession, d: str, kind: str, value: str) -> DataFrame:
    """Intervals per user: each event of a kind begins one, which ends with the user's next of that kind."""
    e = load(spark, d, "events").where(kind).groupBy("user_id", "ts").agg(F.max("event_id").alias(value))
    return e.select("user_id", value, F.col("ts").alias("valid_from"), F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts")).alias("valid_until"))


def interlace_two(spark: SparkSession, d: str) -> DataFrame:
    return _text(interlace([_stays(spark, d, _KINDS["a"], "a"), _stays(spark, d, _KINDS["b"], "b")], "user_id"), "a", "b")


def interlace_three_named(spark: SparkSession, d: str) -> DataFrame:
    b = _stays(spark, d, _KINDS["b"], "b").withColumnsRenamed({"valid_from": "start", "valid_until": "stop"})
    tables = [_stays(spark, d, _KINDS["a"], "a"), b, _stays(spark, d, _KINDS["c"], "c")]
    return _text(interlace(tables, ["user_id"], {"t2.from": "start", "t2.until": "stop"}), "a", "b", "c")


def nrow_table(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(keys.nrow(load(spark, d, "lineitem")),)], "n long")


def count_by_ts(spark: SparkSession, d: str) -> DataFrame:
    return _text(deltas.changes_by_instant(_islands(spark, d)))


def delta_open(spark: SparkSession, d: str) -> DataFrame:
    return _text(engine.delta_export(_updated(spark, d), TABLE, T2).data)


def delta_bounded(spark: SparkSession, d: str) -> DataFrame:
    return _text(deltas.export_delta(_islands(spark, d), T1, T2).data)


def _replayed(spark: SparkSession, d: str, order: tuple[int, ...]) -> DataFrame:
    source, target = _updated(spark, d), _store(spark)
    bounds = ((T1, "2024-01-01 00:00:01"), (T2, "2024-02-01 00:00:01"), (T3, "2024-03-01 00:00:01"))
    engine.delta_load(target, TABLE, [engine.delta_export(source, TABLE, *bounds[k]) for k in order])
    return _text(target.get_table(TABLE, None))


def delta_replay(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d, (0, 1, 2))


def delta_replay_out_of_order(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d, (2, 0, 1, 0))


def delta_log_counts(spark: SparkSession, d: str) -> DataFrame:
    h = _islands(spark, d)
    return _text(deltas.delta_counts(h.limit(0), deltas.export_delta(h, T1).data))


def delta_log_counts_again(spark: SparkSession, d: str) -> DataFrame:
    """Into a table that has the first delta already: what it knows is neither inserted nor, if it knew the end, ended again."""
    h = _islands(spark, d)
    target = deltas.apply_delta(h.limit(0), deltas.export_delta(h, T1, "2024-01-15").data)
    return _text(deltas.delta_counts(target, deltas.export_delta(h, T1).data))


def _base(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") < 3000, None).otherwise(F.col("c_mktsegment")).alias("m"))


def _edits(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").where("c_nationkey >= 10").select(F.col("c_custkey").alias("k"), F.lit("EDIT").alias("m"))


def rows_upsert(spark: SparkSession, d: str) -> DataFrame:
    return rows.rows_upsert(_base(spark, d), _edits(spark, d), ["k"])


def rows_update(spark: SparkSession, d: str) -> DataFrame:
    return rows.rows_update(_base(spark, d), _edits(spark, d), ["k"])


def rows_patch(spark: SparkSession, d: str) -> DataFrame:
    return rows.rows_patch(_base(spark, d), _edits(spark, d), ["k"])


def rows_insert(spark: SparkSession, d: str) -> DataFrame:
    return rows.rows_insert(_base(spark, d), _edits(spark, d), ["k"])


def rows_append(spark: SparkSession, d: str) -> DataFrame:
    return rows.rows_append(_base(spark, d), _edits(spark, d))


def rows_delete(spark: SparkSession, d: str) -> DataFrame:
    return rows.rows_delete(_base(spark, d), _edits(spark, d), ["k"])


def slice_max(spark: SparkSession, d: str) -> DataFrame:
    return history.slice_max(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey", ["o_custkey", "o_orderpriority"])


def literal_update(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark)
    for i, t in ((1, T1), (2, T2), (3, T3)):
        engine.update_snapshot(_snapshot(spark, d, i), store, TABLE, t, literal=True)
    return _text(store.get_table(TABLE, None))


def literal_late(spark: SparkSession, d: str) -> DataFrame:
    """The second snapshot comes last: what it lacks loses its later part, by the older rules."""
    store = _store(spark)
    for i, t in ((1, T1), (3, T3), (2, T2)):
        engine.update_snapshot(_snapshot(spark, d, i), store, TABLE, t, literal=True, enforce_chronological_order=False)
    return _text(store.get_table(TABLE, None))


def scd_colliding(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that share a checksum: '_' within values, and null beside ''. All of them are kept, and end alone."""
    def payload(step: int) -> DataFrame:
        c = load(spark, d, "customer").where("c_nationkey < 20" if step == 1 else "c_nationkey >= 5")
        pairs = F.explode(F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in (
            (F.concat(F.col("c_custkey").cast("string"), F.lit("_x")), F.lit("y")), (F.col("c_custkey").cast("string"), F.lit("x_y")),
            (F.lit(""), F.col("c_name")), (F.lit(None).cast("string"), F.col("c_name")))])).alias("p")
        rows_ = c.select("c_custkey", pairs).select("p.a", "p.b", "c_custkey")
        return rows_.where("c_custkey % 2 = 0 OR a IS NOT NULL" if step == 1 else "c_custkey % 3 = 0 OR b <> 'x_y'").select("a", "b").distinct()

    store = _store(spark)
    for step, t in ((1, T1), (2, T2)):
        engine.update_snapshot(payload(step), store, TABLE, t)
    return _text(store.get_table(TABLE, None))


def lock_states(spark: SparkSession, d: str) -> DataFrame:
    from chronostrata.sources.locks import lock_table, locks, unlock_table

    store = _updated(spark, d, (1,))
    got = [("taken", lock_table(store, TABLE)), ("renewed", lock_table(store, TABLE)), ("another's", lock_table(store, TABLE, pid=1)), ("not another's to give", unlock_table(store, TABLE, pid=1))]
    got += [("listed", locks(store).count() == 1), ("given back", unlock_table(store, TABLE)), ("gone", locks(store).count() == 0), ("free", lock_table(store, TABLE))]
    return spark.createDataFrame(got, "step string, result boolean")


def index_of_table(spark: SparkSession, d: str) -> DataFrame:
    store = _updated(spark, d, (1,))
    store.create_index(TABLE, ["k", "from_ts"])
    try:
        store.create_index(TABLE, ["m"])
    except ValueError:
        return store.get_table(TABLE, None).select("k", F.lit(",".join(store.state(TABLE)["key"])).alias("key"))


def table_ids(spark: SparkSession, d: str) -> DataFrame:
    store = _updated(spark, d, (1,))
    t = store.get_table(TABLE)
    got = [("table", str(store.id(t)), store.table_exists(t)), ("row", str(store.id(store.get_tables("customers", False))), store.table_exists(store.get_tables("customers", False)))]
    got += [("text", str(store.id(TABLE)), store.table_exists(TABLE)), ("unknown", str(store.id("none")), store.table_exists("none")), ("schema", store.get_schema(t), True), ("catalog", store.get_catalog(t), True)]
    return spark.createDataFrame(got, "what string, id string, found boolean")


def checksum_sha256(spark: SparkSession, d: str) -> DataFrame:
    return digest_to_checksum(_people(spark, d), algorithm="sha256")


def snapshot_difference(spark: SparkSession, d: str) -> DataFrame:
    return snapdiff.between(_snapshot(spark, d, 2), _snapshot(spark, d, 3), ["k"])


def list_tables(spark: SparkSession, d: str) -> DataFrame:
    return _updated(spark, d, (1,)).get_tables("customers", show_temporary=False).select("schema", "table")


def table_exists(spark: SparkSession, d: str) -> DataFrame:
    store = _updated(spark, d, (1,))
    return spark.createDataFrame([(n, store.table_exists(n)) for n in (TABLE, "test.none")], "name string, found boolean")


def log_table(spark: SparkSession, d: str) -> DataFrame:
    from chronostrata.sources.logs import Logger

    store = _store(spark)
    for i, t in ((1, T1), (2, T2), (3, T3)):
        logger = Logger(TABLE, t, output_to_console=False, log_table_id="test.logs", store=store, warn=False)
        engine.update_snapshot(_snapshot(spark, d, i), store, TABLE, t, logger=logger)
    return _text(store.get_table("test.logs").select("date", "schema", "table", "n_insertions", "n_deactivations", "success"))


def db_timestamp_literals(spark: SparkSession, d: str) -> DataFrame:
    from datetime import date, datetime

    values = [date(2024, 3, 1), datetime(2024, 3, 1), "2024-03-01", "2024-03-01 00:00", "2024-03-01 00:00:00"]
    return _text(reduce(DataFrame.unionAll, [spark.range(1).select(F.lit(i).alias("i"), db_timestamp(v).alias("ts")) for i, v in enumerate(values)]))


QUERIES = {f.__name__: f for f in (
    scd_history, scd_out_of_order, scd_islands, scd_first_snapshot, scd_current, scd_slice_t2, scd_noop_update, scd_same_timestamp,
    scd_update_counts, scd_filtered_update, merkle_stored, slice_custom_cols, slice_multi_cols, checksum_all, checksum_exclude, unite_default, unite_keep, unite_all,
    filter_keys_single, filter_keys_composite, filter_keys_null_key, filter_keys_nulls_match, filter_keys_empty, join_theta, not_in_null_aware, not_in_without_nulls, scd_colliding,
    interlace_two, interlace_three_named, nrow_table, count_by_ts, delta_open, delta_bounded, delta_replay, delta_replay_out_of_order, delta_log_counts, delta_log_counts_again, literal_late, lock_states, index_of_table, table_ids,
    rows_upsert, rows_update, rows_patch, rows_insert, rows_append, rows_delete, snapshot_difference, slice_max, literal_update, checksum_sha256, list_tables, table_exists, log_table, db_timestamp_literals,
)} | {f"join_{how}_{kind}": _join(how, kind) for how in joins.HOW for kind in ("by", "na_by", "mixed")}


# -- SQL ------------------------------------------------------------------------------------------------------------

_S = {
    1: "SELECT c_custkey AS k, c_name AS n, c_mktsegment AS m FROM customer WHERE c_nationkey < 20",
    2: "SELECT c_custkey AS k, c_name AS n, CASE WHEN c_acctbal < 1500 THEN 'CHANGED' ELSE c_mktsegment END AS m FROM customer WHERE c_nationkey < 23",
    3: "SELECT c_custkey AS k, c_name AS n, CASE WHEN c_acctbal < 700 THEN 'CHANGED' ELSE c_mktsegment END AS m FROM customer WHERE c_nationkey >= 2",
}
_SUM = "md5(CAST(k AS VARCHAR) || '_' || n || '_' || m)"


def _history_sql(steps: list[tuple[int, str]], columns: str = "k, n, m, checksum, from_ts, until_ts", where: str = "true") -> str:
    """Runs of consecutive snapshots in closed form, as ``columns`` of the rows that meet ``where``."""
    union = " UNION ALL ".join(f"SELECT {i} AS i, * FROM ({_S[s]}) AS s{i}" for i, (s, _) in enumerate(steps, 1))
    when = lambda e: f"CASE {e} " + " ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(steps, 1)) + " END"
    return f"""WITH s AS ({union}), g AS (SELECT *, i - row_number() OVER (PARTITION BY k, n, m ORDER BY i) AS g FROM s),
        r AS (SELECT k, n, m, min(i) AS a, max(i) + 1 AS b FROM g GROUP BY k, n, m, g),
        h AS (SELECT k, n, m, {_SUM} AS checksum, {when('a')} AS from_ts, {when('b')} AS until_ts FROM r)
        SELECT {columns} FROM h WHERE {where}"""


_ALL3 = [(1, T1), (2, T2), (3, T3)]
_X = "(SELECT c_custkey, nullif(c_nationkey, 0) AS g, c_mktsegment AS s, c_name AS label FROM customer)"
_Y = "(SELECT nullif(n_regionkey * 10, 0) AS g, CASE WHEN n_regionkey < 3 THEN 'BUILDING' ELSE 'NONE' END AS s, n_name AS label, n_nationkey FROM nation)"
_ON = {"by": "x.g = y.g", "na_by": "x.g IS NOT DISTINCT FROM y.g", "mixed": "x.s = y.s AND x.g IS NOT DISTINCT FROM y.g"}


def _join_sql(how: str, kind: str) -> str:
    keyed = ["g", "s"] if kind == "mixed" else ["g"]
    if how in ("semi", "anti"):
        cols = "CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(g AS VARCHAR) AS g, label" + ", s" * (kind == "mixed")
        return f"SELECT {cols} FROM {_X} AS x WHERE {'NOT ' * (how == 'anti')}EXISTS (SELECT 1 FROM {_Y} AS y WHERE {_ON[kind]})"
    key = ", ".join(f"CAST(coalesce(x.{k}, y.{k}) AS VARCHAR) AS {k}" for k in keyed)
    return f"SELECT CAST(x.c_custkey AS VARCHAR) AS c_custkey, {key}, x.label AS label, y.label AS label_y, CAST(y.n_nationkey AS VARCHAR) AS n_nationkey FROM {_X} AS x {how.upper()} JOIN {_Y} AS y ON {_ON[kind]}"


def _stays_sql(kind: str, value: str) -> str:
    return f"(SELECT user_id, {value}, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_until FROM (SELECT user_id, ts, max(event_id) AS {value} FROM events WHERE {kind} GROUP BY user_id, ts) AS p)"


def _interlace_sql(tables: list[str]) -> str:
    parts = [_stays_sql(_KINDS[v], v) for v in tables]
    ends = " UNION ".join(f"SELECT user_id, valid_from AS t FROM {p} AS u{k} UNION SELECT user_id, valid_until FROM {p} AS w{k}" for k, p in enumerate(parts))
    joined = " ".join(f"LEFT JOIN {p} AS t{k} ON t{k}.user_id = axis.user_id AND axis.f >= t{k}.valid_from AND (t{k}.valid_until IS NULL OR axis.u <= t{k}.valid_until)" for k, p in enumerate(parts))
    values = ", ".join(f"CAST(t{k}.{v} AS VARCHAR) AS {v}" for k, v in enumerate(tables))
    return f"""WITH points AS ({ends}), axis AS (SELECT user_id, t AS f, lead(t) OVER (PARTITION BY user_id ORDER BY t NULLS LAST) AS u, row_number() OVER (PARTITION BY user_id ORDER BY t NULLS LAST) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM points)
        SELECT axis.user_id, {values}, CAST(axis.f AS VARCHAR) AS valid_from, CAST(axis.u AS VARCHAR) AS valid_until FROM axis {joined} WHERE axis.i < axis.n"""


_COUNTS = """SELECT ts, CAST(sum(i) AS INTEGER) AS n_insertions, CAST(sum(d) AS INTEGER) AS n_deactivations FROM (SELECT from_ts AS ts, 1 AS i, 0 AS d FROM hist UNION ALL SELECT until_ts, 0, 1 FROM hist WHERE until_ts IS NOT NULL) AS c GROUP BY ts"""
_FULL = _history_sql(_ALL3)
_BASE = "(SELECT c_custkey AS k, CASE WHEN c_acctbal < 3000 THEN NULL ELSE c_mktsegment END AS m FROM customer WHERE c_nationkey < 20)"
_EDIT = "(SELECT c_custkey AS k, 'EDIT' AS m FROM customer WHERE c_nationkey >= 10)"
_ALLOWED = "(SELECT * FROM (VALUES ('BUILDING', 1), ('MACHINERY', 2), ('MACHINERY', 3)) AS v(seg, nat))"
_ROWS = lambda a, b: f"SELECT (SELECT count(*) FROM ({_S[a]} EXCEPT {_S[b]}) AS q) "
_CUT = lambda i, a, b: f"SELECT {i} AS step, CAST((SELECT count(*) FROM ({_S[b]} EXCEPT {a}) AS p) AS INTEGER) AS n_insertions, CAST((SELECT count(*) FROM ({a} EXCEPT {_S[b]}) AS q) AS INTEGER) AS n_deactivations"
_PEOPLE = "(SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey, c_name, c_nationkey, NULL FROM customer) AS q"
_JOINED = "CAST(c_custkey AS VARCHAR) || '_' || c_name || '_' || CAST(c_nationkey AS VARCHAR) || '_' || coalesce(c_mktsegment, '')"
_NONE = "SELECT * FROM (" + _S[1] + ") AS none WHERE false"

SQL = {
    "scd_history": _FULL,
    "scd_out_of_order": _FULL,
    "scd_islands": _FULL,
    "scd_first_snapshot": _history_sql([(1, T1)]),
    "scd_current": _S[3],
    "scd_slice_t2": _S[2],
    "scd_noop_update": _history_sql([(1, T1), (2, T2)]),
    "scd_same_timestamp": _history_sql([(1, T1), (3, T2)]),
    "scd_update_counts": " UNION ALL ".join([_CUT(1, _NONE, 1), _CUT(2, _S[1], 2), _CUT(3, _S[2], 3)]),
    "scd_filtered_update": f"""WITH a AS ({_S[1]}), b AS ({_S[3]}), f AS (SELECT * FROM b WHERE m IN ('BUILDING', 'CHANGED'))
        SELECT k, n, m, {_SUM} AS checksum, '{T1}' AS from_ts, CASE WHEN m IN ('BUILDING', 'CHANGED') AND NOT EXISTS (SELECT 1 FROM f WHERE f.k = a.k AND f.n = a.n AND f.m = a.m) THEN '{T2}' END AS until_ts FROM a
        UNION ALL SELECT k, n, m, {_SUM}, '{T2}', NULL FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE f.k = a.k AND f.n = a.n AND f.m = a.m)""",
    "merkle_stored": _history_sql(_ALL3, "k, n, m, from_ts, until_ts"),
    "slice_custom_cols": "SELECT DISTINCT rec_id, region_id FROM slice_time WHERE from_ts <= TIMESTAMP '2022-01-01' AND (until_ts IS NULL OR TIMESTAMP '2022-01-01' < until_ts)",
    "slice_multi_cols": "SELECT DISTINCT obs_id FROM observations WHERE (obs_ts <= TIMESTAMP '2022-01-01' OR received_at <= TIMESTAMP '2022-01-01') AND (obs_ts IS NULL OR TIMESTAMP '2022-01-01' < obs_ts + INTERVAL 1 DAY)",
    "checksum_all": f"SELECT *, md5({_JOINED}) AS checksum FROM {_PEOPLE}",
    "checksum_exclude": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, md5(CAST(o_custkey AS VARCHAR) || '_' || o_orderstatus || '_' || o_orderpriority) AS checksum FROM orders",
    "unite_default": "SELECT c_custkey, nullif(concat_ws('_', c_name, c_mktsegment), '') AS both FROM customer",
    "unite_keep": "SELECT row_id, nullif(concat_ws('-', key_id, obs_2), '') AS both, key_id, obs_2 FROM interlace",
    "unite_all": f"SELECT concat_ws('_', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment) AS everything FROM {_PEOPLE}",
    "filter_keys_single": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "filter_keys_composite": f"SELECT c_custkey, c_mktsegment, c_nationkey FROM customer JOIN {_ALLOWED} AS a ON a.seg = c_mktsegment AND a.nat = c_nationkey",
    "filter_keys_null_key": "SELECT row_id, key_id, obs_2 FROM interlace WHERE obs_2 IS NULL",
    "filter_keys_nulls_match": "SELECT row_id, key_id, i.obs_2 FROM interlace AS i JOIN (SELECT DISTINCT obs_2 FROM interlace) AS f ON i.obs_2 IS NOT DISTINCT FROM f.obs_2",
    "filter_keys_empty": "SELECT CAST(0 AS BIGINT) AS n",
    "join_theta": "SELECT n.*, CAST(r.r_regionkey AS VARCHAR) AS r_regionkey, r.r_name FROM nation AS n LEFT JOIN region AS r ON n.n_nationkey BETWEEN r.r_regionkey * 4 AND r.r_regionkey * 5",
    "not_in_null_aware": f"SELECT c_custkey, CAST(g AS VARCHAR) AS g, 'nulls' AS y FROM {_X} AS x WHERE g NOT IN (SELECT g FROM {_Y} AS y) UNION ALL SELECT c_custkey, CAST(g AS VARCHAR), 'empty' FROM {_X} AS x WHERE g NOT IN (SELECT g FROM {_Y} AS y WHERE false)",
    "not_in_without_nulls": f"SELECT c_custkey, g FROM {_X} AS x WHERE g NOT IN (SELECT g FROM {_Y} AS y WHERE g IS NOT NULL)",
    "interlace_two": _interlace_sql(["a", "b"]),
    "interlace_three_named": _interlace_sql(["a", "b", "c"]),
    "nrow_table": "SELECT count(*) AS n FROM lineitem",
    "count_by_ts": f"WITH hist AS ({_FULL}) {_COUNTS}",
    "delta_open": _history_sql(_ALL3, where=f"from_ts >= '{T2}' OR until_ts >= '{T2}'"),
    "delta_bounded": _history_sql(_ALL3, f"k, n, m, checksum, from_ts, CASE WHEN until_ts > '{T2}' THEN NULL ELSE until_ts END AS until_ts", f"(from_ts >= '{T1}' AND from_ts < '{T2}') OR (until_ts >= '{T1}' AND until_ts < '{T2}')"),
    "delta_replay": _FULL,
    "delta_replay_out_of_order": _FULL,
    "delta_log_counts": f"WITH hist AS ({_FULL}) {_COUNTS}",
    "delta_log_counts_again": f"""WITH hist AS ({_FULL}) SELECT ts, CAST(sum(i) AS INTEGER) AS n_insertions, CAST(sum(d) AS INTEGER) AS n_deactivations FROM (
        SELECT from_ts AS ts, 1 AS i, 0 AS d FROM hist WHERE from_ts >= '2024-01-15' UNION ALL SELECT until_ts, 0, 1 FROM hist WHERE until_ts IS NOT NULL) AS c GROUP BY ts""",
    "literal_late": f"""WITH a AS ({_S[1]}), b AS ({_S[2]}), c AS ({_S[3]}), u AS (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c),
        g AS (SELECT *, (k, n, m) IN (SELECT (k, n, m) FROM a) AS in1, (k, n, m) IN (SELECT (k, n, m) FROM b) AS in2, (k, n, m) IN (SELECT (k, n, m) FROM c) AS in3 FROM u)
        SELECT k, n, m, {_SUM} AS checksum, CASE WHEN in1 THEN '{T1}' WHEN in2 THEN '{T2}' ELSE '{T3}' END AS from_ts, CASE WHEN in1 AND NOT in2 THEN '{T2}' WHEN NOT in3 THEN '{T3}' END AS until_ts FROM g""",
    "scd_colliding": f"""WITH c AS (SELECT c_custkey, c_nationkey, CASE i WHEN 1 THEN CAST(c_custkey AS VARCHAR) || '_x' WHEN 2 THEN CAST(c_custkey AS VARCHAR) WHEN 3 THEN '' END AS a, CASE i WHEN 1 THEN 'y' WHEN 2 THEN 'x_y' ELSE c_name END AS b FROM customer, (VALUES (1), (2), (3), (4)) AS v(i)),
        s AS (SELECT DISTINCT a, b FROM c WHERE c_nationkey < 20 AND (c_custkey % 2 = 0 OR a IS NOT NULL)), t AS (SELECT DISTINCT a, b FROM c WHERE c_nationkey >= 5 AND (c_custkey % 3 = 0 OR b <> 'x_y'))
        SELECT coalesce(s.a, t.a) AS a, coalesce(s.b, t.b) AS b, md5(coalesce(s.a, t.a, '') || '_' || coalesce(s.b, t.b)) AS checksum, CASE WHEN s.b IS NULL THEN '{T2}' ELSE '{T1}' END AS from_ts, CASE WHEN t.b IS NULL THEN '{T2}' END AS until_ts
        FROM s FULL JOIN t ON s.a IS NOT DISTINCT FROM t.a AND s.b = t.b""",
    "lock_states": "SELECT * FROM (VALUES ('taken', true), ('renewed', true), ('another''s', false), ('not another''s to give', false), ('listed', true), ('given back', true), ('gone', true), ('free', true)) AS v(step, result)",
    "index_of_table": f"SELECT k, 'k,from_ts' AS key FROM ({_S[1]}) AS s",
    "table_ids": "SELECT * FROM (VALUES ('table', 'chronostrata.test.customers', true), ('row', 'chronostrata.test.customers', true), ('text', 'chronostrata.test.customers', true), ('unknown', 'chronostrata.main.none', false), ('schema', 'test', true), ('catalog', 'chronostrata', true)) AS v(what, id, found)",
    "rows_upsert": f"SELECT coalesce(x.k, y.k) AS k, CASE WHEN y.k IS NOT NULL THEN y.m ELSE x.m END AS m FROM {_BASE} AS x FULL JOIN {_EDIT} AS y ON x.k = y.k",
    "rows_update": f"SELECT x.k, CASE WHEN y.k IS NOT NULL THEN y.m ELSE x.m END AS m FROM {_BASE} AS x LEFT JOIN {_EDIT} AS y ON x.k = y.k",
    "rows_patch": f"SELECT x.k, coalesce(x.m, y.m) AS m FROM {_BASE} AS x LEFT JOIN {_EDIT} AS y ON x.k = y.k",
    "rows_insert": f"SELECT k, m FROM {_BASE} AS x UNION ALL SELECT k, m FROM {_EDIT} AS y WHERE k NOT IN (SELECT k FROM {_BASE} AS z)",
    "rows_append": f"SELECT k, m FROM {_BASE} AS x UNION ALL SELECT k, m FROM {_EDIT} AS y",
    "rows_delete": f"SELECT k, m FROM {_BASE} AS x WHERE k NOT IN (SELECT k FROM {_EDIT} AS y)",
    "snapshot_difference": f"""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS kind
        FROM ({_S[2]}) AS a FULL JOIN ({_S[3]}) AS b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.n <> b.n OR a.m <> b.m""",
    "slice_max": "SELECT o_orderkey, o_custkey, o_orderpriority FROM (SELECT *, rank() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS r FROM orders) AS q WHERE r = 1",
    "literal_update": _FULL,
    "checksum_sha256": f"SELECT *, sha256({_JOINED}) AS checksum FROM {_PEOPLE}",
    "list_tables": "SELECT 'test' AS schema, 'customers' AS \"table\"",
    "table_exists": "SELECT 'test.customers' AS name, true AS found UNION ALL SELECT 'test.none', false",
    "log_table": "SELECT CASE step WHEN 1 THEN '" + T1 + "' WHEN 2 THEN '" + T2 + "' ELSE '" + T3 + "' END AS date, 'test' AS schema, 'customers' AS \"table\", n_insertions, n_deactivations, true AS success FROM (" + " UNION ALL ".join([_CUT(1, _NONE, 1), _CUT(2, _S[1], 2), _CUT(3, _S[2], 3)]) + ") AS c",
    "db_timestamp_literals": " UNION ALL ".join(f"SELECT {i} AS i, '{T3}' AS ts" for i in range(5)),
} | {f"join_{how}_{kind}": _join_sql(how, kind) for how in joins.HOW for kind in ("by", "na_by", "mixed")}
