"""Point-in-time reads of type-2 history and its update from snapshots.

A historical table is payload + checksum, from_ts, until_ts; a row holds in [from_ts, until_ts), without end if
until_ts is null.

The checksum is what readers see, and different payloads can share one (null and '' look alike in it, and '_' in a
value looks like the separator). So records are told apart by ``identity``, under which they can't.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from chronostrata.functions.checksum import checksum_of
from chronostrata.functions.timestamps import Timestamp, db_timestamp
from chronostrata.operators.keys import META, filter_keys
from chronostrata.session import fresh_name


def slice_time(df: DataFrame, slice_ts: Timestamp, from_ts: str | list[str] = "from_ts", until_ts: str | list[str] = "until_ts") -> DataFrame:
    """The rows that hold at ``slice_ts``. Of several columns any may meet its condition."""
    t = db_timestamp(slice_ts)
    names = lambda c: [c] if isinstance(c, str) else list(c)
    either = lambda terms: reduce(lambda a, b: a | b, terms)
    return df.where(either([F.col(c) <= t for c in names(from_ts)])).where(either([F.col(c).isNull() | (t < F.col(c)) for c in names(until_ts)]))


def current(df: DataFrame) -> DataFrame:
    return df.where("until_ts IS NULL")


@dataclass(frozen=True)
class SnapshotResult:
    """The new history, and one row (n_insertions, n_deactivations)."""

    history: DataFrame
    counts: DataFrame


def identity(df: DataFrame, payload: list[str]) -> Column:
    """One text for each distinct payload, null and '' apart."""
    return checksum_of(df, payload, safe=True)


def _payload(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in META]


def stitch(history: DataFrame) -> DataFrame:
    """Joins rows of one record whose intervals touch or overlap, and drops empty ones."""
    new, island, ident = (fresh_name(n, history.columns) for n in ("_new", "_island", "_id"))
    w = Window.partitionBy(ident).orderBy("from_ts", F.col("until_ts").asc_nulls_last())
    far = F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz")
    reach = F.max(F.coalesce("until_ts", far)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    payload = _payload(history.columns)
    rows = purge(history).withColumn(ident, identity(history, payload)).withColumn(new, F.when(reach.isNull() | (reach < F.col("from_ts")), 1).otherwise(0))
    rows = rows.withColumn(island, F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.max(F.coalesce("until_ts", far))
    merged = rows.groupBy(ident, island).agg(*[F.first(f"`{c}`").alias(c) for c in [*payload, "checksum"]], F.min("from_ts").alias("from_ts"), F.nullif(end, far).alias("until_ts"))
    return merged.select(history.columns)


def purge(history: DataFrame) -> DataFrame:
    """Without rows of zero length."""
    return history.where("until_ts IS NULL OR from_ts <> until_ts")


def checksummed(snapshot: DataFrame, payload: list[str], filters: DataFrame | None = None, safe: bool = False, ident: str | None = None) -> DataFrame:
    """The snapshot's rows inside ``filters``, in the target's column order, with their checksum and, as ``ident`` if that
    is named, their identity; repeated rows once."""
    rows = filter_keys(snapshot, filters).select(*[f"`{c}`" for c in payload])
    name = ident or fresh_name("_id", [*payload, "checksum"])
    once = rows.withColumns({"checksum": checksum_of(rows, payload, safe), name: identity(rows, payload)}).dropDuplicates([name])
    return once if ident else once.drop(name)


def _scoped(history: DataFrame, filters: DataFrame | None, ident: str, inside: str) -> DataFrame:
    """``history`` with its identities, and the column ``inside``: whether a row lies inside the filters."""
    payload = _payload(history.columns)
    rows = history.withColumn(ident, identity(history, payload))
    if filters is None:
        return rows.withColumn(inside, F.lit(True))
    kept = filter_keys(history, filters.distinct())
    keys = kept.select(identity(kept, payload).alias(ident)).distinct().withColumn(inside, F.lit(True))
    return rows.join(keys, ident, "left").withColumn(inside, F.coalesce(inside, F.lit(False)))


def apply_snapshot(history: DataFrame, snapshot: DataFrame, timestamp: Timestamp, upcoming: Timestamp | None = None, filters: DataFrame | None = None, safe: bool = False, fresh: bool = False, observation: Observation | None = None) -> SnapshotResult:
    """The history after the snapshot taken at ``timestamp``.

    ``upcoming`` is the instant of the next snapshot that was applied already (None if this is the latest). It must come
    from the registry of snapshots, not from the history, which can't show snapshots that changed nothing. Records
    outside ``filters`` are left alone. Of a record that held across the snapshot and isn't in it, the part before
    stays, and the part from ``upcoming`` on, where a later snapshot had confirmed it. One full join by identity.

    With ``fresh`` the caller vouches that ``timestamp`` is later than every snapshot so far: nothing can have become
    adjacent then, and ``history`` may be its open rows alone. ``observation`` gets the counts as the result is written.
    """
    payload = _payload(history.columns)
    ident, inside = (fresh_name(n, history.columns) for n in ("_id", "_in"))
    t, nxt = db_timestamp(timestamp), db_timestamp(upcoming)
    held = F.col(inside) & (F.col("from_ts") <= t) & (F.col("until_ts").isNull() | (t < F.col("until_ts")))
    rows = _scoped(history, filters, ident, inside)
    columns = [F.col(f"`{c}`") for c in history.columns]
    rest = rows.where(~F.coalesce(held, F.lit(False))).select(*columns)
    new = checksummed(snapshot, payload, filters, safe, ident)
    left = rows.where(held).select(F.col(ident).alias("id"), F.struct(*columns).alias("h"))
    right = new.select(F.col(ident).alias("id"), F.struct(*[F.col(f"`{c}`") for c in [*payload, "checksum"]]).alias("s"))
    both = left.join(right, "id", "full")
    tallies = [F.count_if(F.col("h").isNull()).cast("int").alias("n_insertions"), F.count_if(F.col("s").isNull()).cast("int").alias("n_deactivations")]
    if observation is not None:
        both = both.observe(observation, *tallies)
    row = lambda source, a, b: F.struct(*[F.col(f"{source}.`{c}`").alias(c) for c in [*payload, "checksum"]], a.alias("from_ts"), b.alias("until_ts"))
    kept = F.when(F.col("h").isNotNull() & F.col("s").isNotNull(), row("h", F.col("h.from_ts"), F.col("h.until_ts")))
    head = F.when(F.col("s").isNull() & (F.col("h.from_ts") < t), row("h", F.col("h.from_ts"), t))
    tail = F.when(F.col("s").isNull() & nxt.isNotNull() & (F.col("h.until_ts").isNull() | (F.col("h.until_ts") > nxt)), row("h", nxt, F.col("h.until_ts")))
    added = F.when(F.col("h").isNull(), row("s", t, nxt))
    changed = both.select(F.inline(F.array_compact(F.array(kept, head, tail, added)))).select(*columns)
    everything = rest.unionByName(changed)
    return SnapshotResult(everything if fresh else stitch(everything), both.agg(*tallies))


def apply_snapshot_literal(history: DataFrame, snapshot: DataFrame, timestamp: Timestamp, filters: DataFrame | None = None, out_of_order: bool = False, collapse: bool = False) -> SnapshotResult:
    """The update by the older rules, for those who need their results: the next instant is looked up in the history itself
    and is unknown if no record began or none ended later; a record that held across a late snapshot loses its later
    part; without ``collapse``, records of zero length stay unless the snapshot is late. These rules know records by
    their checksum alone, so payloads of the snapshot that share one are an error."""
    payload = _payload(history.columns)
    t = db_timestamp(timestamp)
    if clash := checksummed(snapshot, payload, filters).groupBy("checksum").count().where("count > 1").limit(1).collect():
        raise ValueError(f"different records have the checksum {clash[0][0]}: the literal rules can't tell them apart")
    begins, ends = history.agg(*[F.min(F.when(F.col(c) > t, F.col(c))) for c in ("from_ts", "until_ts")]).first()
    upcoming = min(begins, ends) if begins is not None and ends is not None else None
    new = checksummed(snapshot, payload, filters)
    now = slice_time(filter_keys(history, filters.distinct()) if filters is not None else history, timestamp).select("checksum", "from_ts")
    gone = now.join(new.select("checksum"), "checksum", "left_anti")
    if out_of_order:
        gone = gone.where(F.col("from_ts") < t)
    dead = slice_max(gone, "from_ts", ["checksum"]).distinct().withColumn("_dead", F.lit(True))
    ended = history.join(dead, ["checksum", "from_ts"], "left").withColumn("until_ts", F.when(F.col("_dead"), t).otherwise(F.col("until_ts"))).select(history.columns)
    added = new.join(now.select("checksum"), "checksum", "left_anti").join(ended.where(F.col("from_ts") == t).select("checksum"), "checksum", "left_anti")
    added = added.withColumns({"from_ts": t, "until_ts": db_timestamp(upcoming)})
    result = ended.unionByName(added.select(history.columns))
    if out_of_order:
        result = stitch(result)
    elif collapse:
        result = purge(result)
    each = added.select(F.lit(1).alias("i"), F.lit(0).alias("d")).unionAll(dead.select(F.lit(0), F.lit(1)))
    counts = each.agg(F.coalesce(F.sum("i"), F.lit(0)).cast("int").alias("n_insertions"), F.coalesce(F.sum("d"), F.lit(0)).cast("int").alias("n_deactivations"))
    return SnapshotResult(result, counts)


def slice_max(df: DataFrame, order: str, by: list[str]) -> DataFrame:
    """The rows with the greatest ``order`` of each group; ties are kept, nulls don't count. The maximum is found by a
    pre-aggregated grouping, so a group of any size never lies in one task."""
    top = df.groupBy(*[F.col(f"`{c}`").alias(f"_by{k}") for k, c in enumerate(by)]).agg(F.max(f"`{order}`").alias("_top"))
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)], F.col(f"`{order}`") == F.col("_top"))
    return df.join(top, same, "left_semi")


def empty_history(snapshot: DataFrame) -> DataFrame:
    if len(set(snapshot.columns)) != len(snapshot.columns):
        raise ValueError("column names must be unique")
    if found := [c for c in META if c in snapshot.columns]:
        raise ValueError(f"the data already has metadata columns: {', '.join(found)}")
    return snapshot.limit(0).select("*", F.lit(None).cast("string").alias("checksum"), db_timestamp(None).alias("from_ts"), db_timestamp(None).alias("until_ts"))


def islands(snapshots: list[tuple[DataFrame, Timestamp]], payload: list[str]) -> DataFrame:
    """The history of many snapshots at once, without applying one after the other: a record's runs of consecutive
    snapshots. Same result as ``apply_snapshot`` in any order."""
    order = sorted(range(len(snapshots)), key=lambda k: str(db_timestamp(snapshots[k][1])))
    instants = F.array(*[db_timestamp(snapshots[k][1]) for k in order])
    ident, i, g, a, b = (fresh_name(n, payload) for n in ("_id", "_i", "_g", "_a", "_b"))
    rows = reduce(DataFrame.unionByName, [checksummed(snapshots[k][0], payload, ident=ident).withColumn(i, F.lit(n)) for n, k in enumerate(order)])
    w = Window.partitionBy(ident).orderBy(i)
    runs = rows.withColumn(g, F.col(i) - F.row_number().over(w)).groupBy(ident, g).agg(*[F.first(f"`{c}`").alias(c) for c in [*payload, "checksum"]], F.min(i).alias(a), F.max(i).alias(b))
    return runs.select(*[f"`{c}`" for c in payload], "checksum", instants[F.col(a)].alias("from_ts"), F.get(instants, F.col(b) + 1).alias("until_ts"))
