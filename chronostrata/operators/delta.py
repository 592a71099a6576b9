"""Deltas: slices of history that move from one historical table to another."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronostrata.functions.timestamps import Timestamp, db_timestamp, to_ts
from chronostrata.operators.history import identity
from chronostrata.operators.keys import META


@dataclass(frozen=True)
class Delta:
    """``snapshots`` are the registry's instants within the bounds; they travel along so that the target can place late
    snapshots too."""

    data: DataFrame
    timestamp_from: Timestamp
    timestamp_until: Timestamp | None = None
    snapshots: list = field(default_factory=list)


def export_delta(history: DataFrame, timestamp_from: Timestamp, timestamp_until: Timestamp | None = None, snapshots: list | None = None) -> Delta:
    """What began or ended in [from, until), or since ``from``; ends after ``until`` are not yet known and become null."""
    lo, hi = db_timestamp(timestamp_from), db_timestamp(timestamp_until)
    inside = lambda c: F.coalesce((F.col(c) >= lo) & (F.lit(True) if timestamp_until is None else F.col(c) < hi), F.lit(False))
    rows = history.where(inside("from_ts") | inside("until_ts"))
    if timestamp_until is not None:
        rows = rows.withColumn("until_ts", F.when(F.col("until_ts") > hi, None).otherwise(F.col("until_ts")))
    low, high = to_ts(timestamp_from), to_ts(timestamp_until) if timestamp_until is not None else None
    kept = [s for s in snapshots or [] if low <= to_ts(s[0]) and (high is None or to_ts(s[0]) < high)]
    return Delta(rows.select(history.columns), timestamp_from, timestamp_until, kept)


def _keyed(rows: DataFrame, payload: list[str], name: str) -> DataFrame:
    """(id, from_ts, ``name``): the rows as structs under what identifies a version."""
    return rows.select(identity(rows, payload).alias("id"), F.col("from_ts").alias("since"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(name))


def apply_delta(history: DataFrame, delta: DataFrame) -> DataFrame:
    """Adds the versions the history lacks and fills the ends it doesn't know; one full join by record and from_ts. The
    order in which deltas are applied doesn't matter and applying one again changes nothing. Ends that are set and
    records that are gone in the source aren't taken over. Of repeated versions of a delta the latest end counts."""
    columns = history.columns
    payload = [c for c in columns if c not in META]
    ends = F.struct(F.col("d.until_ts").alias("u"), F.col("d").alias("d"))
    once = _keyed(delta.select(*[f"`{c}`" for c in columns]), payload, "d").groupBy("id", "since").agg(F.max(ends).alias("last")).select("id", "since", F.col("last.d").alias("d"))
    both = _keyed(history, payload, "h").join(once, ["id", "since"], "full")
    value = lambda c: F.coalesce(F.col("h.until_ts"), F.col("d.until_ts")) if c == "until_ts" else F.when(F.col("h").isNotNull(), F.col(f"h.`{c}`")).otherwise(F.col(f"d.`{c}`"))
    return both.select(*[value(c).alias(c) for c in columns])


def delta_counts(history: DataFrame, delta: DataFrame) -> DataFrame:
    """(ts, n_insertions, n_deactivations) that applying the delta to ``history`` logs, for each instant. One pass: the
    two counts are one grouping of a stacked table instead of a full join of two."""
    payload = [c for c in history.columns if c not in META]
    known = history.select(identity(history, payload).alias("id"), F.col("from_ts").alias("since"), F.col("until_ts").alias("u")).groupBy("id", "since").agg(F.max("u").alias("u"), F.lit(True).alias("k"))
    news = delta.select(identity(delta, payload).alias("id"), F.col("from_ts").alias("since"), F.col("until_ts").alias("until")).distinct()
    rows = news.join(known, ["id", "since"], "left")
    new = F.when(F.col("k").isNull(), F.struct(F.col("since").alias("ts"), F.lit(1).alias("i"), F.lit(0).alias("d")))
    dead = F.when(F.col("until").isNotNull() & (F.col("k").isNull() | ~F.col("u").eqNullSafe(F.col("until"))), F.struct(F.col("until").alias("ts"), F.lit(0).alias("i"), F.lit(1).alias("d")))
    return rows.select(F.inline(F.array_compact(F.array(new, dead)))).groupBy("ts").agg(F.sum("i").cast("int").alias("n_insertions"), F.sum("d").cast("int").alias("n_deactivations"))


def changes_by_instant(history: DataFrame) -> DataFrame:
    """(ts, n_insertions, n_deactivations) of a whole history."""
    pair = lambda c, i, d: F.struct(F.col(c).alias("ts"), F.lit(i).alias("i"), F.lit(d).alias("d"))
    rows = history.select(F.inline(F.array(pair("from_ts", 1, 0), pair("until_ts", 0, 1)))).where("ts IS NOT NULL")
    return rows.groupBy("ts").agg(F.sum("i").cast("int").alias("n_insertions"), F.sum("d").cast("int").alias("n_deactivations"))


def same_columns(df: DataFrame, target: DataFrame) -> bool:
    return {c for c in df.columns if c not in META} == {c for c in target.columns if c not in META}

