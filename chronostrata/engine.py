"""The services put together: update a stored history from a snapshot, export deltas and load them."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chronostrata.functions.timestamps import Timestamp, to_ts
from chronostrata.operators.delta import Delta, apply_delta, delta_counts, export_delta, same_columns
from chronostrata.operators.history import apply_snapshot, apply_snapshot_literal, empty_history
from chronostrata.operators.keys import META, is_historical
from chronostrata.session import cut
from chronostrata.sources.ident import TableId
from chronostrata.sources.locks import lock_table, unlock_table
from chronostrata.sources.logs import Logger
from chronostrata.sources.store import Store


def _scope(filters: DataFrame | None) -> str | None:
    """A fingerprint of filters, whatever their order: two updates with one fingerprint spoke of the same records."""
    if filters is None:
        return None
    columns = sorted(filters.columns)
    total = filters.select(*columns).distinct().agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns]))).first()
    return hashlib.md5(f"{columns}{tuple(total)}".encode()).hexdigest()


def update_snapshot(data: DataFrame, store: Store, db_table: str | TableId, timestamp: Timestamp, filters: DataFrame | None = None, message: str | None = None, tic: datetime | None = None, logger: Logger | None = None, enforce_chronological_order: bool = True, collapse_continuous_records: bool = False, literal: bool = False) -> dict[str, int]:
    """Records in the historical table what the snapshot changes; returns the numbers of insertions and deactivations.

    Snapshots may come in any order if ``enforce_chronological_order`` is off. Records of zero length are never kept, so
    ``collapse_continuous_records`` changes nothing; it is accepted for those who set it. A run that dies leaves the
    version before it, and its lock is released if the process lives. ``literal`` updates by the older rules (see
    ``history.apply_snapshot_literal``), in which ``collapse_continuous_records`` matters."""
    t, name = to_ts(timestamp), store.id(db_table)
    logger = logger or Logger(name, timestamp, output_to_console=False, store=store, start_time=tic, warn=False)
    logger.set_timestamp(timestamp)
    exists = store.table_exists(name)
    if not exists:
        empty_history(data)  # refuses data that can't make a table
    if not lock_table(store, name):
        logger.log_error(f"A lock exists on {name} while updating for {timestamp}")
    try:
        if not exists:
            store.create_table(data, name)
        state, target = store.state(name), store.read(name)
        if not is_historical(target, all_columns=True):
            logger.log_error(f"Table does not seem like a historical table ({name})")
        if not same_columns(data, target):
            here, there = sorted(data.columns), sorted(c for c in target.columns if c not in META)
            logger.log_error(f"Columns do not match! Table columns: {', '.join(there)}. Input columns: {', '.join(here)}")
        latest = store.latest_snapshot(name)
        if enforce_chronological_order and latest is not None and t < latest:
            logger.log_error(f"Given timestamp {t} is earlier than latest timestamp in table: {latest}")
        scope, registry = _scope(filters), [(to_ts(r[0]), r[1]) for r in state.get("registry", [])]
        later = sorted((x for x in registry if x[0] > t), key=lambda x: x[0])
        if not literal and (strange := [x for x in later if x[1] not in (None, scope)]):
            raise ValueError(f"later updates with other filters ({strange[0][0]}) make it impossible to say how long a record of {t} holds")
        upcoming = later[0][0] if later else None
        facts = {"registry": sorted({(str(x), s or "") for x, s in [*registry, (t, scope)]})}
        facts["registry"] = [[x, s or None] for x, s in facts["registry"]]
        fresh = latest is None or t > latest
        if literal:
            result = apply_snapshot_literal(target, data, t, filters, not enforce_chronological_order, collapse_continuous_records)
            counts = result.counts.first().asDict()
            store.commit(name, result.history, **facts)
        elif fresh:  # only the open rows can change; what they close is appended
            seen = Observation()
            result = apply_snapshot(store.read(name, only_open=True), data, t, None, filters, fresh=True, observation=seen)
            store.commit(name, result.history, keep=[p for p in state["parts"] if not p["is_open"]], **facts)
            counts = {k: int(v or 0) for k, v in seen.get.items()}
            store.tidy(name)
        else:
            seen = Observation()
            result = apply_snapshot(target, data, t, upcoming, filters, observation=seen)
            store.commit(name, result.history, **facts)
            counts = {k: int(v or 0) for k, v in seen.get.items()}
        logger.log_to_db(**counts, message=message)
        logger.finalize_db_entry()
        return counts
    except BaseException:
        if not logger.finalized:
            logger.finalize_db_entry(success=False)
        raise
    finally:
        unlock_table(store, name)


def delta_export(store: Store, db_table: str | TableId, timestamp_from: Timestamp, timestamp_until: Timestamp | None = None) -> Delta:
    """The part of a history that began or ended since ``timestamp_from`` (and before ``timestamp_until``)."""
    return export_delta(store.read(db_table), timestamp_from, timestamp_until, store.state(db_table).get("registry"))


def delta_load(store: Store, db_table: str | TableId, delta: Delta | list[Delta], logger: Logger | None = None) -> None:
    """Applies deltas to a historical table, which is created if missing; in any order, and again without effect."""
    if isinstance(delta, list):
        for d in delta:
            delta_load(store, db_table, d, logger)
        return
    name = store.id(db_table)
    if not lock_table(store, name):
        raise RuntimeError(f"another writer holds {name}, so the delta was left out")
    try:
        rows = cut(delta.data)
        if not store.table_exists(name):
            store.create_table(rows.drop(*META), name)
        before = store.read(name)
        if not same_columns(rows, before):
            raise ValueError("Columns do not match!")
        counts = delta_counts(before, rows).orderBy("ts").collect() if logger is not None else []  # a row for each snapshot
        state = store.state(name)
        known = {(str(to_ts(x)), s or "") for x, s in [*state.get("registry", []), *delta.snapshots]}
        high = rows.agg(F.max(F.greatest("from_ts", F.coalesce("until_ts", "from_ts")))).first()[0]
        high = max([str(x) for x in (high, state.get("high")) if x is not None], default=None)
        store.commit(name, apply_delta(before, rows), registry=[[x, s or None] for x, s in sorted(known)], high=high)
        until = "" if delta.timestamp_until is None else f" and timestamp_until = {delta.timestamp_until}"
        for ts, added, ended in counts:
            logger.set_timestamp(ts)
            logger.log_to_db(n_insertions=added, n_deactivations=ended, message=f"Update via delta load (timestamp_from = {delta.timestamp_from}{until})")
            logger.finalize_db_entry()
    finally:
        unlock_table(store, name)
