"""One writer per table: lock files that are created exclusively, in one place for all writers.

A lock is a lease. Of a process on this machine it is known whether it lives; one on another machine counts as living
until its lease is over. The owner renews its lease by locking again.
"""

from __future__ import annotations

import getpass
import json
import os
import socket
import time

from pyspark.sql import DataFrame

from chronostrata.sources.ident import TableId
from chronostrata.sources.store import Store


#: Seconds after which a lock of another machine's process no longer counts.
LEASE = 86_400


def _path(store: Store, t: TableId):
    return store.files._path(f"{store.root}/_locks/{t.schema}/{t.table}.json")


def _owner(store: Store, path) -> dict | None:
    if not store.files._fs.exists(path):
        return None
    stream = store.files._fs.open(path)
    try:
        return json.loads(store.files._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") or "{}")
    finally:
        stream.close()


def _alive(owner: dict) -> bool:
    if owner.get("host") != socket.gethostname() or "pid" not in owner:
        return time.time() < owner.get("lock_start", 0) + owner.get("lease", LEASE)
    try:
        os.kill(int(owner["pid"]), 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


def _write(store: Store, path, t: TableId, pid: int, lease: float, overwrite: bool) -> None:
    stream = store.files._fs.create(path, overwrite)
    try:
        stream.write(bytearray(json.dumps({"schema": t.schema, "table": t.table, "user": getpass.getuser(), "lock_start": time.time(), "lease": lease, "pid": pid, "host": socket.gethostname()}).encode()))
    finally:
        stream.close()


def lock_table(store: Store, name: str | TableId, pid: int | None = None, lease: float = LEASE) -> bool:
    """True if this process holds the lock now (and has renewed it if it did before), False if a living one does; an error if
    its owner died or let the lease pass."""
    t, pid = store.id(name), pid or os.getpid()
    path = _path(store, t)
    try:
        _write(store, path, t, pid, lease, overwrite=False)
        return True
    except Exception as e:
        if "AlreadyExists" not in str(e) and "already exists" not in str(e):
            raise
    owner = _owner(store, path) or {}
    if owner.get("pid") == pid and owner.get("host") == socket.gethostname():
        _write(store, path, t, pid, lease, overwrite=True)
        return True
    if not _alive(owner):
        raise RuntimeError(f"{t} is locked by process {owner.get('pid')} of {owner.get('user')} on {owner.get('host')}, which is gone: see what it left, then break the lock")
    return False


def break_lock(store: Store, name: str | TableId) -> bool:
    """Removes a lock whose owner is gone; a living owner's stays."""
    path = _path(store, store.id(name))
    owner = _owner(store, path)
    return owner is not None and not _alive(owner) and bool(store.files._fs.delete(path, False))


def unlock_table(store: Store, name: str | TableId, pid: int | None = None) -> bool:
    """Removes the lock if this process (or the given one) owns it."""
    t = store.id(name)
    path = _path(store, t)
    owner = _owner(store, path)
    if owner is None or owner.get("pid") != (pid or os.getpid()):
        return False
    return bool(store.files._fs.delete(path, False))


def locks(store: Store) -> DataFrame:
    rows = []
    for schema in store.files.children("_locks"):
        for name in store.files.children(f"_locks/{schema}"):
            if name.endswith(".json") and (o := _owner(store, store.files._path(f"{store.root}/_locks/{schema}/{name}"))):
                rows.append((o["schema"], o["table"], o["user"], float(o["lock_start"]), int(o["pid"])))
    return store.spark.createDataFrame(rows, "schema string, table string, user string, lock_start double, pid long")
