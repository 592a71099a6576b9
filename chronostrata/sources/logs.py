"""Logs of updates: console, text file, and one row per run in a log table."""

from __future__ import annotations

import getpass
import sys
import warnings
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from chronostrata.functions.timestamps import Timestamp, to_ts
from chronostrata.sources.ident import TableId, unique_table_name
from chronostrata.sources.store import Store

LOG_SCHEMA = "date timestamp_ntz, catalog string, schema string, table string, n_insertions int, n_deactivations int, start_time timestamp_ntz, end_time timestamp_ntz, duration string, success boolean, message string, log_file string"
#: Parts of the log table after which it is rewritten as one.
COMPACT_AFTER = 64
# Settings of the session that give a logger's defaults.
OPTION_TABLE, OPTION_PATH, OPTION_FORMAT = "chronostrata.log_table_id", "chronostrata.log_path", "chronostrata.log_timestamp_format"


def now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def create_logs_if_missing(store: Store, log_table: str | TableId) -> DataFrame:
    if not store.table_exists(store.id(log_table)):
        store.write_table(store.spark.createDataFrame([], LOG_SCHEMA), log_table)
    return store.read(log_table)


class Logger:
    def __init__(self, db_table: str | TableId | None = None, timestamp: Timestamp | None = None, output_to_console: bool = True, log_table_id: str | TableId | None = None, store: Store | None = None, log_path: str | None = None, start_time: datetime | None = None, warn: bool = True):
        option = lambda key: store.spark.conf.get(key, None) if store is not None else None
        log_table_id, log_path = log_table_id or option(OPTION_TABLE), log_path or option(OPTION_PATH)
        if log_table_id is not None and store is None:
            raise ValueError("a log table needs a store")
        self._store, self._console, self._path, self._start = store, output_to_console, log_path, start_time or now()
        self._format = option(OPTION_FORMAT) or "%Y-%m-%d %H:%M:%S.%f"
        self._table = None if db_table is None else db_table if isinstance(db_table, TableId) and store is None else store.id(db_table) if store is not None else TableId.parse(db_table)
        self._log_id = store.id(log_table_id) if log_table_id is not None else None
        if self._log_id is not None:
            create_logs_if_missing(store, self._log_id)
        self._timestamp: Timestamp | None = None
        self._row: dict[str, Any] = {}
        self._name: str | None = None
        self._final = False
        if timestamp is not None:
            self.set_timestamp(timestamp)
        if warn and self._path is None and self._log_id is None:
            warnings.warn("Neither a log path nor a log table is given: NO file or database logging will be done.", stacklevel=2)

    output_to_console = property(lambda self: self._console)
    log_path = property(lambda self: self._path)
    start_time = property(lambda self: self._start)
    finalized = property(lambda self: self._final)

    @property
    def log_tbl(self) -> DataFrame | None:
        return None if self._log_id is None else self._store.read(self._log_id)

    @property
    def log_filename(self) -> str:
        if self._name is None:
            if self._path is None:
                self._name = unique_table_name("log")
            else:
                if self._table is None or self._timestamp is None:
                    raise ValueError("a log file needs a table and a timestamp")
                name = f"{self._start:%Y%m%d.%H%M}.{to_ts(self._timestamp):%Y_%m_%d}.{self._table}.log"
                if Path(self._path, name).exists():
                    raise FileExistsError(f"Log file '{name}' already exists!")
                self._name = name
        return self._name

    @property
    def log_realpath(self) -> str | None:
        return None if self._path is None else str(Path(self._path, self.log_filename))

    def set_timestamp(self, timestamp: Timestamp | None) -> None:
        """Begins a new entry; nothing happens if the timestamp is the one at hand."""
        if timestamp is None or (self._timestamp is not None and to_ts(timestamp) == to_ts(self._timestamp)):
            return
        self._timestamp, self._name, self._final = timestamp, None, False
        t = self._table
        self._row = {"date": to_ts(timestamp), "catalog": t and t.catalog, "schema": t and t.schema, "table": t and t.table, "start_time": self._start}

    def _write(self, kind: str, words: tuple, tic: datetime | None) -> str:
        text = " - ".join([(tic or now()).strftime(self._format), getpass.getuser(), kind, " ".join(map(str, words))])
        if self._path is not None:
            with open(self.log_realpath, "a", encoding="utf-8") as f:
                f.write(text + "\n")
        return text

    def log_info(self, *words: Any, tic: datetime | None = None, output_to_console: bool | None = None, log_type: str = "INFO") -> str:
        text = self._write(log_type, words, tic)
        if (self._console if output_to_console is None else output_to_console) and log_type == "INFO":
            print(text, file=sys.stderr)
        return text

    def log_warn(self, *words: Any, log_type: str = "WARNING") -> None:
        warnings.warn(self._write(log_type, words, None), stacklevel=2)

    def log_error(self, *words: Any, log_type: str = "ERROR") -> None:
        raise RuntimeError(self._write(log_type, words, None))

    def log_to_db(self, **fields: Any) -> None:
        """Sets fields of this run's row; the row is written once, when it is final."""
        if self._final:
            raise RuntimeError("this run's log row is closed: set another timestamp to begin a new one")
        known = {p.split()[0] for p in LOG_SCHEMA.split(", ")}
        if unknown := set(fields) - known:
            raise ValueError(f"not a field of the log: {', '.join(sorted(unknown))}")
        self._row |= fields

    def finalize_db_entry(self, end_time: Timestamp | None = None, success: bool = True) -> None:
        if self._final:
            return
        end = to_ts(end_time) if end_time is not None else now()
        self.log_to_db(end_time=end, duration=f"{(end - self._start).total_seconds():.2f} secs", success=success, log_file=self.log_filename if self._path is not None else None)
        self._final = True
        if self._log_id is not None:
            row = self._store.spark.createDataFrame([tuple(self._row.get(p.split()[0]) for p in LOG_SCHEMA.split(", "))], LOG_SCHEMA)
            self._store.write_table(row.coalesce(1), self._log_id, append=True)
            if len(self._store.state(self._log_id)["parts"]) > COMPACT_AFTER:
                self._store.commit(self._log_id, self._store.read(self._log_id).coalesce(1))


class LoggerNull(Logger):
    """Writes nothing, but still warns and raises."""

    def __init__(self, *_: Any, **__: Any):
        super().__init__(output_to_console=False, warn=False)

    def _write(self, kind: str, words: tuple, tic: datetime | None) -> str:
        return " ".join(map(str, words))

    def log_to_db(self, **fields: Any) -> None:
        return None

    def finalize_db_entry(self, end_time: Timestamp | None = None, success: bool = True) -> None:
        return None
