"""Everything a user of the engine calls, in one place: ``from chronostrata import api``."""

from chronostrata.engine import delta_export, delta_load, update_snapshot
from chronostrata.functions.checksum import digest_to_checksum, unite
from chronostrata.functions.instants import to_instant, with_instant
from chronostrata.functions.timestamps import db_timestamp, to_ts
from chronostrata.operators.asof import as_of
from chronostrata.operators.cow import BucketedTable
from chronostrata.operators.delta import Delta, apply_delta, changes_by_instant, delta_counts, export_delta
from chronostrata.operators.history import apply_snapshot, current, islands, purge, slice_max, slice_time, stitch
from chronostrata.operators.interlace import interlace
from chronostrata.operators.islands import periods_and_gaps
from chronostrata.operators.joins import anti_join, full_join, inner_join, join, left_join, not_in, right_join, semi_join
from chronostrata.operators.keys import filter_keys, is_historical, nrow
from chronostrata.operators.merkle_store import MerkleHistory
from chronostrata.operators.rows import rows_append, rows_delete, rows_insert, rows_patch, rows_update, rows_upsert
from chronostrata.operators.snapdiff import between, consecutive
from chronostrata.operators.watermark import WatermarkExport, replay, windows
from chronostrata.session import clean
from chronostrata.sources.connectors import can_connect, jdbc_tables, jdbc_url, read_files, read_jdbc, write_files, write_jdbc
from chronostrata.sources.ident import TableId, unique_table_name
from chronostrata.sources.locks import break_lock, lock_table, locks, unlock_table
from chronostrata.sources.logs import Logger, LoggerNull, create_logs_if_missing
from chronostrata.sources.store import LATEST, Store, close_connection, get_connection, table_signature, temporary_view
from chronostrata.streaming.sink import change_sink, snapshot_sink

__all__ = [
    "LATEST", "BucketedTable", "Delta", "Logger", "LoggerNull", "MerkleHistory", "Store", "TableId", "WatermarkExport", "anti_join", "apply_delta", "apply_snapshot",
    "as_of", "between", "break_lock", "can_connect", "change_sink", "changes_by_instant", "clean", "close_connection", "consecutive", "create_logs_if_missing", "current", "db_timestamp",
    "delta_counts", "delta_export", "delta_load", "digest_to_checksum", "export_delta", "filter_keys", "full_join", "get_connection", "inner_join",
    "interlace", "is_historical", "islands", "jdbc_tables", "jdbc_url", "join", "left_join", "lock_table", "locks", "not_in", "nrow", "periods_and_gaps", "purge",
    "read_files", "read_jdbc", "replay", "right_join", "rows_append", "rows_delete", "rows_insert", "rows_patch", "rows_update", "rows_upsert", "semi_join",
    "slice_max", "slice_time", "snapshot_sink", "stitch", "table_signature", "temporary_view", "to_instant", "to_ts", "unique_table_name", "unite", "unlock_table",
    "update_snapshot", "windows", "with_instant", "write_files", "write_jdbc",
]
