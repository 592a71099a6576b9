"""Structured Streaming into the engine: snapshots into history, and change feeds into a bucketed table.

Both sinks are safe to repeat: Spark may deliver a micro-batch again after a failure, and applying it again changes
nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from chronostrata.engine import update_snapshot
from chronostrata.functions.timestamps import Timestamp
from chronostrata.operators.cow import BucketedTable
from chronostrata.sources.ident import TableId
from chronostrata.sources.store import Store


def snapshot_sink(stream: DataFrame, store: Store, db_table: str | TableId, instant: Callable[[DataFrame, int], Timestamp | None], columns: list[str], checkpoint: str) -> DataStreamWriter:
    """Every micro-batch is a full snapshot, taken at ``instant(batch, number)``; late ones are put in their place, and
    batches without an instant are passed over."""

    def apply(batch: DataFrame, number: int) -> None:
        when = instant(batch, number)
        if when is not None:
            update_snapshot(batch.select(*columns), store, db_table, when, enforce_chronological_order=False)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def change_sink(stream: DataFrame, table: BucketedTable, checkpoint: str) -> DataStreamWriter:
    """Every micro-batch holds changes in any order."""
    return stream.writeStream.foreachBatch(lambda batch, _: table.apply(batch)).option("checkpointLocation", checkpoint)
