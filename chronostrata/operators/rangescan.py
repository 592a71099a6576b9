"""Scans in global order with carried state, without ever putting a whole entity into one task.

1. ``ordered``: globally range-sort and materialise in the shared folder. An entity with a third of all rows spreads
   over a third of the partitions.
2. each partition is scanned once without carry, which gives one summary per partition;
3. the driver prefix-combines the summaries (one small row for each partition, whatever the data) into the state
   that each partition starts with;
4. each partition is scanned again from that state and gives its results.

State and results are handled a whole Arrow batch at a time, so memory doesn't depend on a partition's size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronostrata.session import cut, ship, shuffle_width

#: Rows that a partition of the sorted data should have at most.
PARTITION_ROWS = 2_000_000


class Scan(Protocol):
    """What a scan needs. A state is any small picklable value, None at the very start."""

    def step(self, state: Any, batch: pa.RecordBatch) -> tuple[Any, list[pa.RecordBatch]]: ...
    def combine(self, state: Any, summary: Any) -> Any: ...
    def finish(self, state: Any) -> list[pa.RecordBatch]: ...


def entity_text(df: DataFrame, key: list[str]) -> Column:
    """One text for a possibly composite key; equal texts for equal keys."""
    if len(key) == 1 and isinstance(df.schema[key[0]].dataType, T.StringType):
        return F.col(key[0])
    return F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)]), {"ignoreNullFields": "false"})


def entity_columns(df: DataFrame, key: list[str], text: str) -> list[Column]:
    """The key columns again, from ``entity_text``."""
    if len(key) == 1 and isinstance(df.schema[key[0]].dataType, T.StringType):
        return [F.col(text).alias(key[0])]
    kind = T.StructType([T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(key)])
    return [F.from_json(text, kind)[f"k{i}"].alias(k) for i, k in enumerate(key)]


def ordered(df: DataFrame, by: list[str]) -> DataFrame:
    """Globally sorted and materialised, with the partition's number in ``_pid``. What is sorted is materialised first, so that
    it is made only once however often it is looked at: to count it, to find the ranges, and to sort it."""
    rows = cut(df)
    width = max(shuffle_width(df.sparkSession), -(-rows.count() // PARTITION_ROWS))
    return cut(rows.repartitionByRange(width, *by).sortWithinPartitions(*by).withColumn("_pid", F.spark_partition_id()))


def run(sorted_df: DataFrame, scan: Scan, schema: T.StructType) -> DataFrame:
    """Results of ``scan`` over what ``ordered`` gave."""
    ship(sorted_df.sparkSession)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, pid = None, None
        for b in batches:
            if b.num_rows:
                pid = b.column("_pid")[0].as_py()
                state, _ = scan.step(state, b)
        if pid is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([pickle.dumps(state)], pa.binary())], names=["pid", "state"])

    summaries = sorted(sorted_df.mapInArrow(summarise, "pid int, state binary").collect())
    starts: dict[int, Any] = {}
    carried = None
    for pid, blob in summaries:
        starts[pid] = carried
        summary = pickle.loads(bytes(blob))
        carried = summary if carried is None else scan.combine(carried, summary)
    last = summaries[-1][0] if summaries else None
    sent = sorted_df.sparkSession.sparkContext.broadcast(starts)

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, pid = None, None
        for b in batches:
            if b.num_rows:
                if pid is None:
                    pid = b.column("_pid")[0].as_py()
                    state = sent.value[pid]
                state, out = scan.step(state, b)
                yield from out
        if pid is not None and pid == last:
            yield from scan.finish(state)

    return sorted_df.mapInArrow(rescan, schema)

