"""Continuous periods and gaps of overlapping, nested and gapped intervals (problem 3).

Method: globally range-sort by entity and start; each partition's summary is its last entity with the maximum end and
the start of the island that reaches it; the prefix-combined summaries are carried into a rescan that labels islands.

Defined results. Intervals are half-open; those that overlap or touch form one period. A null end, or one of
``OPEN_FROM`` or later, is open. Rows without key or start and rows that end before or when they begin don't count.
Repeated rows change nothing (equal starts are folded before the sort). An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronostrata.operators import rangescan
from chronostrata.session import micros

OPEN = 2**63 - 1
#: Ends in the year 9999 or later stand for "open".
OPEN_FROM = 253_370_764_800_000_000


def segmented_cummax(value: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Running maximum that starts anew in each segment (segments ascend); exact for any int64."""
    distinct, rank = np.unique(value, return_inverse=True)
    lift = segment.astype(np.int64) * (len(distinct) + 1)
    return distinct[np.maximum.accumulate(lift + rank) - lift]


@dataclass
class Islands:
    """State: (key, start and end of the island at hand)."""

    def step(self, state, batch):
        n = batch.num_rows
        start, end = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s", "e"))
        keys = pa.concat_arrays([pa.array([state[0] if state else None], pa.string()), batch.column("key").cast(pa.string())])
        code = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        segment = np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])
        start = np.concatenate([[state[1] if state else 0], start])
        reach = segmented_cummax(np.concatenate([[state[2] if state else 0], end]), segment)
        same = segment[1:] == segment[:-1]
        new = np.flatnonzero(~same | (start[1:] > reach[:-1])) + 1  # rows that begin an island
        opened = np.concatenate([[0], new])
        if not len(new):
            return (state[0], state[1], int(reach[-1])), []
        closes = new - 1  # the last row of the island before
        begin = start[opened[:-1]]
        if not state:
            closes, begin = closes[1:], begin[1:]
        gaps = new[same[new - 1]]
        out = self._rows(keys, closes, begin, reach[closes], gaps, reach[gaps - 1], start[gaps])
        return (keys[n].as_py(), int(start[new[-1]]), int(reach[-1])), out

    @staticmethod
    def _rows(keys, closes, begin, until, gaps, left, right):
        if not len(closes) and not len(gaps):
            return []
        return [pa.RecordBatch.from_arrays([
            keys.take(pa.array(np.concatenate([closes, gaps]))),
            pa.array(["period"] * len(closes) + ["gap"] * len(gaps), pa.string()),
            pa.array(np.concatenate([begin, left])),
            pa.array(np.concatenate([until, right]), mask=np.concatenate([until == OPEN, np.zeros(len(gaps), dtype=bool)])),
        ], names=["key", "kind", "from_us", "until_us"])]

    def combine(self, state, summary):
        if state[0] == summary[0] and state[2] >= summary[1]:  # a sorted partition of that key alone, and it joins on
            return state[0], state[1], max(state[2], summary[2])
        return summary

    def finish(self, state):
        return [] if state is None else self._rows(pa.array([state[0]], pa.string()), np.array([0]), np.array([state[1]]), np.array([state[2]]), np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.array([], dtype=np.int64))


def periods_and_gaps(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Key columns, kind ('period', 'gap'), from_us, until_us (null: open), both in microseconds UTC."""
    e = micros(end)
    rows = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).select(rangescan.entity_text(df, key).alias("key"), micros(start).alias("s"), F.when(e.isNull() | (e >= OPEN_FROM), F.lit(OPEN)).otherwise(e).alias("e"))
    rows = rows.where("s IS NOT NULL AND e > s").groupBy("key", "s").agg(F.max("e").alias("e"))
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("from_us", T.LongType()), T.StructField("until_us", T.LongType())])
    found = rangescan.run(rangescan.ordered(rows, ["key", "s"]), Islands(), schema)
    return found.select(*rangescan.entity_columns(df, key, "key"), "kind", "from_us", "until_us")
