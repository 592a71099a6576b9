"""Numbered time axes per key, and running maxima per key, by scans that bear any skew (see ``rangescan``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronostrata.operators import rangescan
from chronostrata.operators.islands import segmented_cummax


def _segments(keys: pa.Array) -> np.ndarray:
    """Number of the run of equal keys (null equals null) that each row lies in."""
    code = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])


class Stretches:
    """State: (key, its first and last instant so far, number of the last)."""

    def step(self, state, batch):
        keys, t = batch.column("key").cast(pa.string()), batch.column("t").to_numpy(zero_copy_only=False)
        if state:
            keys, t = pa.concat_arrays([pa.array([state[0]], pa.string()), keys]), np.concatenate([[state[2]], t])
        run = _segments(keys)
        point = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (t[1:] != t[:-1])]))
        of = run[point]
        first = np.searchsorted(of, of, side="left")  # the first point of each point's key
        number = np.arange(len(point)) - first + np.where((of == 0) & bool(state), state[3] if state else 0, 0)
        joined = np.flatnonzero(of[1:] == of[:-1]) + 1
        out = []
        if len(joined):
            out = [pa.RecordBatch.from_arrays([keys.take(pa.array(point[joined])), pa.array(t[point[joined - 1]]), pa.array(t[point[joined]]), pa.array(number[joined - 1])], names=["key", "f", "u", "n"])]
        start = state[1] if state and of[-1] == 0 else int(t[point[first[-1]]])
        return (keys[len(keys) - 1].as_py(), start, int(t[-1]), int(number[-1])), out

    def combine(self, state, summary):
        if state[0] != summary[0]:
            return summary
        return state[0], state[1], summary[2], state[3] + summary[3] + (summary[1] != state[2])

    def finish(self, state):
        return []


def stretches(points: DataFrame) -> DataFrame:
    """(key, f, u, n): the stretches between consecutive distinct instants of each key, numbered from 0, given (key text,
    t bigint) in any order and with repetitions."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("f", T.LongType()), T.StructField("u", T.LongType()), T.StructField("n", T.LongType())])
    return rangescan.run(rangescan.ordered(points.select("key", "t"), ["key", "t"]), Stretches(), schema)


NOTHING = -(2**63)


class Before:
    """The maximum of v over the rows of a key with a smaller t. State: (key, t at hand, maximum before it, and with it)."""

    def __init__(self, keep: list[str]):
        self.keep = keep

    def step(self, state, batch):
        keys, t, v = batch.column("key").cast(pa.string()), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "v"))
        lead = [] if not state else [0]
        if state:  # two rows stand for what came before: all smaller instants, and the instant at hand
            keys = pa.concat_arrays([pa.array([state[0], state[0]], pa.string()), keys])
            t, v, lead = np.concatenate([[state[1] - 1, state[1]], t]), np.concatenate([[state[2], state[3]], v]), [0, 1]
        run = _segments(keys)
        reach = segmented_cummax(v, run)
        fresh = np.concatenate([[True], (run[1:] != run[:-1]) | (t[1:] != t[:-1])])
        group = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # the first row with each row's key and t
        before = np.where((group > 0) & (run[np.maximum(group - 1, 0)] == run), reach[np.maximum(group - 1, 0)], NOTHING)
        skip = len(lead)
        out = [pa.RecordBatch.from_arrays([*[batch.column(c) for c in self.keep], pa.array(before[skip:], mask=before[skip:] == NOTHING)], names=[*self.keep, "before"])]
        return (keys[len(keys) - 1].as_py(), int(t[-1]), int(before[-1]), int(reach[-1])), out

    def combine(self, state, summary):
        if state[0] != summary[0]:
            return summary
        before = max(summary[2], state[3] if state[1] < summary[1] else state[2])
        return summary[0], summary[1], before, max(state[3], summary[3])

    def finish(self, state):
        return []


def maximum_before(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row and ``before``: the greatest v among its key's rows with a smaller t, null if there
    is none; rows have key (text), t and v (bigint, not null)."""
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("before", T.LongType())])
    return rangescan.run(rangescan.ordered(rows.select("key", "t", "v", *[c for c in keep if c not in ("key", "t", "v")]), ["key", "t"]), Before(keep), schema)
