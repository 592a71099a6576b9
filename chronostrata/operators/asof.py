"""Attributes as known at event time (problem 4).

Method: union events and attribute versions, sort by entity, time and an explicit priority (at equal times a version
comes before an event; of equal versions the one with the greater id comes last and wins), and carry the last known
attributes forward. Because a version can end, or be nested in a longer one, what is carried is a stack: under each
version lies the nearest earlier one that ends later, so the first entry that still holds is the answer. Versions
that end no later than a newer one are never needed again and leave the stack.

Defined results. A version holds when from <= t < until; a null until never ends, a null from never begins, and a
version of no positive length never holds. Events without time, key or matching version keep null attributes
(``how='left'``) or are left out (``how='inner'``). Repeated versions change nothing; each event row gives one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronostrata.operators import rangescan
from chronostrata.session import fresh_name

NEVER = 2**63 - 1


def previous_later(until: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """For each version the nearest earlier one of its segment that ends later, -1 if none: by pointer jumping, in a
    number of rounds logarithmic in the length of a run."""
    n = len(until)
    at = np.arange(n)
    back = at - 1
    if n:
        back[0] = -1
        back[1:][segment[1:] != segment[:-1]] = -1
    todo = at[back >= 0]
    while len(todo := todo[(back[todo] >= 0) & (until[back[todo]] <= until[todo])]):
        back[todo] = back[back[todo]]
    return back


@dataclass
class AsOf:
    """State: (key, last time, stack of versions as a record batch, bottom first)."""

    attributes: list[str]
    keep: list[str]
    inner: bool
    names: list[str] = field(default_factory=list)

    def step(self, state, batch):
        cols = ["key", "t", "p", "u", *self.attributes]
        old = state[2] if state and state[2] is not None and state[2].num_rows else None
        table = pa.Table.from_batches([*([old] if old is not None else []), batch.select(cols)]).combine_chunks()
        skip = old.num_rows if old is not None else 0
        code = table["key"].combine_chunks().dictionary_encode()
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
        segment = np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])
        t = table["t"].to_numpy()
        version = table["p"].to_numpy() == 0
        rows = np.flatnonzero(version)
        until = table["u"].to_numpy()[rows]
        back = previous_later(until, segment[rows])
        before = np.cumsum(version) - 1  # the last version up to each row
        events = np.flatnonzero(~version)
        c = before[events]
        if len(rows):
            c = np.where((c >= 0) & (segment[rows[np.maximum(c, 0)]] == segment[events]), c, -1)
            todo = np.flatnonzero(c >= 0)
            while len(todo := todo[until[c[todo]] <= t[events[todo]]]):
                c[todo] = back[c[todo]]
                todo = todo[c[todo] >= 0]
        else:
            c = np.full(len(events), -1)
        hit = np.flatnonzero(c >= 0) if self.inner else np.arange(len(c))
        out = []
        if len(hit):
            source = pa.array(rows[np.maximum(c[hit], 0)] if len(rows) else np.zeros(len(hit), dtype=np.int64), mask=c[hit] < 0)
            taken = pa.array(events[hit] - skip)
            out = [pa.RecordBatch.from_arrays([*[batch.column(k).take(taken) for k in self.keep], *[table[a].combine_chunks().take(source) for a in self.attributes]], names=self.names)]
        now, last = t[-1], segment[-1]
        stack, at = [], len(rows) - 1
        if at >= 0 and segment[rows[at]] == last:
            while at >= 0:
                if until[at] > now:
                    stack.append(rows[at])
                at = back[at]
        left = table.take(pa.array(stack[::-1], pa.int64())).combine_chunks().to_batches() if stack else []
        return (table["key"][len(t) - 1].as_py(), int(now), left[0] if left else None), out

    def combine(self, state, summary):
        key, now, stack = summary
        if state[0] != key or state[2] is None:
            return summary
        floor = max(now, stack.column("u")[0].as_py()) if stack is not None and stack.num_rows else now
        old = state[2].filter(pc.greater(state[2].column("u"), floor))
        both = pa.Table.from_batches([x for x in (old, stack) if x is not None and x.num_rows] or [old]).combine_chunks().to_batches()
        return key, now, both[0] if both else None

    def finish(self, state):
        return []


def as_of(events: DataFrame, versions: DataFrame, key: list[str], time: str, begin: str, until: str, tie: str, how: str = "left", event_columns: list[str] | None = None, version_columns: list[str] | None = None) -> DataFrame:
    """``event_columns`` (default: all) and ``version_columns`` (default: all but the key) of each event and the version of
    its entity that held. ``time``, ``begin`` and ``until`` are bigint columns in any one unit; ``tie`` orders versions that
    begin together. Version columns whose names clash get a suffix."""
    ev, vs = event_columns or events.columns, version_columns or [c for c in versions.columns if c not in key]
    e_names, v_names = [f"e{i}" for i in range(len(ev))], [f"v{i}" for i in range(len(vs))]
    e_types, v_types = [events.schema[c].dataType for c in ev], [versions.schema[c].dataType for c in vs]
    present = lambda frame, *extra: " AND ".join(f"`{c}` IS NOT NULL" for c in (*key, *extra))
    none = lambda kinds, names: [F.lit(None).cast(k).alias(n) for k, n in zip(kinds, names, strict=True)]
    left = events.select(rangescan.entity_text(events, key).alias("key"), F.col(time).alias("t"), F.lit(1).cast("byte").alias("p"), F.lit(None).cast("bigint").alias("u"), F.lit(0).cast("bigint").alias("tie"), *[F.col(c).alias(n) for c, n in zip(ev, e_names, strict=True)], *none(v_types, v_names), F.expr(present(events, time)).alias("ok"))
    held = versions.where(present(versions, begin)).select(rangescan.entity_text(versions, key).alias("key"), F.col(begin).alias("t"), F.lit(0).cast("byte").alias("p"), F.coalesce(F.col(until), F.lit(NEVER)).alias("u"), F.col(tie).cast("bigint").alias("tie"), *none(e_types, e_names), *[F.col(c).alias(n) for c, n in zip(vs, v_names, strict=True)]).where("u > t")
    ordered = rangescan.ordered(left.where("ok").drop("ok").unionByName(held), ["key", "t", "p", "tie"])
    schema = T.StructType([T.StructField(n, k) for n, k in zip([*e_names, *v_names], [*e_types, *v_types], strict=True)])
    found = rangescan.run(ordered, AsOf(v_names, e_names, how == "inner", [*e_names, *v_names]), schema)
    if how == "left":
        found = found.unionByName(left.where("NOT ok").select(*e_names, *v_names))
    final = list(ev)
    for c in vs:
        final.append(fresh_name(c, final))
    return found.toDF(*final)
