"""Row-level changes as DataFrame algebra: each returns the table as it is afterwards. Keys match null with null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matched(x: DataFrame, y: DataFrame, by: list[str], how: str) -> DataFrame:
    """h: x's row, d: y's row; of rows of y with one key only one counts."""
    a = x.select(F.struct(*[F.col(f"`{c}`") for c in x.columns]).alias("h"))
    b = y.dropDuplicates(by).select(F.struct(*[F.col(f"`{c}`") for c in y.columns]).alias("d"))
    return a.join(b, reduce(lambda p, q: p & q, [F.col(f"h.`{c}`").eqNullSafe(F.col(f"d.`{c}`")) for c in by]), how)


def rows_append(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.unionByName(y.select(x.columns))


def rows_insert(x: DataFrame, y: DataFrame, by: list[str]) -> DataFrame:
    """Adds y's rows whose key x doesn't have; conflicts are ignored."""
    new = y.dropDuplicates(by).alias("d")
    old = x.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(by)]).distinct()
    return x.unionByName(new.join(old, reduce(lambda p, q: p & q, [F.col(f"d.`{c}`").eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(by)]), "left_anti").select(x.columns))


def rows_update(x: DataFrame, y: DataFrame, by: list[str]) -> DataFrame:
    """Overwrites the columns that y has in x's rows with a partner; y's other rows are ignored."""
    both = _matched(x, y, by, "left")
    return both.select(*[(F.when(F.col("d").isNotNull(), F.col(f"d.`{c}`")).otherwise(F.col(f"h.`{c}`")) if c in y.columns and c not in by else F.col(f"h.`{c}`")).alias(c) for c in x.columns])


def rows_patch(x: DataFrame, y: DataFrame, by: list[str]) -> DataFrame:
    """Like ``rows_update``, but only where x has null."""
    both = _matched(x, y, by, "left")
    return both.select(*[(F.coalesce(F.col(f"h.`{c}`"), F.col(f"d.`{c}`")) if c in y.columns and c not in by else F.col(f"h.`{c}`")).alias(c) for c in x.columns])


def rows_upsert(x: DataFrame, y: DataFrame, by: list[str]) -> DataFrame:
    """Updates x's rows with a partner and adds y's others; one full join."""
    both = _matched(x, y, by, "full")
    return both.select(*[(F.when(F.col("d").isNotNull(), F.col(f"d.`{c}`")).otherwise(F.col(f"h.`{c}`")) if c in y.columns else F.col(f"h.`{c}`")).alias(c) for c in x.columns])


def rows_delete(x: DataFrame, y: DataFrame, by: list[str]) -> DataFrame:
    """x's rows without a partner."""
    keys = y.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(by)]).distinct()
    return x.alias("h").join(keys, reduce(lambda p, q: p & q, [F.col(f"h.`{c}`").eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(by)]), "left_anti")
