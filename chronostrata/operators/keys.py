"""Filtering by tables of allowed keys, and small predicates on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronostrata.operators.joins import join

META = ("checksum", "from_ts", "until_ts")


def filter_keys(df: DataFrame, filters: DataFrame | None, by: list[str] | str | None = None, na_by: list[str] | str | None = None, nulls_match: bool = False) -> DataFrame:
    """Rows whose keys stand in ``filters``: None keeps all, an empty table none. Without named keys, its columns with any
    value match plainly and its all-null columns match nulls; with ``nulls_match`` null equals null in all of them. It is an inner join: repeated filter rows repeat rows, and
    columns of ``filters`` that aren't keys are added."""
    if filters is None:
        return df
    for c in [*([by] if isinstance(by, str) else by or []), *([na_by] if isinstance(na_by, str) else na_by or [])]:
        if c not in filters.columns:
            raise ValueError(f"key {c!r} isn't a column of filters")
    if by is None and na_by is None:
        seen = filters.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(filters.columns)]).first()
        if not seen["__rows"]:
            return df.limit(0)
        if nulls_match:
            return join(df, filters, "inner", na_by=list(filters.columns))
        by = [c for k, c in enumerate(filters.columns) if seen[f"n{k}"]]
        na_by = [c for k, c in enumerate(filters.columns) if not seen[f"n{k}"]]
    return join(df, filters, "inner", by or None, na_by or None)


def is_historical(df: DataFrame, all_columns: bool = False) -> bool:
    """Whether any (or all) of the metadata columns is there."""
    return (all if all_columns else any)(c in df.columns for c in META)


def nrow(df: DataFrame) -> int:
    return df.count()
