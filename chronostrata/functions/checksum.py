"""Row checksums and united columns, as expressions inside whole-stage code."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        raise TypeError(f"column {column!r} of type {kind.simpleString()} can't be part of a checksum")
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def checksum_of(df: DataFrame, columns: list[str], safe: bool = False, algorithm: str = "md5") -> Column:
    """md5 (or 'sha256', 64 digits) over the columns as text, joined by '_', null as ''. With ``safe`` each value is preceded by its length, so
    that neither nulls and empty texts nor values with '_' can be mistaken for each other."""
    parts = [_text(df, c) for c in columns]
    if safe:
        parts = [F.when(F.col(f"`{c}`").isNull(), F.lit("N")).otherwise(F.concat(F.length(p).cast("string"), F.lit(":"), p)) for c, p in zip(columns, parts, strict=True)]
    text = F.concat_ws("_", *parts)
    if algorithm not in ("md5", "sha256"):
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return F.md5(text) if algorithm == "md5" else F.sha2(text, 256)


def digest_to_checksum(df: DataFrame, col: str = "checksum", exclude: list[str] | None = None, safe: bool = False, algorithm: str = "md5") -> DataFrame:
    """``df`` with the checksum of all columns but ``col`` and ``exclude``; warns if it overwrites ``col``."""
    if col in df.columns:
        warnings.warn(f"Column {col} already exists in data and will be overwritten!", stacklevel=2)
    columns = [c for c in df.columns if c != col and c not in (exclude or [])]
    return df.drop(col).withColumn(col, checksum_of(df, columns, safe, algorithm))


def unite(df: DataFrame, col: str, columns: list[str] | None = None, sep: str = "_", remove: bool = True) -> DataFrame:
    """The columns (default: all) as one text, placed before the first of them. Nulls are left out; nothing is null."""
    parts = columns or df.columns
    made = F.nullif(F.concat_ws(sep, *[F.col(f"`{c}`").cast("string") for c in parts]), F.lit("")).alias(col)
    at = min(df.columns.index(c) for c in parts)
    kept = lambda names: [F.col(f"`{c}`") for c in names if c != col and not (remove and c in parts)]
    return df.select(*kept(df.columns[:at]), made, *kept(df.columns[at:]))
