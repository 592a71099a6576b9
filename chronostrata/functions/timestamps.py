"""Timestamps as arguments: dates, datetimes and texts of one moment give one value. All are zone-less and mean UTC."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

Timestamp = datetime | date | str
_FORMATS = ("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d")


def to_ts(value: Timestamp) -> datetime:
    """A zone-less UTC datetime; ValueError for anything that is no timestamp."""
    if isinstance(value, datetime):
        return value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    if isinstance(value, str):
        text = re.sub(r"[T/]", lambda m: " " if m[0] == "T" else "-", value.strip().removesuffix("Z"))
        for form in _FORMATS:
            try:
                return datetime.strptime(text, form)
            except ValueError:
                continue
    raise ValueError(f"not a timestamp: {value!r}")


def db_timestamp(value: Timestamp | None) -> Column:
    """The literal for a timestamp; None is a null timestamp."""
    return F.lit(None if value is None else str(to_ts(value))).cast("timestamp_ntz")
