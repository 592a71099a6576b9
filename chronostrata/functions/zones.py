"""Versioned zone transition tables.

The driver reads the compiled zone files once and ships plain arrays, so every executor converts with the same
version of the zone data whatever is installed beside it. Size: about 600 zones of at most a few hundred
transitions, under 5 MB whatever the data.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import numpy as np

#: Years from which on a recurring rule is no longer unrolled. Of the 28 years before, each shape of a year (its length and the weekday it
#: begins with) occurs, and no explicit transition of today's zone data: a later year is looked up as the one of its shape.
LAST_YEAR = 2129
_SHAPED = range(LAST_YEAR - 28, LAST_YEAR)
DAY = 86_400


def _new_year(years: np.ndarray) -> np.ndarray:
    """Days from 1970-01-01 to the first day of each year."""
    return (years - 1970).astype("datetime64[Y]").astype("datetime64[D]").astype(np.int64)


def _shape(years: np.ndarray) -> np.ndarray:
    """0-13: the weekday of the first of January, and whether there are 366 days."""
    first = _new_year(years)
    return first % 7 * 2 + (_new_year(years + 1) - first - 365)


@lru_cache(maxsize=1)
def _year_of_shape() -> np.ndarray:
    years = np.array(_SHAPED)
    out = np.zeros(14, dtype=np.int64)
    out[_shape(years)] = years
    return out


def within_tables(local_s: np.ndarray) -> np.ndarray:
    """Local seconds of later years as the same moment of the year in a year of the same shape."""
    late = local_s >= _new_year(np.array([LAST_YEAR]))[0] * DAY
    if not late.any():
        return local_s
    out = local_s.copy()
    years = (local_s[late] // DAY).astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64) + 1970
    out[late] -= (_new_year(years) - _new_year(_year_of_shape()[_shape(years)])) * DAY
    return out


@dataclass(frozen=True)
class Zone:
    """``border[i]`` is the local second from which ``offset[i + 1]`` holds.

    A local time that occurs twice is the earlier instant and one that is skipped moves forward by the skip: both
    mean the offset before the transition, so the border is the transition's UTC second plus the larger offset.
    """

    border: np.ndarray
    offset: np.ndarray
    abbreviations: dict[str, int]
    recurring: bool = False

    def to_utc(self, local_us: np.ndarray) -> np.ndarray:
        local = np.floor_divide(local_us, 1_000_000)
        at = np.searchsorted(self.border, within_tables(local) if self.recurring else local, side="right")
        return local_us - self.offset[at] * 1_000_000


def _raw(name: str) -> bytes | None:
    for root in TZPATH:
        p = Path(root, name)
        if p.is_file():
            return p.read_bytes()
    try:
        from importlib import resources

        return resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()
    except (ImportError, OSError):
        return None


def _transitions(raw: bytes) -> tuple[list[int], list[int], int, dict[str, int]]:
    """Of a TZif file (RFC 8536): transition seconds, the offset from each on, the first offset, abbreviations."""

    def header(at: int) -> tuple[int, ...]:
        if raw[at : at + 4] != b"TZif":
            raise ValueError("not a zone file")
        return struct.unpack(">6l", raw[at + 20 : at + 44])

    at, width, code = 0, 4, "l"
    gmt, std, leap, times, types, chars = header(0)
    if raw[4:5] >= b"2":
        at = 44 + times * 5 + types * 6 + chars + leap * 8 + std + gmt
        gmt, std, leap, times, types, chars = header(at)
        width, code = 8, "q"
    at += 44
    when = list(struct.unpack(f">{times}{code}", raw[at : at + times * width]))
    at += times * width
    kinds = list(raw[at : at + times])
    at += times
    infos = [struct.unpack(">lbB", raw[at + 6 * k : at + 6 * k + 6]) for k in range(types)]
    at += 6 * types
    names = raw[at : at + chars]
    spelled = lambda k: names[infos[k][2] : names.index(b"\0", infos[k][2])].decode()
    abbreviations = {spelled(k): infos[k][0] for k in [0, *kinds]} if types else {}
    first = next((i for i in infos if not i[1]), infos[0])[0]
    return when, [infos[k][0] for k in kinds], first, abbreviations


def _later(name: str, start: int) -> list[tuple[int, int]]:
    """Transitions after the file's last one, by the zone's recurring rule."""
    zone = ZoneInfo(name)
    offset = lambda s: int((datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=s)).astimezone(zone).utcoffset().total_seconds())
    end = int(datetime(LAST_YEAR, 1, 1, tzinfo=UTC).timestamp())
    found, lo, step = [], max(start, 0), 28 * 86_400
    was = offset(lo)
    while lo < end:
        hi = lo + step
        now = offset(hi)
        if now != was:
            a, b = lo, hi
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if offset(m) == was else (a, m)
            found.append((b, now))
        lo, was = hi, now
    return found


def build(name: str) -> Zone | None:
    raw = _raw(name)
    if raw is None:
        return None
    when, after, first, abbreviations = _transitions(raw)
    recurring = raw.rstrip(b"\n").rpartition(b"\n")[2].count(b",") > 0  # the footer holds a rule
    if recurring:
        for t, o in _later(name, when[-1] if when else 0):
            when.append(t)
            after.append(o)
    offset = np.array([first, *after], dtype=np.int64)
    border = np.array(when, dtype=np.int64) + np.maximum(offset[:-1], offset[1:])
    return Zone(np.maximum.accumulate(border) if len(border) else border, offset, abbreviations, recurring)


@lru_cache(maxsize=1)
def version() -> str:
    for root in TZPATH:
        p = Path(root, "tzdata.zi")
        if p.is_file():
            with p.open() as f:
                return f.readline().split()[-1]
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(maxsize=1)
def tables() -> dict[str, Zone]:
    """Every zone of the driver's zone data, by lower-case name."""
    return {n.lower(): z for n in sorted(available_timezones()) if (z := build(n)) is not None}
