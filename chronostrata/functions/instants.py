"""Mixed spellings of instants -> microseconds since 1970 UTC (problem 1).

Method: every byte of a whole Arrow batch is mapped to its character class by one table look-up, which gives each
text its shape mask. Each distinct mask is compiled to a parser once (``compile_mask``). All texts of one mask have
the same width, so a parser reads its fields as column slices of an (n x width) byte matrix. Local times go through
the versioned transition tables of ``zones``. No step handles single rows.

Defined results. Null, empty and unreadable texts, impossible dates and times and local times whose zone is unknown
give null. Surrounding white space of any length doesn't count. Digits finer than microseconds are cut off, however
many they are. The grammar alone decides what is read: no length of a text and no year up to 9999 is a border. A named zone or offset wins
over the writer's zone; an abbreviation means what the writer's own zone means by it, else the fixed table. A local
time that occurs twice is the earlier instant, a skipped one moves forward by the skip, a date alone is its
midnight. Digits alone: 14, 8, 12, 17 or 20 of them are a local date and time where they form one; else 1-11 count
seconds, 12-13 milliseconds, 15-16 microseconds and 18-19 nanoseconds.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronostrata.functions import zones
from chronostrata.functions.zones import Zone
from chronostrata.session import bounded_broadcast, fresh_name, ship

# Common abbreviations that are used where the writer's own zone doesn't define them (seconds).
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 3600, "bst": 3600, "cet": 3600, "cest": 7200, "eet": 7200, "eest": 10800,
    "msk": 10800, "ist": 19800, "jst": 32400, "kst": 32400, "aest": 36000, "aedt": 39600, "nzst": 43200, "nzdt": 46800,
    "est": -18000, "edt": -14400, "cst": -21600, "cdt": -18000, "mst": -25200, "mdt": -21600, "pst": -28800, "pdt": -25200,
}
# English month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

#: Character classes: digits 9, letters a; other ASCII characters stand for themselves, tabs and such for a space, the rest is ?.
_CLASS = np.frombuffer(bytes(57 if 48 <= b <= 57 else 97 if 65 <= b <= 90 or 97 <= b <= 122 else b if 32 <= b < 127 else 32 if b in (9, 10, 13) else 63 for b in range(256)), dtype=np.uint8)

_DATE = r"(?:(?P<y1>9{4})-(?P<m1>99?)-(?P<d1>99?)|(?P<y2>9{4})/(?P<m2>99?)/(?P<d2>99?)|(?P<d3>99?)\.(?P<m3>99?)\.(?P<y3>9{4})|(?P<p>99?)/(?P<q>99?)/(?P<y4>9{4})|(?:a{3,9},? )?(?P<d5>99?)[ -](?P<n5>a{3,9})\.?,?[ -](?P<y5>9{4})|(?:a{3,9},? )?(?P<n6>a{3,9})\.? (?P<d6>99?),? (?P<y6>9{4}))"
_CLOCK = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<ap>aa)(?![a/]))?"
_ZONE = r"(?: ?(?P<z>a)| ?(?P<sg>[+-])(?P<zh>99):?(?P<zm>99)?| (?P<zn>a{2,5}|a+(?:[/_+-][a9]+)+))?"
_GRAMMAR = re.compile(rf"{_DATE}(?:(?:(?P<T>a)|,? +){_CLOCK}{_ZONE})?")
_COMPACT = re.compile(rf"(?P<y1>9{{4}})(?P<m1>99)(?P<d1>99)(?P<T>a)(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9+))?)?{_ZONE}")
_DIGITS = re.compile(r"(?P<n>9{1,20})")
_LOCAL_DIGITS = {8: "y1m1d1", 12: "y1m1d1HM", 14: "y1m1d1HMS", 17: "y1m1d1HMSf", 20: "y1m1d1HMSf"}
_COUNTS = ((11, 1_000_000, 1), (13, 1000, 1), (16, 1, 1), (19, 1, 1000))


#: Masks up to this length are remembered once compiled; longer ones are compiled again in each batch, so that memory is bounded.
REMEMBERED_CHARS = 256
#: Characters that are read at once, to bound memory.
CELLS = 4_000_000


def parser(mask: str) -> dict[str, tuple[int, int]] | None:
    return compile_mask(mask) if len(mask) <= REMEMBERED_CHARS else compile_mask.__wrapped__(mask)


@lru_cache(maxsize=4096)
def compile_mask(mask: str) -> dict[str, tuple[int, int]] | None:
    """The byte ranges of a mask's fields, None for a shape that no time has. Called once for each distinct mask."""
    for grammar in (_GRAMMAR, _COMPACT, _DIGITS):
        if m := grammar.fullmatch(mask):
            return {re.sub(r"(?<=[ymdn])\d$", "", k) if k != "n" else "digits": m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


def _number(mat: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(mat), dtype=np.int64)
    for k in range(*span):
        out = out * 10 + (mat[:, k] - 48)
    return out


def _micros(mat: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    kept = min(span[1], span[0] + 6)
    return _number(mat, (span[0], kept)) * 10 ** (6 - (kept - span[0]))


def _looked_up(mat: np.ndarray, span: tuple[int, int], find) -> np.ndarray:
    """``find`` of each distinct lower-case text in the slice, -1 where it is None."""
    width = span[1] - span[0]
    part = np.ascontiguousarray(mat[:, span[0] : span[1]]).view(f"S{width}").ravel()
    distinct, at = np.unique(part, return_inverse=True)
    return np.array([-1 if (x := find(t.decode("ascii", "replace").lower())) is None else x for t in distinct], dtype=np.int64)[at]


def _month(name: str) -> int | None:
    return next((k + 1 for k, m in enumerate(MONTHS) if name in (m, m[:3]) or name == "sept" and k == 8), None)


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 in the proleptic Gregorian calendar."""
    return (y - 1970).astype("datetime64[Y]").astype("datetime64[M]").astype(np.int64).__add__(m - 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1


def _local(y, m, d, H=0, M=0, S=0, us=0) -> tuple[np.ndarray, np.ndarray]:
    """Local microseconds, and where date and time are real."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    m = np.where(ok, m, 1)
    y = np.where(ok, y, 1970)
    first = days_from_civil(y, m, np.ones_like(y))
    length = days_from_civil(y + m // 12, m % 12 + 1, np.ones_like(y)) - first
    ok = ok & (d <= length) & (H <= 23) & (M <= 59) & (S <= 59)
    return (((first + np.where(ok, d, 1) - 1) * 24 + H) * 60 + M) * 60_000_000 + S * 1_000_000 + us, ok


def _whole(c: np.ndarray, n: int) -> np.ndarray:
    return c if isinstance(c, np.ndarray) else np.full(n, c, dtype=np.int64)


class _Batch:
    """Results of one batch: ``value`` with ``zone`` >= 0 is local time in that zone, -1 is final, -2 is no instant."""

    def __init__(self, n: int, tz: np.ndarray, mdy: np.ndarray, names: list[str], table: dict[str, Zone]):
        self.value, self.zone = np.zeros(n, dtype=np.int64), np.full(n, -2, dtype=np.int64)
        self.tz, self.mdy, self.names, self.table = tz, mdy, names, table

    def zone_code(self, name: str) -> int | None:
        if name not in self.table:
            return None
        if name not in self.names:
            self.names.append(name)
        return self.names.index(name)

    def read(self, f: dict[str, tuple[int, int]], mat: np.ndarray, rows: np.ndarray) -> None:
        if "digits" in f:
            return self.digits(f["digits"], mat, rows)
        n = len(rows)
        tz, ok = self.tz[rows], np.ones(n, dtype=bool)
        if "T" in f:
            ok &= (mat[:, f["T"][0]] | 32) == ord("t")
        if "p" in f:
            p, q, mdy = _number(mat, f["p"]), _number(mat, f["q"]), self.mdy[rows]
            m, d = np.where(mdy == 1, p, q), np.where(mdy == 1, q, p)
            ok &= mdy >= 0
        else:
            d, m = _number(mat, f["d"]), _looked_up(mat, f["n"], _month) if "n" in f else _number(mat, f["m"])
        H, M, S = (_number(mat, f[k]) if k in f else 0 for k in "HMS")
        if "ap" in f:
            half = _looked_up(mat, f["ap"], {"am": 0, "pm": 12}.get)
            ok &= (half >= 0) & (H >= 1) & (H <= 12)
            H = H % 12 + np.maximum(half, 0)
        us = _micros(mat, f["f"]) if "f" in f else 0
        value, real = _local(_number(mat, f["y"]), m, d, *(_whole(x, n) for x in (H, M, S, us)))
        ok &= real
        if "z" in f:
            ok &= (mat[:, f["z"][0]] | 32) == ord("z")
            tz = np.full(n, -1)
        elif "sg" in f:
            hours, minutes = _number(mat, f["zh"]), _number(mat, f["zm"]) if "zm" in f else np.zeros(n, dtype=np.int64)
            ok &= (hours <= 18) & (minutes <= 59)
            value = value - np.where(mat[:, f["sg"][0]] == ord("-"), -1, 1) * (hours * 60 + minutes) * 60_000_000
            tz = np.full(n, -1)
        elif "zn" in f:
            value, tz, named = self.named(mat, f["zn"], value, tz)
            ok &= named
        self.value[rows], self.zone[rows] = value, np.where(ok, tz, -2)

    def named(self, mat, span, value, tz):
        """A zone's name, or an abbreviation as the writer's own zone means it, else as the fixed table has it."""
        code = _looked_up(mat, span, self.zone_code)
        if span[1] - span[0] > 5:
            return value, code, code >= 0
        text = np.ascontiguousarray(mat[:, span[0] : span[1]]).view(f"S{span[1] - span[0]}").ravel()
        known = np.zeros(len(value), dtype=bool)
        value, out = value.copy(), np.full(len(value), -1)
        pairs, at = np.unique(np.stack([np.unique(text, return_inverse=True)[1], tz]), axis=1, return_inverse=True)
        at = at.ravel()
        for k in range(pairs.shape[1]):
            here = np.flatnonzero(at == k)
            name, own = text[here[0]].decode("ascii", "replace"), pairs[1, k]
            shift = self.table[self.names[own]].abbreviations.get(name.upper()) if own >= 0 else None
            shift = ABBREVIATIONS.get(name.lower()) if shift is None or name.lower() in ("utc", "gmt") else shift
            if shift is not None:
                value[here] -= shift * 1_000_000
                known[here] = True
            elif code[here[0]] >= 0:
                out[here], known[here] = code[here], True
        return value, out, known

    def digits(self, span: tuple[int, int], mat: np.ndarray, rows: np.ndarray) -> None:
        width, n, at = span[1] - span[0], len(rows), span[0]
        done = np.zeros(n, dtype=bool)
        if width in _LOCAL_DIGITS:
            cut = lambda a, b: _number(mat, (at + a, at + b)) if b <= width else np.zeros(n, dtype=np.int64)
            us = _micros(mat, (at + 14, span[1])) if width > 14 else np.zeros(n, dtype=np.int64)
            value, done = _local(cut(0, 4), cut(4, 6), cut(6, 8), cut(8, 10), cut(10, 12), cut(12, 14), us)
            self.value[rows], self.zone[rows] = value, np.where(done, self.tz[rows], -2)
        if width not in (14, 17, 20) and not done.all():
            _, times, over = next(x for x in _COUNTS if width <= x[0])
            rest = np.flatnonzero(~done)
            count = _number(mat[rest], span)  # 19 digits can be too large for a bigint and are negative then
            self.value[rows[rest]], self.zone[rows[rest]] = count * times // over, np.where(count < 0, -2, -1)

    def resolve(self) -> np.ndarray:
        for code in np.unique(self.zone[self.zone >= 0]):
            here = np.flatnonzero(self.zone == code)
            self.value[here] = self.table[self.names[code]].to_utc(self.value[here])
        return self.zone != -2


def _codes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, list[str]]:
    """Small codes of a text column, -1 for null."""
    d = column.dictionary_encode() if not isinstance(column, pa.DictionaryArray) else column
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), [str(x).lower() if lower else x for x in d.dictionary.to_pylist()]


def parse(text: pa.Array, tz: pa.Array, order: pa.Array, table: dict[str, Zone]) -> pa.Array:
    """Microseconds since 1970 UTC of each text; tz and order ('dmy', 'mdy') are its writer's."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    n = len(text)
    if not n:
        return pa.array([], pa.int64())
    text = pa.concat_arrays([pc.ascii_trim_whitespace(text.cast(pa.large_string()))])
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    masks = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.copy()), pa.py_buffer(_CLASS[data]), *text.buffers()[:1] if text.offset == 0 else [None])
    code, shapes = _codes(masks, lower=False)
    zone, names = _codes(tz)
    zone = np.array([k if x in table else -2 for k, x in enumerate(names)] + [-2], dtype=np.int64)[zone]  # -1, for null, is the last
    orders, spelled = _codes(order)
    mdy = np.array([{"mdy": 1, "dmy": 0}.get(x, -1) for x in spelled] + [-1])[orders]
    batch = _Batch(n, zone, mdy, list(names), table)
    if text.null_count and text.offset:
        code = np.where(text.is_null().to_numpy(zero_copy_only=False), -1, code)
    by = np.argsort(code, kind="stable")
    ends = np.searchsorted(code[by], np.arange(-1, len(shapes)), side="right")
    for k, mask in enumerate(shapes):
        rows = by[ends[k] : ends[k + 1]]
        if mask and len(rows) and (fields := parser(mask)) is not None:
            step = max(1, CELLS // len(mask))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                batch.read(fields, data[offsets[part][:, None] + np.arange(len(mask))], part)
    known = batch.resolve()
    return pa.array(batch.value, mask=~known)


_shipped: dict[str, object] = {}


def zone_tables(spark: SparkSession):
    """The driver's zone tables as a broadcast variable, one for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.clear()
        _shipped[app] = spark.sparkContext.broadcast(zones.tables())
    return _shipped[app]


def to_instant(spark: SparkSession, text: Column, tz: Column, order: Column) -> Column:
    """Column of microseconds since 1970 UTC (bigint), null where the text denotes no instant."""
    ship(spark)
    table = zone_tables(spark)

    @F.arrow_udf("long")
    def instant(text: pa.Array, tz: pa.Array, order: pa.Array) -> pa.Array:
        return parse(text, tz, order, table.value)

    # kept from being evaluated twice, in a pushed-down filter and again for its value
    return instant.asNondeterministic()(text, tz, order)


#: A text that already is in the one unambiguous form.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"


def with_instant(df: DataFrame, writers: DataFrame, text: str, into: str, writer: str = "writer_id") -> DataFrame:
    """``df`` with the column ``into``: the instant (microseconds UTC) of ``text`` as its writer means it.

    ``writers`` has writer_id, tz and date_order; of repeated writer_ids the smallest tz counts. Rows of unknown
    writers stay, and their zone-less texts give null."""
    return reader(df.sparkSession, writers, text, into, writer)(df)


def reader(spark: SparkSession, writers: DataFrame, text: str, into: str, writer: str = "writer_id") -> Callable[[DataFrame], DataFrame]:
    """``with_instant`` for several frames; the size of ``writers`` is looked at once."""
    habits = F.struct("tz", "date_order")
    one = bounded_broadcast(writers.where("writer_id IS NOT NULL").groupBy(F.col("writer_id").alias("_w")).agg(F.min_by("tz", habits).alias("_z"), F.min_by("date_order", habits).alias("_o")))

    def read(df: DataFrame) -> DataFrame:
        w, z, o = (fresh_name(x, [*df.columns, into]) for x in ("_writer", "_tz", "_order"))
        joined = df.join(one.toDF(w, z, o), F.col(writer) == F.col(w), "left")
        return joined.withColumn(into, to_instant(spark, F.col(text), F.col(z), F.col(o))).drop(w, z, o)

    return read
