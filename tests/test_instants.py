"""Mixed spellings of instants, against one-row-at-a-time conversion with the standard library."""

import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronostrata.functions import zones
from chronostrata.functions.instants import compile_mask, parse, with_instant
from chronostrata.session import utc_text

ZONES = ["Europe/Copenhagen", "America/New_York", "Asia/Kolkata", "Australia/Sydney", "UTC", "America/St_Johns", "Africa/Casablanca"]
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def one(text, tz="UTC", order="dmy"):
    got = parse(pa.array([text], pa.string()), pa.array([tz], pa.string()), pa.array([order], pa.string()), zones.tables())[0].as_py()
    return None if got is None else (EPOCH + timedelta(microseconds=got)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def us(moment):
    return (moment - EPOCH) // timedelta(microseconds=1)


@pytest.mark.parametrize("text,tz,order,want", [
    ("2021-02-11 09:00:00", "Europe/Copenhagen", "dmy", "2021-02-11T08:00:00.000000Z"),
    ("2021-02-11T09:00:00.25+05:45", None, None, "2021-02-11T03:15:00.250000Z"),
    ("  2021-02-11 09:00:00.123456 -05:00 ", None, None, "2021-02-11T14:00:00.123456Z"),
    ("2021-02-11t09:00:00z", "Asia/Tokyo", "dmy", "2021-02-11T09:00:00.000000Z"),
    ("2021-02-11T09:00:00.123456789Z", None, None, "2021-02-11T09:00:00.123456Z"),
    ("20210211T090000Z", None, None, "2021-02-11T09:00:00.000000Z"),
    ("20210211090000", "Asia/Kolkata", "dmy", "2021-02-11T03:30:00.000000Z"),
    ("1613034000", "Asia/Kolkata", "dmy", "2021-02-11T09:00:00.000000Z"),
    ("1613034000123", None, None, "2021-02-11T09:00:00.123000Z"),
    ("1613034000123456", None, None, "2021-02-11T09:00:00.123456Z"),
    ("1613034000123456789", None, None, "2021-02-11T09:00:00.123456Z"),
    ("9999999999999999999", "UTC", "dmy", None), ("20211399000000", "UTC", "dmy", None), ("20210211", "UTC", "dmy", "2021-02-11T00:00:00.000000Z"),
    ("03/02/2021 13:45", "UTC", "dmy", "2021-02-03T13:45:00.000000Z"),
    ("03/02/2021 13:45", "UTC", "mdy", "2021-03-02T13:45:00.000000Z"),
    ("03/02/2021 1:45 PM", "UTC", "mdy", "2021-03-02T13:45:00.000000Z"),
    ("Aug 8, 2021 12:00 AM", "UTC", "dmy", "2021-08-08T00:00:00.000000Z"),
    ("1 Nov 2021 00:00", "UTC", "mdy", "2021-11-01T00:00:00.000000Z"),
    ("Fri, 08 Jan 2021 01:15:00 +0530", None, None, "2021-01-07T19:45:00.000000Z"),
    ("05.03.2021 01:15:00", "UTC", "mdy", "2021-03-05T01:15:00.000000Z"),
    ("2021-07-05 01:15:00,5", "UTC", "mdy", "2021-07-05T01:15:00.500000Z"),
    ("2021-07-05 01:15:00 CEST", "America/New_York", "mdy", "2021-07-04T23:15:00.000000Z"),
    ("2021-07-05 01:15:00 America/New_York", "Asia/Tokyo", "mdy", "2021-07-05T05:15:00.000000Z"),
    ("2021-07-05", "America/New_York", "mdy", "2021-07-05T04:00:00.000000Z"),
    # a time that occurs twice is the earlier one, a skipped one moves forward
    ("2021-10-31 02:30:00", "Europe/Copenhagen", "dmy", "2021-10-31T00:30:00.000000Z"),
    ("2021-03-28 02:30:00", "Europe/Copenhagen", "dmy", "2021-03-28T01:30:00.000000Z"),
    ("2021-03-28 02:30:00 Europe/Copenhagen", "UTC", "dmy", "2021-03-28T01:30:00.000000Z"),
    # no instants
    (None, "UTC", "dmy", None), ("", "UTC", "dmy", None), ("pending", "UTC", "dmy", None), ("2023-02-30 08:00:00", "UTC", "dmy", None),
    ("2023-13-04 09:00:00", "UTC", "dmy", None), ("2022-10-01T25:61:00Z", "UTC", "dmy", None), ("0000-00-00 00:00:00", "UTC", "dmy", None),
    ("13/13/2021 10:00", "UTC", "dmy", None), ("2021-01-01 10:00:00", None, "dmy", None), ("2021-01-01 10:00:00", "No/Where", "dmy", None),
    ("03/02/2021 13:45", "UTC", None, None), ("2021-01-01x10:00:00", "UTC", "dmy", None), ("x" * 5000, "UTC", "dmy", None), ("２０２１-01-01", "UTC", "dmy", None),
])
def test_spellings(text, tz, order, want):
    assert one(text, tz, order) == want


@given(st.lists(st.tuples(st.datetimes(datetime(1975, 1, 1), datetime(2090, 1, 1)), st.sampled_from(ZONES)), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_local_times_as_zoneinfo_has_them(moments):
    text = [m.strftime("%Y-%m-%d %H:%M:%S.%f") for m, _ in moments]
    tz = [z for _, z in moments]
    got = parse(pa.array(text), pa.array(tz), pa.array(["dmy"] * len(tz)), zones.tables()).to_pylist()
    # fold=0 is the offset before a transition, in gaps and overlaps alike
    assert got == [us(m.replace(tzinfo=ZoneInfo(z), fold=0)) for m, z in moments]


@given(st.lists(st.tuples(st.datetimes(datetime(1850, 1, 1), datetime(9999, 12, 30)), st.sampled_from([*ZONES, "Europe/Berlin", "America/Santiago", "Asia/Gaza", "Australia/Lord_Howe", "Europe/Dublin"]), st.integers(0, 500), st.text("0123456789", min_size=1, max_size=30), st.sampled_from(" \t\n")), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_no_padding_fraction_or_year_is_a_border(moments):
    text = [s * n + m.strftime("%Y-%m-%d %H:%M:%S.").zfill(20) + f + s * (n // 3) for m, _, n, f, s in moments]
    tz = [z for _, z, *_ in moments]
    got = parse(pa.array(text), pa.array(tz), pa.array(["dmy"] * len(tz)), zones.tables()).to_pylist()
    assert got == [us(m.replace(tzinfo=ZoneInfo(z), fold=0, microsecond=int(f[:6].ljust(6, "0")))) for m, z, _, f, _ in moments]


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/Santiago", "Asia/Gaza", "Africa/Casablanca", "America/Nuuk"])
def test_every_day_of_far_years(zone):
    days = [datetime(y, 1, 1, 12) + timedelta(days=d) for y in (2087, 2099, 2100, 2101, 2128, 2129, 2150, 2200, 2400, 9998) for d in range(365)]
    got = zones.tables()[zone.lower()].to_utc(np.array([us(m.replace(tzinfo=UTC)) for m in days]))
    assert got.tolist() == [us(m.replace(tzinfo=ZoneInfo(zone))) for m in days]


def test_long_texts():
    assert one("Wednesday, September 30, 2020 12:30:45.123456 PM America/Argentina/ComodRivadavia") == "2020-09-30T15:30:45.123456Z"
    assert one("2020-01-01 00:00:00" + " " * 100_000) == "2020-01-01T00:00:00.000000Z"
    assert one("2020-01-01 00:00:00." + "1" * 100_000) == "2020-01-01T00:00:00.111111Z"
    assert one("9" * 100_000) is None and one("a" * 100_000) is None


@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="0123456789-:/. TZ+amp", max_size=26)), max_size=40))
@settings(max_examples=200, deadline=None)
def test_any_text_is_read_or_null(texts):
    got = parse(pa.array(texts, pa.string()), pa.array(["Europe/Lisbon"] * len(texts), pa.string()), pa.array(["mdy"] * len(texts), pa.string()), zones.tables())
    assert len(got) == len(texts)


def test_sliced_arrays_and_batches_don_t_depend_on_their_neighbours():
    random.seed(3)
    texts = [random.choice(["2021-02-11 09:00:00", None, "1613034000", "x", "03/02/2021 13:45"]) for _ in range(500)]
    col = lambda v: pa.array(v, pa.string())
    whole = parse(col(texts), col(["UTC"] * 500), col(["dmy"] * 500), zones.tables()).to_pylist()
    part = parse(col(texts).slice(100, 50), col(["UTC"] * 50), col(["dmy"] * 50), zones.tables()).to_pylist()
    assert part == whole[100:150]


def test_masks_are_compiled_once():
    compile_mask.cache_clear()
    col = lambda v: pa.array(v * 1000, pa.string())
    parse(col(["2021-02-11 09:00:00", "2022-02-11 09:00:00"]), col(["UTC", "UTC"]), col(["dmy", "dmy"]), zones.tables())
    assert compile_mask.cache_info().misses == 1


def test_zone_tables_are_sorted_and_versioned():
    assert zones.version() != "unknown"
    for z in zones.tables().values():
        assert (np.diff(z.border) >= 0).all() and len(z.offset) == len(z.border) + 1


def test_column_with_clashing_names_nulls_and_unknown_writers(spark):
    writers = spark.createDataFrame([(1, "Asia/Tokyo", "dmy"), (1, "Asia/Tokyo", "dmy"), (None, "UTC", "dmy")], "writer_id int, tz string, date_order string")
    rows = spark.createDataFrame([(1, "2021-01-01 09:00", "a"), (9, "2021-01-01 09:00", "b"), (None, "2021-01-01T09:00:00Z", "c"), (1, None, "d")], "writer_id int, text string, _tz string")
    got = {r["_tz"]: r["utc"] for r in with_instant(rows, writers, "text", "us").withColumn("utc", utc_text("us")).collect()}
    assert got == {"a": "2021-01-01T00:00:00.000000Z", "b": None, "c": "2021-01-01T09:00:00.000000Z", "d": None}
    assert with_instant(rows.limit(0), writers, "text", "us").count() == 0
