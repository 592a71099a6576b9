"""The six joins with NULL-rejecting (``by``) and NULL-matching (``na_by``) keys, and joins on any condition (``on``).

Output: x's columns by their names, then y's that aren't keys; y's that clash get ``.y``. Keys appear once, for rows
that only y has with y's value. NULL-matching keys are ``<=>``, which Spark hashes and sorts like plain keys. Joins
with ``on`` take the condition as SQL text over LHS and RHS.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOW = ("inner", "left", "right", "full", "semi", "anti")


def _pairs(by: str | list[str] | dict[str, str] | None) -> list[tuple[str, str]]:
    if by is None:
        return []
    if isinstance(by, str):
        return [(by, by)]
    return list(by.items()) if isinstance(by, dict) else [(c, c) for c in by]


def join(x: DataFrame, y: DataFrame, how: str = "inner", by: str | list[str] | dict[str, str] | None = None, na_by: str | list[str] | dict[str, str] | None = None, on: str | None = None, suffix: str = ".y") -> DataFrame:
    if how not in HOW:
        raise ValueError(f"how must be one of {', '.join(HOW)}")
    plain, null_safe = _pairs(by), _pairs(na_by)
    if not plain and not null_safe and on is None:
        plain = [(c, c) for c in x.columns if c in y.columns]
        if not plain:
            raise ValueError("the tables have no column in common: name the keys or give a condition")
    left, right = x.alias("LHS"), y.alias("RHS")
    lc, rc = (lambda c: F.col(f"LHS.`{c}`")), (lambda c: F.col(f"RHS.`{c}`"))
    terms: list[Column] = [lc(a) == rc(b) for a, b in plain] + [lc(a).eqNullSafe(rc(b)) for a, b in null_safe]
    if on is not None:
        terms.append(F.expr(on))
    joined = left.join(right, reduce(lambda p, q: p & q, terms), {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
    if how in ("semi", "anti"):
        return joined
    keys = dict(plain + null_safe)
    side = {"inner": lc, "left": lc}.get(how)
    out = [(lc(c) if c not in keys or side else rc(keys[c]) if how == "right" else F.coalesce(lc(c), rc(keys[c]))).alias(c) for c in x.columns]
    taken = list(x.columns)
    for c in y.columns:
        if c in keys.values():
            continue
        name = c
        while name in taken:
            name += suffix
        taken.append(name)
        out.append(rc(c).alias(name))
    return joined.select(*out)


def inner_join(x: DataFrame, y: DataFrame, by=None, na_by=None, on: str | None = None) -> DataFrame:
    return join(x, y, "inner", by, na_by, on)


def left_join(x: DataFrame, y: DataFrame, by=None, na_by=None, on: str | None = None) -> DataFrame:
    return join(x, y, "left", by, na_by, on)


def right_join(x: DataFrame, y: DataFrame, by=None, na_by=None, on: str | None = None) -> DataFrame:
    return join(x, y, "right", by, na_by, on)


def full_join(x: DataFrame, y: DataFrame, by=None, na_by=None, on: str | None = None) -> DataFrame:
    """Keeps repeated rows: it is one native outer join, not a union of two."""
    return join(x, y, "full", by, na_by, on)


def semi_join(x: DataFrame, y: DataFrame, by=None, na_by=None, on: str | None = None) -> DataFrame:
    return join(x, y, "semi", by, na_by, on)


def anti_join(x: DataFrame, y: DataFrame, by=None, na_by=None, on: str | None = None) -> DataFrame:
    return join(x, y, "anti", by, na_by, on)


def not_in(x: DataFrame, y: DataFrame, column: str, other: str | None = None) -> DataFrame:
    """SQL's NOT IN: no row at all if ``y`` holds a null and isn't empty. Use ``anti_join`` where nulls should just not
    match. Planned as an anti join after one look at y, so no null-aware broadcast of unbounded size is needed."""
    other = other or column
    has_null, empty = y.agg(F.bool_or(F.col(other).isNull()), F.count(F.lit(1)) == 0).first()
    if empty:
        return x
    if has_null:
        return x.limit(0)
    return join(x.where(F.col(column).isNotNull()), y, "anti", {column: other})
