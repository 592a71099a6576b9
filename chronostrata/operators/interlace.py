"""Interlacing histories: several tables with their own validity on one time axis per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronostrata.operators import axis as axes
from chronostrata.operators import rangescan
from chronostrata.session import cut, micros

#: An open end, as the last instant of an axis.
OPEN = 2**63 - 1


#: A block of each size holds 2 ** BITS of the next smaller.
BITS = 10


def blocks(first: Column, last: Column, sizes: int) -> Column:
    """Array of (_z, _block): the numbers first..last as disjoint blocks of 2 ** (BITS * z) numbers, z < sizes."""
    parts, lo, hi = [], first, last + 1
    some = lambda a, b, z: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(z).alias("_z"), x.alias("_block")))).otherwise(F.array().cast("array<struct<_z:int,_block:bigint>>"))
    for z in range(sizes - 1):
        up, down = F.shiftright(lo + (2**BITS - 1), BITS), F.shiftright(hi, BITS)
        inner = up < down  # otherwise no block of the next size lies inside, and all of it is written here
        none = F.lit(0).cast("bigint")
        parts += [some(lo, F.when(inner, F.shiftleft(up, BITS)).otherwise(hi), z), some(F.when(inner, F.shiftleft(down, BITS)).otherwise(none), F.when(inner, hi).otherwise(none), z)]
        lo, hi = F.when(inner, up).otherwise(none), F.when(inner, down).otherwise(none)
    return F.concat(*parts, some(lo, hi, sizes - 1))


def interlace(tables: list[DataFrame], by: str | list[str], colnames: dict[str, str] | None = None) -> DataFrame:
    """Key, the tables' columns, valid_from, valid_until: for each stretch between two consecutive endpoints of a key, the
    values that each table holds there (null where it holds none).

    ``colnames`` maps 't1.from', 't1.until', 't2.from' ... to the tables' own names of the validity columns. Rows of one
    table that overlap each other give one row each; rows that end before or when they begin hold nowhere, and rows
    without a start neither. Null keys form a key of their own.

    The stretches of a key are numbered by one range-sorted scan. A table's row covers the numbers from the stretch that
    begins with it to the one that ends with it. Such a range is written as blocks of 1, 1,024, 1,048,576 ... stretches
    (``blocks``), of each size 2,046 at most, and a stretch knows the block of each size that it lies in, so containment
    becomes plain equality of (key, size, block): no join looks at pairs that don't match, no row holds more than a few
    thousand numbers however long it lasts, and a key with much of the data spreads over all partitions.
    """
    keys = [by] if isinstance(by, str) else list(by)
    if not keys:
        raise ValueError("name at least one key")
    if len(tables) == 1:
        return tables[0]
    named, values = [], []
    for k, table in enumerate(tables, 1):
        start, end = (colnames or {}).get(f"t{k}.from", "valid_from"), (colnames or {}).get(f"t{k}.until", "valid_until")
        own = [c for c in table.columns if c not in (*keys, start, end)]
        named.append(table.select(rangescan.entity_text(table, keys).alias("_key"), F.coalesce(micros(start), F.lit(OPEN)).alias("_f"), F.coalesce(micros(end), F.lit(OPEN)).alias("_u"), *[F.col(f"`{c}`") for c in own]))
        values.append(own)
    if clash := {c for k, v in enumerate(values) for c in v if any(c in w for w in values[:k])}:
        raise ValueError(f"columns of more than one table: {', '.join(sorted(clash))}")
    points = reduce(DataFrame.union, [t.select(F.col("_key").alias("key"), F.explode(F.array("_f", "_u")).alias("t")) for t in named])
    axis = cut(axes.stretches(points))
    result, most = axis, axis.agg(F.max("n")).first()[0] or 0
    sizes = next(k for k in range(1, 8) if most >> (BITS * k) == 0)
    marked = axis.select(F.col("key").alias("_k3"), F.col("n").alias("_n"), F.inline(F.array(*[F.struct(F.lit(z).alias("_z3"), F.shiftright("n", BITS * z).alias("_block3")) for z in range(sizes)])))
    first, last = axis.select(F.col("key").alias("_k1"), F.col("f").alias("_f1"), F.col("n").alias("_a")), axis.select(F.col("key").alias("_k2"), F.col("u").alias("_u2"), F.col("n").alias("_b"))
    for k, t in enumerate(named):
        held = t.where("_f < _u").join(first, F.col("_key").eqNullSafe(F.col("_k1")) & (F.col("_f") == F.col("_f1"))).join(last, F.col("_key").eqNullSafe(F.col("_k2")) & (F.col("_u") == F.col("_u2")))
        own = [F.col(f"`{c}`").alias(f"_v{k}_{i}") for i, c in enumerate(values[k])]
        held = held.select(F.col("_key").alias(f"_key{k}"), F.inline(blocks(F.col("_a"), F.col("_b"), sizes)), *own)
        if sizes > 1:
            held = held.join(marked, F.col(f"_key{k}").eqNullSafe(F.col("_k3")) & (F.col("_z") == F.col("_z3")) & (F.col("_block") == F.col("_block3"))).drop("_block", "_k3", "_z3", "_block3")
        else:
            held = held.withColumnRenamed("_block", "_n")
        held = held.drop("_z").withColumnRenamed("_n", f"_n{k}")
        result = result.join(held, F.col("key").eqNullSafe(F.col(f"_key{k}")) & (F.col("n") == F.col(f"_n{k}")), "left").drop(f"_key{k}", f"_n{k}")
    kinds = {c: kind for c, kind in tables[0].dtypes}
    kind = kinds[(colnames or {}).get("t1.from", "valid_from")]
    instant = lambda c: F.timestamp_micros(F.nullif(F.col(c), F.lit(OPEN))).cast(kind)
    return result.select(*rangescan.entity_columns(tables[0], keys, "key"), *[F.col(f"_v{k}_{i}").alias(c) for k, v in enumerate(values) for i, c in enumerate(v)], instant("f").alias("valid_from"), instant("u").alias("valid_until"))
