"""History of changing attributes from full snapshots (problem 2).

Method: Merkle comparison. Each snapshot of an entity is a tree of hashes: its records fall into leaf buckets by the
hash of their key, a leaf's hash covers its records, an inner node's hash covers its children. Consecutive snapshots
are compared from the root down; only below nodes whose hashes differ are the children looked at. Then the records of
leaf buckets that differ, and no others, are compared by key, and their changes become new versions.

Scale: records lie by (entity, branch) (see ``snapshots``); a branch of a divided entity is a tree of its own. The
trees hold hashes alone, and a tree is as deep as its largest snapshot asks for, so a leaf stands for about
``LEAF_ROWS`` records of a snapshot whatever its size. No step gathers records in one row; no step shuffles them. Hashes
are XORs of 64-bit hashes taken twice under different seeds, so the order of rows doesn't matter.

Defined results: an empty table gives an empty history; a key that is missing from a snapshot ends its version there;
a key that comes back opens a new version; snapshots that change nothing extend the open versions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronostrata.operators.snapshots import FANOUT, Snapshots
from chronostrata.session import beside, cut

PLACE = ["entity", "branch"]


def _hash(*cols: str) -> Column:
    """Over a node's contents, in any order."""
    return F.struct(F.bit_xor(F.xxhash64(*cols)).alias("a"), F.bit_xor(F.xxhash64(F.lit(11), *cols)).alias("b"), F.count(F.lit(1)).alias("n"))


def _path(depth: int) -> list[str]:
    return [f"p{level}" for level in range(depth)]


def dated(snapshots: Snapshots) -> DataFrame:
    """The records with the snapshot after theirs, and the path to their leaf bucket (0 below their own tree's depth)."""
    rows = snapshots.dated("next depth")
    spread = F.xxhash64(F.lit(3), "key")
    digit = lambda level: F.pmod(F.shiftright(spread, 8 * level), F.lit(FANOUT)).cast("int")
    return rows.withColumns({p: F.when(F.col("depth") > level, digit(level)).otherwise(0) for level, p in enumerate(_path(snapshots.depth))}).drop("depth")


def trees(records: DataFrame, depth: int) -> list[DataFrame]:
    """The nodes (entity, branch, at, next, path, hash) of every level, the root first. Leaf hashes are materialised, as
    each of the levels is made of them."""
    key = [*PLACE, "at", "next"]
    levels = [cut(records.groupBy(*key, *_path(depth)).agg(_hash("key", "h1", "h2").alias("hash")))]
    for level in range(depth - 1, -1, -1):
        below = levels[0].withColumns({f"h{x}": F.col(f"hash.{x}") for x in "abn"})
        levels.insert(0, below.groupBy(*key, *_path(level)).agg(_hash(f"p{level}", "ha", "hb", "hn").alias("hash")))
    return levels


def differing(levels: list[DataFrame]) -> DataFrame:
    """(entity, branch, at, path): the leaf buckets that differ from the snapshot before, found from the root down."""
    found = None
    for level, nodes in enumerate(levels):
        path = _path(level)
        none = F.lit(None).cast(nodes.schema["hash"].dataType)
        sides = F.array_compact(F.array(
            F.struct(F.col("at").alias("at"), F.col("hash").alias("now"), none.alias("was")),
            F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("at"), none.alias("now"), F.col("hash").alias("was"))),
        ))
        both = nodes.select(*PLACE, *path, F.inline(sides))
        if found is not None:  # children of nodes that are equal aren't looked at
            both = both.join(found, [*PLACE, "at", *path[:-1]], "left_semi")
        both = both.groupBy(*PLACE, "at", *path).agg(F.max("now").alias("now"), F.max("was").alias("was"))
        found = both.where(~F.col("now").eqNullSafe(F.col("was"))).select(*PLACE, "at", *path)
    return found


def changes(snapshots: Snapshots) -> DataFrame:
    """(entity, branch, at, key, h1, h2, was1, was2): each record that differs from the snapshot before; h1 is null where
    it is gone, was1 where it is new."""
    records, path = dated(snapshots.stored()), _path(snapshots.depth)
    leaves = beside(cut(differing(trees(records, snapshots.depth))))
    inside = lambda rows, *names: rows.join(leaves, [*PLACE, "at", *path], "left_semi").select(*PLACE, "at", "key", *[F.col(h).alias(n) for h, n in zip(("h1", "h2"), names, strict=True)])
    now = inside(records.drop("next"), "h1", "h2")
    was = inside(records.where("next IS NOT NULL").withColumn("at", F.col("next")).drop("next"), "was1", "was2")
    both = now.join(was, [*PLACE, "at", "key"], "full")
    return both.where(~reduce(lambda p, q: p & q, [F.col(a).eqNullSafe(F.col(b)) for a, b in (("h1", "was1"), ("h2", "was2"))]))


def history(snapshots: Snapshots) -> DataFrame:
    """(entity, key, h1, h2, from_us, until_us): the versions; until_us is null for those that still hold."""
    w = Window.partitionBy(*PLACE, "key").orderBy("at")
    found = changes(snapshots).withColumn("until_us", F.lead("at").over(w))
    return found.where("h1 IS NOT NULL").select("entity", "key", "h1", "h2", F.col("at").alias("from_us"), "until_us")
