"""What changed between full snapshots (problem 5).

Method: EXCEPT ALL both ways leaves only rows without an identical partner; a full join of the two residues by key
labels them added, removed or changed.

``between`` does so for two given snapshots, ``consecutive`` for every pair of neighbouring snapshots of every entity
at once: the records stand once at their own snapshot's instant and once at the next one's, and the two tables are
subtracted from each other both ways. All of it groups and joins by at least (entity, branch), where the records lie
already, so neither EXCEPT ALL nor the full join shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronostrata.operators.merkle import PLACE
from chronostrata.operators.snapshots import Snapshots
from chronostrata.session import fresh_name


def between(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Key columns and kind ('added', 'removed', 'changed') of two snapshots with the same columns. Null keys equal each
    other. Repeated rows count: a row delivered once more than before is a change of its key."""
    columns = before.columns
    gone, new = before.exceptAll(after.select(columns)), after.select(columns).exceptAll(before)
    there, mark_a, mark_b = [fresh_name(f"_{k}", columns) for k in key], fresh_name("_gone", columns), fresh_name("_new", columns)
    a = gone.select(*[F.col(k).alias(t) for k, t in zip(key, there, strict=True)]).distinct().withColumn(mark_a, F.lit(True))
    b = new.select(*key).distinct().withColumn(mark_b, F.lit(True))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(key, there, strict=True)])
    kind = F.when(F.col(mark_a).isNull(), "added").when(F.col(mark_b).isNull(), "removed").otherwise("changed")
    joined = b.join(a, same, "full")
    # a key is only gone or new if it has no row at all in the other snapshot
    labelled = joined.select(*[F.when(F.col(mark_b).isNotNull(), F.col(k)).otherwise(F.col(t)).alias(k) for k, t in zip(key, there, strict=True)], kind.alias("kind"))
    inside = lambda x, name: x.select(*[F.col(k).alias(fresh_name(f"{name}_{k}", columns)) for k in key]).distinct().withColumn(name, F.lit(True))
    for name, frame, label in (("_in_before", before, "added"), ("_in_after", after, "removed")):
        other = inside(frame, name)
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(other[fresh_name(f"{name}_{k}", columns)]) for k in key])
        labelled = labelled.join(other, on, "left").select(*key, F.when((F.col("kind") == label) & F.col(name).isNotNull(), "changed").otherwise(F.col("kind")).alias("kind"))
    return labelled


def consecutive(snapshots: Snapshots) -> DataFrame:
    """(entity, key, at, kind) between every two consecutive snapshots of an entity, at being the later one's instant. The
    first snapshot of an entity gives nothing."""
    rows = snapshots.dated("was next")
    after = rows.where("was IS NOT NULL").select(*PLACE, "at", "key", "h1", "h2")
    before = rows.where("next IS NOT NULL").select(*PLACE, F.col("next").alias("at"), "key", "h1", "h2")
    new = after.exceptAll(before).select(*PLACE, "at", "key", F.lit(True).alias("new"))
    gone = before.exceptAll(after).select(*PLACE, "at", "key", F.lit(True).alias("gone"))
    kind = F.when(F.col("gone").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return new.join(gone, [*PLACE, "at", "key"], "full").select("entity", "key", "at", kind.alias("kind"))
