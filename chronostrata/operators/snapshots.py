"""Reading deliveries of full snapshots, and placing them in partitions that bear any skew.

``Snapshots`` is what the operators on full snapshots take: the records (entity, branch, at, key, h1, h2), and the
calendar (entity, branch, at, was, next, depth) of the instants at which each entity was delivered, with the snapshots
before and after. Both are hash-partitioned by (entity, branch): entities with many rows are divided into branches by
the hash of the key, all others stay whole. Every later step groups and joins by at least (entity, branch), so none of
them moves a record again.

A branch holds about ``BRANCH_ROWS`` rows (or a 65,536th of all, if that is more), and there are as many partitions as
``PARTITION_ROWS`` asks for, so the work of one task doesn't grow with the data.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronostrata.functions.instants import reader
from chronostrata.session import beside, cut, placed, shuffle_width

#: At most this many entities are ever divided, as each has over 1 / MAX_DIVIDED of all rows; their list is a few MB.
MAX_DIVIDED = 65_536
#: Rows of all snapshots together that a branch should have at most, and that a partition should have.
BRANCH_ROWS, PARTITION_ROWS = 1_000_000, 2_000_000
#: Records that a leaf bucket of a snapshot should have at most, and the children of a node (see ``merkle``).
LEAF_ROWS, FANOUT = 64, 16


@dataclass(frozen=True)
class Snapshots:
    records: DataFrame
    calendar: DataFrame
    depth: int
    width: int

    def dated(self, columns: str) -> DataFrame:
        """The records with columns of the calendar."""
        return self.records.join(beside(self.calendar.select("entity", "branch", "at", *columns.split())), ["entity", "branch", "at"])

    def stored(self) -> Snapshots:
        """With the records written where they lie, for operators that read them in more than one job."""
        return replace(self, records=placed(self.records, ["entity", "branch"], self.width))


def payload_hashes(columns: list[str]) -> list[Column]:
    """128 bits over the payload in which null equals null and nothing else. Spark's hash passes over nulls, hence the bit mask of them."""
    nulls = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(c).isNull(), F.lit(1 << (k % 60))).otherwise(F.lit(0)) for k, c in enumerate(columns)], F.lit(0)) if columns else F.lit(0)
    spread = F.concat_ws("", *[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns]) if len(columns) > 60 else nulls
    cols = [F.col(c) for c in columns]
    return [F.xxhash64(spread, *cols).alias("h1"), F.xxhash64(*reversed(cols), F.lit(7), spread).alias("h2")]


def partitions(spark: SparkSession, rows: int) -> int:
    return max(shuffle_width(spark), min(100_000, -(-rows // PARTITION_ROWS)))


def divided(sizes: DataFrame, width: int, total: int) -> DataFrame | None:
    """(entity, branches) of the entities with more rows than a branch should have, given (entity, at, n); None if there is
    none. The result has fewer than MAX_DIVIDED rows whatever the data, as each stands for over 1 / MAX_DIVIDED of them."""
    unit = max(total / MAX_DIVIDED, min(BRANCH_ROWS, total / (4 * width)))
    counts = sizes.groupBy("entity").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") > unit).select("entity", F.ceil(F.col("n") / unit).cast("int").alias("branches")).collect()
    return sizes.sparkSession.createDataFrame(rows, counts.select("entity", F.lit(0).alias("branches")).schema) if rows else None


def branched(df: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """Adds branches: 1 for entities that aren't divided."""
    if heavy is None:
        return df.withColumn("branches", F.lit(1))
    return df.join(F.broadcast(heavy), "entity", "left").withColumn("branches", F.coalesce("branches", F.lit(1)))


def _calendar(sizes: DataFrame, heavy: DataFrame | None, width: int) -> DataFrame:
    w = Window.partitionBy("entity")
    rows = sizes.select("entity", "at", *[f("at").over(w.orderBy("at")).alias(n) for f, n in ((F.lag, "was"), (F.lead, "next"))], F.max("n").over(w).alias("most"))
    share = F.col("most") / F.col("branches")
    depth = F.greatest(F.lit(0), F.ceil(F.log(float(FANOUT), F.greatest(share / LEAF_ROWS, F.lit(1.0))))).cast("int")
    rows = branched(rows, heavy).select("entity", F.explode(F.sequence(F.lit(0), F.col("branches") - 1)).alias("branch"), "at", "was", "next", depth.alias("depth"))
    return cut(rows.repartition(width, "entity", "branch"))


def arranged(records: DataFrame, sizes: DataFrame, best: Column | None = None) -> Snapshots:
    """Of records (entity, at, key, h1, h2 and what ``best``, an aggregate, refers to) and sizes (entity, at, n): how many rows
    each snapshot was delivered with. ``best`` gives a struct with h1 and h2 of the row that counts; without it the records
    must be distinct by entity, at and key already."""
    spark = records.sparkSession
    # joins of what lies together by (entity, branch) must not move it again to be together by all of their keys
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    sizes = cut(sizes)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    width = partitions(spark, total)
    heavy = divided(sizes, width, total)
    calendar = _calendar(sizes, heavy, width)
    rows = branched(records.where("entity IS NOT NULL AND at IS NOT NULL AND key IS NOT NULL"), heavy)
    rows = rows.withColumn("branch", F.pmod(F.xxhash64("key"), F.col("branches")).cast("int")).drop("branches")
    if best is not None:
        # repeated rows are reduced where they lie, before anything moves: copies of one record may be a large part of the data
        rows = rows.groupBy("entity", "branch", "at", "key").agg(best.alias("best")).select("entity", "branch", "at", "key", "best.h1", "best.h2")
    depth = calendar.agg(F.max("depth")).first()[0] or 0
    return Snapshots(rows.select("entity", "branch", "at", "key", "h1", "h2").repartition(width, "entity", "branch"), calendar, depth, width)


def delivered(df: DataFrame, writers: DataFrame, entity: str, key: str, text: str, arrival: str, tie: str, payload: list[str], writer: str = "writer_id") -> Snapshots:
    """Every delivered record, one for each key of a snapshot: of repeated ones the last to arrive (ties: the greatest
    ``tie``; nulls first). Rows without entity, key or readable instant don't count. The table is read twice: once for
    the instants alone, which give the calendar, and once for the records."""
    raw = df.where(F.col(entity).isNotNull() & F.col(key).isNotNull())
    read = reader(df.sparkSession, writers, "text", "at", "writer")
    timed = lambda x: read(x).drop("writer", "text").where("at IS NOT NULL")
    names = [F.col(entity).alias("entity"), F.col(text).alias("text"), F.col(writer).alias("writer")]
    sizes = timed(raw.select(*names)).groupBy("entity", "at").agg(F.count(F.lit(1)).alias("n"))
    rows = raw.select(*names, F.col(key).alias("key"), F.unix_micros(F.col(arrival).cast("timestamp")).alias("arrival"), F.col(tie).alias("tie"), *payload_hashes(payload))
    return arranged(timed(rows), sizes, F.max(F.struct("arrival", "tie", "h1", "h2")))
