"""Processing only what is new or changed since the last successful run (problem 7).

Method: a high watermark for each entity, on a monotonic sequence. A run's upper bound is fixed before the source is
looked at; it handles what lies in [watermark, bound), and its output and the new watermarks become visible in one
manifest. A run that dies at any point leaves both as they were, and its successor takes over its range. A watermark
never goes back.

``WatermarkExport.run`` takes requests: one run of one entity, or the log of many runs of many entities since the last
commit. Within a log the watermark that a run finds is the greatest of the committed one and of the bounds that
succeeded before it (a running maximum); records are assigned to the runs' ranges by the as-of scan. Both are
range-sorted scans, which bear any skew. ``export`` is the plain step for one stream without entities.

Defined results. Runs without entity, bound, start or id don't count, nor do records without any instant in range. Of
runs that start together each sees the watermark before all of them. A run whose bound isn't beyond its watermark
exports nothing, so a run that is requested again after its commit repeats nothing. Repeated rows, of the log or of the
records, change nothing. Runs of one log count as later than every commit before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronostrata.operators.asof import as_of
from chronostrata.operators.axis import maximum_before
from chronostrata.session import cut
from chronostrata.sources.manifest import Manifests

#: Stands for "no lower bound".
ALWAYS = -(2**62)
MARKS = "entity string, bound long"


class WatermarkExport:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.manifests = spark, root, Manifests(spark, root)

    def watermarks(self) -> DataFrame:
        """(entity, bound) of every entity that was exported."""
        found = self.manifests.read()
        if not found:
            return self.spark.createDataFrame([], MARKS)
        return self.spark.read.schema(MARKS).parquet(f"{self.root}/marks/v{found['version']}")

    def watermark(self, entity: str = "") -> int | None:
        return self.watermarks().where(F.col("entity") == entity).agg(F.max("bound")).first()[0]

    def commit(self, output: DataFrame, marks: DataFrame) -> int:
        """Writes the output and the watermarks (entity, bound), then makes them visible together. Entities that aren't named
        keep their watermark; one that would go back is an error, and nothing is committed."""
        found = self.manifests.read()
        version = (found["version"] if found else 0) + 1
        now, new = self.watermarks().withColumnRenamed("bound", "now"), marks.where("bound IS NOT NULL").groupBy("entity").agg(F.max("bound").alias("new"))
        both = cut(now.join(new, "entity", "full"))
        if back := both.where("new < now").limit(1).collect():
            raise ValueError(f"the watermark of {back[0]['entity']!r} stands at {back[0]['now']} and can't go back to {back[0]['new']}")
        output.write.mode("overwrite").parquet(f"{self.root}/out/v{version}")
        both.select("entity", F.coalesce("new", "now").alias("bound")).write.mode("overwrite").parquet(f"{self.root}/marks/v{version}")
        self.manifests.commit(version, {"outputs": [*(found["outputs"] if found else []), version]})
        return version

    def run(self, records: DataFrame, requests: DataFrame) -> int | None:
        """Exports the records (entity, instants: array of bigint, and other columns) of each requested run (run, entity, bound,
        start, success; bigint bound and start), as the run and the other columns. Runs that didn't succeed export nothing
        and move nothing. The new version; None if no run succeeded."""
        requests = cut(successful(requests))  # the bounds are fixed here, before the source is read
        marks = self.watermarks()
        ranges = cut(windows(requests, marks))
        low, high = ranges.agg(F.min("low"), F.max("high")).first()
        done = requests.groupBy("entity").agg(F.max("bound").alias("bound")).join(marks.withColumnRenamed("bound", "now"), "entity", "left").select("entity", F.greatest("bound", "now").alias("bound"))
        if low is None:
            return None
        inside = records.where(F.exists("instants", lambda t: (t >= low) & (t < high)))
        return self.commit(assigned(inside, ranges), done)

    def export(self, source: DataFrame, sequence: list[str], bound: int) -> int | None:
        """For one stream: exports the rows of which one of the ``sequence`` columns (bigint) lies in [watermark, bound). None if
        the bound isn't beyond the watermark."""
        low = self.watermark()
        if low is not None and bound <= low:
            return None
        inside = F.lit(False)
        for c in sequence:
            inside = inside | F.coalesce((F.col(c) < bound) & (F.lit(True) if low is None else F.col(c) >= low), F.lit(False))
        return self.commit(source.where(inside), self.spark.createDataFrame([("", bound)], MARKS))

    def read(self, version: int | None = None) -> DataFrame:
        """What all commits, or one of them, put out."""
        found = self.manifests.read()
        if not found:
            raise LookupError(f"nothing was committed at {self.root}")
        return self.spark.read.parquet(*[f"{self.root}/out/v{v}" for v in found["outputs"] if version in (None, v)])


def successful(runs: DataFrame) -> DataFrame:
    """(run, entity, bound, start) of the complete requests that any of their rows calls a success."""
    whole = runs.where("entity IS NOT NULL AND bound IS NOT NULL AND start IS NOT NULL AND run IS NOT NULL")
    return whole.groupBy("run", "entity").agg(F.max("bound").alias("bound"), F.min("start").alias("start"), F.bool_or("success").alias("ok")).where("ok").drop("ok")


def windows(done: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(entity, low, high, runs): disjoint ranges per entity, each with the runs that export it; of successful runs (run,
    entity, bound, start) and of watermarks (entity, bound). low is ALWAYS where nothing was exported before."""
    rows = done.select(F.col("entity").alias("key"), F.col("start").alias("t"), F.col("bound").alias("v"), "run", "entity", "bound")
    if marks is not None:  # a watermark counts as a bound that succeeded before every run
        rows = rows.unionByName(marks.select(F.col("entity").alias("key"), F.lit(ALWAYS).alias("t"), F.col("bound").alias("v"), "entity", "bound"), allowMissingColumns=True)
    found = maximum_before(rows, ["run", "entity", "bound"]).where("run IS NOT NULL")
    found = found.withColumn("low", F.coalesce("before", F.lit(ALWAYS))).where("bound > low")
    # runs that start together share their lower bound: cut their nested windows at each of the bounds
    together = Window.partitionBy("entity", "low").orderBy("bound")
    cuts = found.withColumn("from", F.coalesce(F.lag("bound").over(together), F.col("low"))).withColumn("runs", F.collect_list("run").over(together.rowsBetween(0, Window.unboundedFollowing)))
    return cuts.where("bound > from").select("entity", F.col("from").alias("low"), F.col("bound").alias("high"), "runs")


def assigned(records: DataFrame, ranges: DataFrame) -> DataFrame:
    """run and the records' own columns, of every run: each record once for each run that one of its instants falls to."""
    own = [c for c in records.columns if c not in ("entity", "instants")]
    points = records.where("entity IS NOT NULL").select(*own, "entity", F.explode(F.array_distinct(F.array_compact("instants"))).alias("_t"))
    held = as_of(points, ranges.withColumn("_tie", F.lit(0)), ["entity"], "_t", "low", "high", "_tie", "inner", own, ["runs"])
    return held.select(F.explode(held.columns[-1]).alias("run"), *own).distinct()


def replay(runs: DataFrame, records: DataFrame) -> DataFrame:
    """run and the records' columns of every run of a log that begins with nothing exported; nothing is committed."""
    return assigned(records, windows(successful(runs)))
