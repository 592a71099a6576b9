"""Applying a change feed of inserts, updates and deletes (problem 6).

Method: bucketed copy-on-write. The base is hashed by key into buckets; changes are reduced to one row per key before
anything moves, routed to their buckets, and merged by one sort with the base rows of those buckets only. Replacement
files are written beside the old ones and one manifest commit switches the touched buckets over; untouched buckets keep
their files.

The number of buckets follows the table: when they would hold more than ``bucket_rows`` rows the modulus doubles, and a
bucket is split when it is next touched (see ``buckets``). A bucket is written by as many tasks as its rows ask for.

Defined results. Of all changes of a key, in whatever order and however often they come, the one with the greatest
``order`` counts, at equal orders a delete, then the greatest payload. Deletes stay in the base as tombstones, so a
late insert can't bring a key back. Changes with a null in key or order don't count. Applying a batch twice changes
nothing. An empty feed commits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronostrata.operators.buckets import covering, grown, residue, split, spread
from chronostrata.session import cut, fresh_name
from chronostrata.sources.manifest import Manifests


class BucketedTable:
    """A table at ``root`` with columns key, ``order``, ``deleted`` (boolean) and the payload of ``schema``. ``buckets`` is the
    number that it begins with."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: list[str], order: str, deleted: str, buckets: int = 8, bucket_rows: int = 4_000_000):
        self.spark, self.root, self.schema, self.key, self.order, self.deleted = spark, root, schema, key, order, deleted
        self.manifests, self.first, self.bucket_rows = Manifests(spark, root), buckets, bucket_rows
        self.columns = [f.name for f in schema.fields]
        self.bucket = fresh_name("bucket", self.columns)

    @property
    def buckets(self) -> int:
        found = self.manifests.read()
        return found["modulus"] if found else self.first

    def _hash(self) -> Column:
        return F.xxhash64(*[F.col(f"`{k}`") for k in self.key])

    def _rank(self) -> list:
        payload = [c for c in self.columns if c not in (*self.key, self.order, self.deleted)]
        return [F.col(f"`{c}`") for c in (self.order, self.deleted, *payload)]

    def _reduced(self, changes: DataFrame) -> DataFrame:
        """One row per key, pre-aggregated on the map side so that a hot key costs one row a task."""
        complete = changes.select([f"`{c}`" for c in self.columns]).where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*self.key, self.order)))
        complete = complete.withColumn(self.deleted, F.coalesce(F.col(f"`{self.deleted}`"), F.lit(False)))
        best = fresh_name("best", self.columns)
        rank = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(self._rank())])
        rows = complete.groupBy(*[f"`{k}`" for k in self.key]).agg(F.max(rank).alias(best))
        names = [self.order, self.deleted, *[c for c in self.columns if c not in (*self.key, self.order, self.deleted)]]
        return rows.select(*[f"`{k}`" for k in self.key], *[F.col(f"{best}.r{i}").alias(n) for i, n in enumerate(names)])

    def _files(self, manifest: dict | None, only: set[str] | None = None) -> list[str]:
        at = manifest["at"] if manifest else {}
        return [f"{self.root}/data/v{e['v']}/{self.bucket}={split(k)[1]}" for k, e in at.items() if only is None or k in only]

    def _read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def apply(self, changes: DataFrame) -> int | None:
        """Merges the changes and commits; the new version, None if there was nothing to apply."""
        manifest = self.manifests.read()
        version, at = (manifest["version"] if manifest else 0) + 1, manifest["at"] if manifest else {}
        routed = cut(self._reduced(changes))
        news = routed.count()
        if not news:
            return None
        modulus = grown(manifest["modulus"] if manifest else self.first, 2, sum(e["rows"] for e in at.values()) + news, self.bucket_rows)
        touched = {r[0] for r in routed.select(residue(self._hash(), modulus)).distinct().collect()}  # at most one row a bucket
        old, touched = covering(at, touched, modulus)
        sub, mark = (fresh_name(n, [*self.columns, self.bucket]) for n in ("sub", "n"))
        part, tasks = spread(self._hash(), sum(at[k]["rows"] for k in old) + news, len(touched))
        rows = self._read(self._files(manifest, old)).unionByName(routed).withColumns({self.bucket: residue(self._hash(), modulus), sub: part})
        first = Window.partitionBy(self.bucket, sub, *[f"`{k}`" for k in self.key]).orderBy(*[c.desc_nulls_last() for c in self._rank()])
        merged = rows.repartition(tasks, self.bucket, sub).withColumn(mark, F.row_number().over(first)).where(F.col(mark) == 1).drop(mark, sub)
        path = f"{self.root}/data/v{version}"
        merged.write.mode("overwrite").partitionBy(self.bucket).parquet(path)
        kind = T.StructType([*self.schema.fields, T.StructField(self.bucket, T.IntegerType())])
        sizes = self.spark.read.schema(kind).parquet(path).groupBy(self.bucket).count().collect()
        entries = {k: e for k, e in at.items() if k not in old} | {f"{modulus}:{b}": {"v": version, "rows": n} for b, n in sizes}
        self.manifests.commit(version, {"modulus": modulus, "at": entries})
        return version

    def read(self, version: int | None = None, tombstones: bool = False) -> DataFrame:
        """The state after a version (default: the newest), without deleted keys unless asked for."""
        rows = self._read(self._files(self.manifests.read(version)))
        return rows if tombstones else rows.where(~F.col(f"`{self.deleted}`"))

    def vacuum(self) -> None:
        """Deletes the files that the newest manifest doesn't mention."""
        manifest = self.manifests.read()
        kept = {(f"v{e['v']}", f"{self.bucket}={split(k)[1]}") for k, e in manifest["at"].items()} if manifest else set()
        for v in self.manifests.children("data"):
            for b in self.manifests.children(f"data/{v}"):
                if "=" in b and (v, b) not in kept:
                    self.manifests.delete(f"data/{v}/{b}")
