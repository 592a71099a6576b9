"""A history kept up by Merkle comparison, one snapshot at a time (problem 2).

The records that hold are stored in leaf buckets by the hash of their key; the manifest has the hash of every leaf.
A new snapshot is hashed by leaf in one pre-aggregated pass. From the root down, only nodes whose hashes differ are
descended, and only the leaf buckets found so are read, compared by record, and replaced; what ended is appended to
the closed versions. A snapshot that changes a few buckets costs one hashing pass and those buckets, whatever the size
of the history.

The number of leaves follows the table: when they would hold more than ``leaf_rows`` records the trees become a level
deeper, and a leaf is split when it next differs (see ``buckets``). Hashes are XORs over a node's records, so the hash of
a node is known from its leaves at any depth. The driver compares one hash for each leaf, never one for each record.

Defined results: of repeated keys in a snapshot the greatest payload counts; rows with a null in the key don't count;
an empty snapshot ends every version; a snapshot equal to the last one changes nothing; earlier snapshots than the
last are refused (``engine.update_snapshot`` takes them).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronostrata.functions.timestamps import Timestamp, db_timestamp, to_ts
from chronostrata.operators.buckets import covering, grown, residue, split, spread
from chronostrata.operators.snapshots import payload_hashes
from chronostrata.session import cut, fresh_name
from chronostrata.sources.manifest import Manifests


Hash = tuple[int, int, int]
NOTHING: Hash = (0, 0, 0)


class HashTree:
    """Nodes (m, r) are the records whose hash leaves r when divided by m, a power of ``fanout``; a node's hash is the XOR of
    two hashes of each record, and their number. ``leaves`` may lie at different depths."""

    def __init__(self, leaves: dict[tuple[int, int], Hash], fanout: int):
        self.fanout, self.leaves, self.nodes = fanout, leaves, {}
        for (m, r), (a, b, n) in leaves.items():
            while m >= 1:
                x, y, k = self.nodes.get((m, r % m), NOTHING)
                self.nodes[m, r % m] = (x ^ a, y ^ b, k + n)
                m //= fanout

    def differing(self, old: HashTree, modulus: int) -> tuple[list[int], int]:
        """The residues of ``modulus``, this tree's depth, below which the trees differ, and how many nodes were looked at to
        find them. A leaf of the old tree is found as a whole, even where this tree is deeper."""
        found, seen, todo = [], 0, [(1, 0)]
        while todo:
            m, r = todo.pop()
            seen += 1
            if self.nodes.get((m, r), NOTHING) == old.nodes.get((m, r), NOTHING):
                continue
            if m == modulus or (m, r) in old.leaves:
                found += range(r, modulus, m)
            else:
                todo += [(m * self.fanout, r + k * m) for k in range(self.fanout)]
        return sorted(found), seen


class MerkleHistory:
    """The history at ``root`` of snapshots with the columns of ``schema``, recognised by ``key``. The trees begin with
    ``fanout ** depth`` leaves."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: list[str], fanout: int = 16, depth: int = 1, leaf_rows: int = 1_000_000):
        self.spark, self.root, self.schema, self.key = spark, root, schema, key
        self.manifests, self.leaf_rows = Manifests(spark, root), leaf_rows
        known = self.manifests.read()
        self.fanout, self.first = known["fanout"] if known else fanout, fanout**depth
        self.columns = [f.name for f in schema.fields]
        self.payload = [c for c in self.columns if c not in key]
        self.leaf, self.since, self.until = (fresh_name(n, self.columns) for n in ("leaf", "from_ts", "until_ts"))
        stamp = T.StructField(self.since, T.TimestampNTZType())
        self.held_schema = T.StructType([*schema.fields, stamp])
        self.closed_schema = T.StructType([*schema.fields, stamp, T.StructField(self.until, T.TimestampNTZType())])

    def _hash(self) -> Column:
        return F.xxhash64(*[F.col(f"`{k}`") for k in self.key])

    def _files(self, manifest: dict | None, only: set[str] | None = None) -> list[str]:
        return [f"{self.root}/data/v{v}/held/{self.leaf}={split(k)[1]}" for k, v in (manifest or {"held": {}})["held"].items() if only is None or k in only]

    def _load(self, paths: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _reduced(self, snapshot: DataFrame) -> DataFrame:
        rows = snapshot.select(*[f"`{c}`" for c in self.columns]).where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.key))
        if self.payload:
            best = F.max(F.struct(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(self.payload)])).alias("_best")
            rows = rows.groupBy(*[F.col(f"`{k}`").alias(k) for k in self.key]).agg(best).select(*self.key, *[F.col(f"_best.p{i}").alias(c) for i, c in enumerate(self.payload)])
        else:
            rows = rows.distinct()
        return rows

    def _leaves(self, rows: DataFrame, modulus: int) -> dict[tuple[int, int], Hash]:
        """One row for each leaf."""
        a, b = (fresh_name(n, [*self.columns, self.leaf]) for n in ("h1", "h2"))
        hashed = rows.select(residue(self._hash(), modulus).alias(self.leaf), *[h.alias(n) for h, n in zip(payload_hashes([*self.key, *self.payload]), (a, b), strict=True)])
        return {(modulus, r[0]): (r[1], r[2], r[3]) for r in hashed.groupBy(self.leaf).agg(F.bit_xor(a), F.bit_xor(b), F.count(F.lit(1))).collect()}

    def apply(self, snapshot: DataFrame, timestamp: Timestamp) -> dict[str, int]:
        """Appends what changed and commits; the numbers of nodes looked at and of leaves replaced."""
        manifest = self.manifests.read()
        t = to_ts(timestamp)
        if manifest and t <= to_ts(manifest["last"]):
            raise ValueError(f"the snapshot of {t} isn't later than the last one, of {manifest['last']}")
        rows = self._reduced(snapshot)
        before = HashTree({split(k): tuple(h) for k, h in (manifest["leaves"] if manifest else {}).items()}, self.fanout)
        modulus = manifest["modulus"] if manifest else self.first
        leaves = self._leaves(rows, modulus)
        if (more := grown(modulus, self.fanout, sum(n for *_, n in leaves.values()), self.leaf_rows)) != modulus:
            modulus, leaves = more, self._leaves(rows, more)
        touched, seen = HashTree(leaves, self.fanout).differing(before, modulus)
        version = (manifest["version"] if manifest else 0) + 1
        held, hashes, closed = (dict(manifest["held"]), dict(manifest["leaves"]), list(manifest["closed"])) if manifest else ({}, {}, [])
        if touched:
            old, _ = covering(hashes, set(touched), modulus)
            there = residue(self._hash(), modulus)
            number = sum(leaves[modulus, k][2] for k in touched if (modulus, k) in leaves) + sum(hashes[k][2] for k in old)
            self._replace(rows.where(there.isin(touched)), self._files(manifest, old), t, version, modulus, len(touched), number)
            new = {f"{modulus}:{k}": leaves[modulus, k] for k in touched if (modulus, k) in leaves}
            held = {k: v for k, v in held.items() if k not in old} | dict.fromkeys(new, version)
            hashes = {k: h for k, h in hashes.items() if k not in old} | {k: list(h) for k, h in new.items()}
            closed.append(version)
        self.manifests.commit(version, {"fanout": self.fanout, "modulus": modulus, "last": str(t), "leaves": hashes, "held": held, "closed": closed})
        return {"nodes": seen, "leaves": len(touched)}

    def _replace(self, rows: DataFrame, files: list[str], t, version: int, modulus: int, leaves: int, number: int) -> None:
        old = self._load(files, self.held_schema)
        pack = lambda df, name: df.select(*[F.col(f"`{k}`").alias(f"{name}{i}") for i, k in enumerate(self.key)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
        a, b = pack(old, "o"), pack(rows, "n")
        both = a.join(b, reduce(lambda p, q: p & q, [F.col(f"o{i}") == F.col(f"n{i}") for i in range(len(self.key))]), "full")
        same = reduce(lambda p, q: p & q, [F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`")) for c in self.payload], F.col("o").isNotNull() & F.col("n").isNotNull())
        both = cut(both.withColumn("same", same).select("o", "n", "same"))
        stays = both.where("n IS NOT NULL").select(*[F.col(f"n.`{c}`").alias(c) for c in self.columns], F.when(F.col("same"), F.col(f"o.`{self.since}`")).otherwise(db_timestamp(t)).alias(self.since))
        ended = both.where("o IS NOT NULL AND NOT same").select(*[F.col(f"o.`{c}`").alias(c) for c in [*self.columns, self.since]], db_timestamp(t).alias(self.until))
        part, tasks = spread(self._hash(), number, leaves)
        stays.withColumn(self.leaf, residue(self._hash(), modulus)).repartition(tasks, self.leaf, part).write.mode("overwrite").partitionBy(self.leaf).parquet(f"{self.root}/data/v{version}/held")
        ended.write.mode("overwrite").parquet(f"{self.root}/data/v{version}/closed")

    def read(self) -> DataFrame:
        """All versions: the snapshot's columns, from_ts and until_ts (null while they hold)."""
        manifest = self.manifests.read()
        held = self._load(self._files(manifest), self.held_schema).withColumn(self.until, db_timestamp(None))
        return held.unionByName(self._load([f"{self.root}/data/v{v}/closed" for v in (manifest or {"closed": []})["closed"]], self.closed_schema))
