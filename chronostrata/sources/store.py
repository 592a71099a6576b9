"""Versioned tables in a shared folder, and their catalog.

``<root>/<schema>/<table>/`` holds numbered manifests and data parts. A part is written once and never changed; a
commit names the parts of the new version (see ``manifest``). Of historical tables, rows that still hold lie in parts
of their own: a read of the present opens only those, and an update in order rewrites only those and appends what it
closed, so its cost follows the open rows and not the history.
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronostrata.functions.timestamps import Timestamp, to_ts
from chronostrata.operators.history import empty_history, slice_time
from chronostrata.operators.keys import META, is_historical
from chronostrata.session import pin_utc, shared_dir
from chronostrata.sources.ident import TableId, unique_table_name
from chronostrata.sources.manifest import Manifests

#: Slice that reads what holds now; None reads the full history.
LATEST = object()
THIS = object()
_OPEN, _ID = "_open", "_chronostrata_id"
#: Closed parts that are merged into one.
TIER = 16


def named(data: DataFrame, t: TableId) -> DataFrame:
    """The frame, which knows its identifier from now on; frames that are made of it don't."""
    setattr(data, _ID, t)
    return data


@dataclass(frozen=True)
class Part:
    path: str
    is_open: bool | None  # None: not a historical table


class Store:
    """The tables below ``root``. ``catalog`` and ``schema`` are the defaults of identifiers. Of each table the last ``keep``
    versions stay, and older ones for ``retain`` seconds, so that nothing is deleted under a reader that began in that
    time."""

    def __init__(self, spark: SparkSession, root: str | None = None, schema: str = "main", catalog: str = "chronostrata", keep: int = 5, retain: float = 86_400):
        self.spark, self.root = pin_utc(spark), (root or f"{shared_dir(spark)}/tables").rstrip("/")
        self.schema, self.catalog, self.keep, self.retain = schema, catalog, keep, retain
        self.files = Manifests(spark, self.root)
        self.valid = True

    # -- catalog ------------------------------------------------------------------------------------------------

    def get_catalog(self, of: Any = THIS, temporary: bool = False) -> str | None:
        """The default catalog, or that of an identifier, of a table that was read here, or None of None."""
        return self._part(of, self.catalog, temporary, "catalog")

    def get_schema(self, of: Any = THIS, temporary: bool = False) -> str | None:
        """The default schema, or that of an identifier, of a table that was read here, or None of None; temporary tables have
        none."""
        return self._part(of, self.schema, temporary, "schema")

    def _part(self, of: Any, default: str, temporary: bool, part: str) -> str | None:
        if of is None or temporary:
            return None
        return default if of is THIS or of is self else getattr(of if isinstance(of, TableId) else self.id(of), part)

    def create_schema(self, schema: str) -> None:
        self.files._fs.mkdirs(self.files._path(f"{self.root}/{schema}"))

    def schema_exists(self, schema: str) -> bool:
        return schema == self.schema or (not schema.startswith("_") and self.files.exists(schema))

    def id(self, name: str | TableId | DataFrame, allow_table_only: bool = True) -> TableId:
        """Of an identifier, a text, one row that names a table, or a table that was read here and not changed since."""
        if isinstance(name, TableId):
            return name.qualify(self)
        if isinstance(name, DataFrame):
            if (known := getattr(name, _ID, None)) is not None:
                return known
            if "table" not in name.columns:
                raise ValueError("this table doesn't know its name: it is derived from others, or wasn't read from a store")
            return TableId.from_row(name).qualify(self)
        if not isinstance(name, str):
            raise TypeError(f"a table is named by a text, an identifier or a table, not by {type(name).__name__}")
        return TableId.parse(name, self, allow_table_only)

    def _listed(self, show_temporary: bool = True) -> list[TableId]:
        found = []
        for schema in self.files.children(""):
            if not schema.startswith("_"):
                found += [TableId(t, schema, self.catalog) for t in self.files.children(schema) if self.files.exists(f"{schema}/{t}/_manifests")]
        if show_temporary:
            found += [TableId(t.name) for t in self.spark.catalog.listTables() if t.isTemporary]
        return found

    def get_tables(self, pattern: str | None = None, show_temporary: bool = True) -> DataFrame:
        """(catalog, schema, table) of the tables whose ``[catalog.]schema.table`` the pattern is found in."""
        seen = lambda t: pattern is None or re.search(pattern, str(t)) or re.search(pattern, ".".join(x for x in (t.schema, t.table) if x))
        rows = [(t.catalog, t.schema, t.table) for t in self._listed(show_temporary) if seen(t)]
        return self.spark.createDataFrame(rows, "catalog string, schema string, table string")

    def table_exists(self, name: str | TableId | DataFrame) -> bool:
        """Whether exactly one table has the name; a text that fits several is an error, and so is anything that names no table."""
        if not isinstance(name, str):
            name = self.id(name) if not isinstance(name, TableId) else name
        if isinstance(name, TableId):
            return name.qualify(self) in self._listed() or (name.schema is None and TableId(name.table) in self._listed())
        fits = [t for t in self._listed() if name in (f"{t.schema}.{t.table}" if t.schema else t.table, str(t)) or (t.schema == self.schema and t.table == name)]
        if len(fits) > 1:
            raise LookupError(f"More than one table matching {name!r} was found: {', '.join(x.quoted() for x in fits)}")
        return bool(fits)

    # -- versions -----------------------------------------------------------------------------------------------

    def manifests(self, name: str | TableId) -> Manifests:
        t = self.id(name)
        return Manifests(self.spark, f"{self.root}/{t.schema}/{t.table}")

    def state(self, name: str | TableId, version: int | None = None) -> dict[str, Any]:
        found = self.manifests(name).read(version)
        if found is None:
            raise LookupError(f"table {self.id(name)} doesn't exist")
        return found

    def read(self, name: str | TableId, only_open: bool = False, version: int | None = None) -> DataFrame:
        at, m = self.manifests(name).root, self.state(name, version)
        schema = T.StructType.fromJson(m["schema"])
        paths = [f"{at}/{p['path']}" for p in m["parts"] if not only_open or p["is_open"] in (True, None)]
        data = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return named(data, self.id(name))

    def commit(self, name: str | TableId, data: DataFrame | None, keep: list[dict] | None = None, **facts: Any) -> int:
        """Writes ``data`` as new parts, beside the ``keep`` parts of the version before, and makes the version visible."""
        manifests = self.manifests(name)
        before = manifests.read()
        version = (before["version"] if before else 0) + 1
        parts = list(keep or [])
        schema = before["schema"] if before else data.schema.jsonValue()
        if data is not None:
            data = data.select([f"`{f['name']}`" for f in schema["fields"]])
            out = f"data/v{version}"
            if all(c in data.columns for c in META):
                data.withColumn(_OPEN, F.col("until_ts").isNull()).write.mode("overwrite").partitionBy(_OPEN).parquet(f"{manifests.root}/{out}")
                parts += [{"path": f"{out}/{d}", "is_open": d.endswith("true")} for d in manifests.children(out) if d.startswith(_OPEN)]
            else:
                data.write.mode("overwrite").parquet(f"{manifests.root}/{out}")
                parts.append({"path": out, "is_open": None})
        manifests.commit(version, {k: v for k, v in (before or {}).items() if k != "version"} | {"schema": schema, "parts": parts} | facts)
        self._retire(manifests)
        return version

    def _retire(self, manifests: Manifests) -> None:
        """Deletes versions beyond the last ``keep`` that are older than ``retain``, and the parts that no other version names."""
        versions = manifests.versions()
        old = [v for v in versions[: -self.keep] if manifests.age(v) >= self.retain]
        if not old:
            return
        used = {p["path"] for v in versions if v not in set(old) for p in manifests.read(v)["parts"]}
        for p in {p["path"] for v in old for p in manifests.read(v)["parts"]} - used:
            manifests.delete(f"{p}")
        for v in old:
            manifests.delete(f"_manifests/{v}.json")

    def tidy(self, name: str | TableId) -> int | None:
        """Merges closed parts of a historical table where there are many: ``TIER`` parts of one tier become one of the next. So
        a row is rewritten as often as the logarithm of the number of updates. The new version, None if there was nothing
        to merge."""
        manifests, state = self.manifests(name), self.state(name)
        tiers: dict[int, list[dict]] = {}
        for p in state["parts"]:
            if p["is_open"] is False:
                tiers.setdefault(p.get("tier", 0), []).append(p)
        full = next((t for t in sorted(tiers) if len(tiers[t]) >= TIER), None)
        if full is None:
            return None
        merged, out = tiers[full], f"data/v{state['version'] + 1}"
        data = self.spark.read.schema(T.StructType.fromJson(state["schema"])).parquet(*[f"{manifests.root}/{p['path']}" for p in merged])
        data.coalesce(max(1, data.rdd.getNumPartitions() // TIER)).write.mode("overwrite").parquet(f"{manifests.root}/{out}")
        rest = [p for p in state["parts"] if p not in merged]
        return self.commit(name, None, keep=[*rest, {"path": out, "is_open": False, "tier": full + 1}])

    def compact(self, name: str | TableId) -> int:
        """Rewrites a table's parts as few, with the same rows."""
        return self.commit(name, self.read(name))

    def drop(self, name: str | TableId) -> None:
        t = self.id(name)
        self.files.delete(f"{t.schema}/{t.table}")

    # -- tables -------------------------------------------------------------------------------------------------

    def create_table(self, data: DataFrame, name: str | TableId, temporary: bool = False) -> DataFrame:
        """An empty historical table for data of this shape; an error if it exists."""
        empty = empty_history(data)
        t = self.id(name)
        if self.table_exists(t):
            raise ValueError(f"Table {t} already exists!")
        if temporary:
            empty.createOrReplaceTempView(t.table)
            return empty
        self.commit(t, empty, registry=[])
        return self.read(t)

    def write_table(self, data: DataFrame, name: str | TableId, append: bool = False) -> DataFrame:
        """A plain table (not a historical one)."""
        t = self.id(name)
        before = self.manifests(t).read()
        self.commit(t, data, keep=before["parts"] if before and append else [])
        return self.read(t)

    def create_index(self, name: str | TableId, columns: list[str]) -> None:
        """Spark keeps no indexes: checks that the columns are unique, and notes them as the table's key."""
        data = self.read(name)
        if repeated := data.groupBy(*columns).count().where("count > 1").limit(1).collect():
            raise ValueError(f"not unique in {self.id(name)}: {repeated[0].asDict()}")
        self.commit(name, None, keep=self.state(name)["parts"], key=columns)

    def get_table(self, name: str | TableId | None = None, slice_ts: Timestamp | None | object = LATEST, include_slice_info: bool = False) -> DataFrame:
        """A table as it is now (``LATEST``), as it was at an instant, or its full history (None); without a name, the list of
        tables. Metadata columns are left out unless asked for, and always part of a full history."""
        if name is None:
            return self.get_tables()
        t = self.id(name)
        if not self.manifests(t).versions():
            if TableId(t.table) in self._listed():
                data = self.spark.table(f"`{t.table}`")
            else:
                raise LookupError(f"table {t} doesn't exist")
        else:
            data = self.read(t, only_open=slice_ts is LATEST)
        if not is_historical(data):
            return named(data, t)
        if slice_ts is LATEST:
            data = data.where("until_ts IS NULL")
        elif slice_ts is not None:
            data = slice_time(data, slice_ts)
        return named(data if include_slice_info or slice_ts is None else data.drop(*META), t)

    def latest_snapshot(self, name: str | TableId):
        """The latest instant that a snapshot or, in tables filled otherwise, any record has; None for an empty table."""
        state = self.state(name)
        if state.get("registry"):
            return max([to_ts(r[0]) for r in state["registry"]] + [to_ts(x) for x in [state.get("high")] if x])
        return self.read(name).agg(F.max(F.greatest("from_ts", F.coalesce("until_ts", "from_ts")))).first()[0]


def table_signature(data: DataFrame) -> dict[str, str]:
    """SQL types by column; the metadata columns have their fixed types wherever they stand."""
    fixed = {"checksum": "string", "from_ts": "timestamp_ntz", "until_ts": "timestamp_ntz"}
    whole = all(c in data.columns for c in fixed)
    return {c: fixed[c] if whole and c in fixed else kind for c, kind in data.dtypes}


@contextmanager
def temporary_view(df: DataFrame, name: str | None = None):
    """A view that goes when the block ends."""
    name = name or unique_table_name()
    df.createOrReplaceTempView(name)
    try:
        yield name
    finally:
        df.sparkSession.catalog.dropTempView(name)


def get_connection(spark: SparkSession | None = None, root: str | None = None, **options: Any) -> Store:
    """A store in a running or new session."""
    return Store(spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), root, **options)


def close_connection(store: Store, stop: bool = False) -> None:
    store.valid = False
    if stop:
        store.spark.stop()
