"""Session helpers shared by all operators: UTC, the shared folder, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when it has at most this many rows (checked by ``bounded_broadcast``).
BROADCAST_ROWS = 10_000


def pin_utc(spark: SparkSession) -> SparkSession:
    """All instants are UTC; zone-less timestamps are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. It is ``spark.checkpoint.dir``; only where that is unset and the master is
    this machine (tests) is one made here, because a machine-local folder on a cluster would lose data."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = sc._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronostrata-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, scope: str) -> str:
    """A fresh path below the shared folder, in this application's part of it."""
    return f"{_own_dir(spark)}/{scope}-{uuid.uuid4().hex[:12]}"


def clean(spark: SparkSession) -> bool:
    """Deletes what ``scratch`` and ``placed`` left in this application. Call it when no result is read any more; Spark itself
    deletes checkpoints if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder. Partitions keep their index and row order, and an executor's loss costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def placed(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Written in the shared folder in ``width`` buckets by the keys, and read again: columnar, and known to Spark as lying
    together by the keys, so that groupings and joins by them (and more) don't shuffle. The catalog's entry, which only
    serves to tell Spark of the buckets, goes at once; the files stay like those of ``cut``."""
    spark, name = df.sparkSession, f"placed_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", scratch(spark, "placed")).bucketBy(width, *keys).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python workers can run its functions
    wherever it is installed. Call it before making a Python function."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    file = Path(tempfile.mkdtemp(prefix="chronostrata-"), "chronostrata.zip")  # Spark's driver serves it from there
    with zipfile.ZipFile(file, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    spark.sparkContext.addPyFile(str(file))
    _shipped.add(app)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast`` if the size has been checked, otherwise the plain frame: Catalyst then plans a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def beside(small: DataFrame) -> DataFrame:
    """A narrow table as the right side of a join whose left side is large and lies in place: it goes to where the left side
    lies, and is looked up there without a sort. Spark alone might send the left side around instead."""
    return small.hint("shuffle_hash")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def micros(col: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (the session runs in UTC)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(col.cast("timestamp"))


def utc_text(us: Column | str) -> Column:
    """Microseconds since 1970 as ``YYYY-MM-DDTHH:MM:SS.ffffffZ``; null stays null."""
    us = F.col(us) if isinstance(us, str) else us
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def field_names(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields]


def fresh_name(wanted: str, taken: list[str]) -> str:
    """A column name that clashes with none of ``taken`` (Spark compares names without regard to case)."""
    low = {t.lower() for t in taken}
    name, k = wanted, 0
    while name.lower() in low:
        k += 1
        name = f"{wanted}_{k}"
    return name
