"""Other places that tables come from and go to: JDBC databases and files. Each gives or takes a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_URLS = {"postgresql": "jdbc:postgresql://{host}:{port}/{dbname}", "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={dbname}", "sqlite": "jdbc:sqlite:{dbname}", "duckdb": "jdbc:duckdb:{dbname}", "derby": "jdbc:derby:{dbname}"}
_PORTS = {"postgresql": 5432, "sqlserver": 1433}
# Where each kind of database lists its tables and views.
_LISTS = {
    "postgresql": "(SELECT table_schema, table_name FROM information_schema.tables) AS listed",
    "sqlserver": "(SELECT table_schema, table_name FROM information_schema.tables) AS listed",
    "duckdb": "(SELECT table_schema, table_name FROM information_schema.tables) AS listed",
    "sqlite": "(SELECT 'main' AS table_schema, name AS table_name FROM sqlite_master WHERE type IN ('table', 'view')) AS listed",
    "derby": "(SELECT s.schemaname AS table_schema, t.tablename AS table_name FROM sys.systables AS t JOIN sys.sysschemas AS s ON s.schemaid = t.schemaid WHERE t.tabletype <> 'S') AS listed",
}
FILES = ("parquet", "orc", "csv", "json", "text")


def jdbc_url(kind: str, dbname: str, host: str = "localhost", port: int | None = None) -> str:
    if kind not in _URLS:
        raise ValueError(f"unknown kind of database {kind!r}: one of {', '.join(_URLS)}, or give a url")
    if port is not None and not 0 < port < 65_536:
        raise ValueError(f"not a port: {port}")
    return _URLS[kind].format(host=host, port=port or _PORTS.get(kind), dbname=dbname)


def _reader(spark: SparkSession, url: str, table: str, properties: dict[str, str]):
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)


def can_connect(spark: SparkSession, url: str, **properties: str) -> bool:
    """Whether the database answers: its driver is there, and it lets us in."""
    kind = url.split(":")[1]
    try:
        _reader(spark, url, _LISTS.get(kind, "(SELECT 1 AS one) AS t"), properties).load()
    except Exception:
        return False
    return True


def jdbc_tables(spark: SparkSession, url: str, pattern: str | None = None, **properties: str) -> DataFrame:
    """(schema, table) of a database's tables and views whose ``schema.table`` the pattern is found in."""
    kind = url.split(":")[1]
    if kind not in _LISTS:
        raise ValueError(f"unknown kind of database {kind!r}: one of {', '.join(_LISTS)}")
    rows = _reader(spark, url, _LISTS[kind], properties).load().toDF("schema", "table")
    return rows if pattern is None else rows.where(F.concat_ws(".", "schema", "table").rlike(pattern))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **properties: str) -> DataFrame:
    """A table or ``(select ...) AS name`` of a database; read in parallel over ranges of a numeric column if one is named, from
    its least to its greatest value unless bounds are given. The driver's jar must be on the class path."""
    reader = _reader(spark, url, table, properties)
    if column is not None:
        if bounds is None:
            named = next(c for c in reader.load().columns if c.lower() == column.lower()).replace('"', '""')
            bounds = tuple(_reader(spark, url, f'(SELECT min("{named}") AS lo, max("{named}") AS hi FROM {table}) AS bounds', properties).load().first())
            if bounds[0] is None:
                return reader.load()
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch_rows: int = 10_000, **properties: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch_rows).options(**properties).mode(mode).save()


def read_files(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    if kind not in FILES:
        raise ValueError(f"unknown kind of file {kind!r}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_files(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", by: list[str] | None = None, **options: str) -> None:
    if kind not in FILES:
        raise ValueError(f"unknown kind of file {kind!r}")
    writer = df.write.format(kind).options(**options).mode(mode)
    (writer.partitionBy(*by) if by else writer).save(path)
