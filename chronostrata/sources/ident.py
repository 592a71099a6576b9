"""Table identifiers: catalog.schema.table, parts optional."""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row


@dataclass(frozen=True)
class TableId:
    table: str
    schema: str | None = None
    catalog: str | None = None

    def __post_init__(self) -> None:
        if not self.table:
            raise ValueError("a table needs a name")

    def __str__(self) -> str:
        return ".".join(x for x in (self.catalog, self.schema, self.table) if x is not None)

    def quoted(self) -> str:
        return ".".join("`" + x.replace("`", "``") + "`" for x in (self.catalog, self.schema, self.table) if x is not None)

    @classmethod
    def parse(cls, text: str, store=None, allow_table_only: bool = True) -> TableId:
        """``[catalog.]schema.table``. With a store, a schema that doesn't exist makes the whole text a table of the default
        schema (``allow_table_only``), or is an error."""
        parts = text.split(".")
        if store is None:
            return cls(parts[-1], ".".join(parts[-2:-1]) or None, ".".join(parts[:-2]) or None) if len(parts) <= 3 else cls(parts[-1], ".".join(parts[:-1]))
        if len(parts) == 1:
            return cls(text).qualify(store)
        if len(parts) > 2 and parts[0] == store.catalog and store.schema_exists(".".join(parts[1:-1])):
            return cls(parts[-1], ".".join(parts[1:-1]), store.catalog)
        schema = ".".join(parts[:-1])
        if store.schema_exists(schema):
            return cls(parts[-1], schema, store.catalog)
        if not allow_table_only:
            raise LookupError(f"schema {schema!r} doesn't exist")
        return cls(text).qualify(store)

    def qualify(self, store) -> TableId:
        return TableId(self.table, self.schema or store.schema, self.catalog or store.catalog)

    @classmethod
    def from_row(cls, row: Row | dict | DataFrame) -> TableId:
        """From one row with table and, if it has them, schema and catalog."""
        if isinstance(row, DataFrame):
            rows = row.limit(2).collect()
            if len(rows) != 1:
                raise ValueError("exactly one row names a table")
            row = rows[0]
        d = row.asDict() if isinstance(row, Row) else dict(row)
        return cls(d["table"], d.get("schema"), d.get("catalog"))


def unique_table_name(scope: str = "chronostrata") -> str:
    return f"{scope}_{''.join(random.choices(string.ascii_letters + string.digits, k=10))}"
