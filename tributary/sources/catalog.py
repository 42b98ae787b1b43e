"""Declared schemas: catalog, schema, table, columns, all without regard to case."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType


class NotFound(LookupError):
    """A name that the catalog doesn't have. `name` tells which."""

    def __init__(self, kind: str, name: str):
        super().__init__(f"{kind} {name} not found")
        self.kind, self.name = kind, name


class TableNotFound(NotFound):
    def __init__(self, name: str):
        super().__init__("table", name)


class ColumnNotFound(NotFound):
    def __init__(self, name: str):
        super().__init__("column", name)


@dataclass
class Table:
    """A table's qualified name and its columns with their types ('' where untyped)."""

    path: list[str]
    columns: dict[str, str] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return ".".join(self.path)


class Catalog:
    """Tables by name. A shorter name is completed by the current catalog and schema."""

    def __init__(self, tables: dict[str, dict[str, str] | list[str]] | None = None, catalog: str = "", schema: str = ""):
        self.catalog, self.schema = catalog, schema
        self.tables: dict[tuple[str, ...], Table] = {}
        self.synonyms: dict[tuple[str, ...], str] = {}
        for name, columns in (tables or {}).items():
            self.add(name, columns)

    @classmethod
    def of_rows(cls, rows: list[list[str]], **current) -> Catalog:
        """From rows of a table's name followed by its columns' names."""
        return cls({row[0]: row[1:] for row in rows}, **current)

    @classmethod
    def of_session(cls, spark: SparkSession, database: str | None = None) -> Catalog:
        """From the tables and views that a session knows."""
        found = cls()
        for table in spark.catalog.listTables(database) if database else spark.catalog.listTables():
            name = table.name if table.isTemporary or not table.namespace else f"{table.namespace[-1]}.{table.name}"
            found.add(name, {c.name: c.dataType for c in spark.catalog.listColumns(name)})
        return found

    @staticmethod
    def key(path: list[str]) -> tuple[str, ...]:
        return tuple(p.lower() for p in path)

    def full(self, path: list[str]) -> list[str]:
        """The name with the current catalog and schema put before it where it lacks them."""
        lacking = [x for x in (self.catalog, self.schema) if x]
        return [*lacking[: max(0, len(lacking) + 1 - len(path))], *path] if len(path) <= len(lacking) else list(path)

    def add(self, name: str, columns: dict[str, str] | list[str] | StructType) -> None:
        """Adds or replaces a table; a repeated column name gets _1, _2 .. behind it."""
        pairs = [(f.name, f.dataType.simpleString()) for f in columns] if isinstance(columns, StructType) else list(columns.items()) if isinstance(columns, dict) else [(c, "") for c in columns]
        told: dict[str, str] = {}
        for column, kind in pairs:
            name_, k = column, 0
            while any(name_.lower() == x.lower() for x in told):
                k += 1
                name_ = f"{column}_{k}"
            told[name_] = kind
        path = self.full(name.split("."))
        self.tables[self.key(path)] = Table(path, told)

    def drop(self, name: str) -> None:
        self.tables.pop(self.key(self.full(name.split("."))), None)

    def add_synonym(self, name: str, table: str) -> None:
        self.synonyms[self.key(name.split("."))] = table

    def drop_synonym(self, name: str) -> None:
        self.synonyms.pop(self.key(name.split(".")), None)

    def find(self, path: list[str]) -> Table:
        """The table of a name: itself, completed, or the only one that ends so."""
        path = self.synonyms.get(self.key(path), ".".join(path)).split(".")
        for wanted in (path, self.full(path)):
            if (found := self.tables.get(self.key(wanted))) is not None:
                return found
        ends = [t for k, t in self.tables.items() if k[-len(path) :] == self.key(path)]
        if len(ends) == 1 and not (self.schema and len(path) == 1 and len(ends[0].path) > 1):
            return ends[0]
        raise TableNotFound(".".join(path))

    def to_json(self) -> str:
        return json.dumps({"catalog": self.catalog, "schema": self.schema, "tables": {t.name: t.columns for t in self.tables.values()}, "synonyms": {".".join(k): v for k, v in self.synonyms.items()}})

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        told = json.loads(text)
        found = cls(catalog=told.get("catalog", ""), schema=told.get("schema", ""))
        for name, columns in told["tables"].items():
            found.tables[cls.key(name.split("."))] = Table(name.split("."), dict(columns))
        found.synonyms = {tuple(k.split(".")): v for k, v in told.get("synonyms", {}).items()}
        return found
