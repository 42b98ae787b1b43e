"""What a query's result adds to, takes from, or changes in a target table's schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import ArrayType, DataType, StructType

from ..plans.engine import Engine

ADDED, REMOVED, MODIFIED, UNCHANGED = "ADDED", "REMOVED", "MODIFIED", "UNCHANGED"


@dataclass
class Attribute:
    name: str
    type: str
    status: str
    array: bool = False
    nested: list[Attribute] = field(default_factory=list)


def base(kind: DataType) -> tuple[DataType, bool]:
    return (base(kind.elementType)[0], True) if isinstance(kind, ArrayType) else (kind, False)


def told(name: str, kind: DataType, status: str) -> Attribute:
    inner, array = base(kind)
    nested = [told(f.name, f.dataType, status) for f in inner] if isinstance(inner, StructType) else []
    return Attribute(name, "struct" if nested else inner.simpleString(), status, array, nested)


def compare(result: StructType, target: StructType) -> list[Attribute]:
    """By name without regard to case, in the order of the result, then what the target alone has. A struct whose
    fields differ is itself unchanged; its fields tell."""
    known, found = {f.name.lower(): f for f in target}, []
    for f in result:
        old = known.pop(f.name.lower(), None)
        if old is None:
            found.append(told(f.name, f.dataType, ADDED))
            continue
        (new_base, new_array), (old_base, old_array) = base(f.dataType), base(old.dataType)
        if isinstance(new_base, StructType) and isinstance(old_base, StructType) and new_array == old_array:
            found.append(Attribute(f.name, "struct", UNCHANGED, new_array, compare(new_base, old_base)))
        else:
            found.append(told(f.name, f.dataType, UNCHANGED if f.dataType.simpleString() == old.dataType.simpleString() else MODIFIED))
    return found + [told(f.name, f.dataType, REMOVED) for f in known.values()]


def schema_diff(engine: Engine, sql: str, target: StructType, dialect: str = "snowflake", tables: dict[str, StructType] | None = None) -> list[Attribute]:
    """The query is only analysed. `tables` declares schemas of tables that the session doesn't have: they stand in as
    empty views while it is."""
    spark = engine.spark
    for name, schema in (tables or {}).items():
        spark.createDataFrame([], schema).createOrReplaceTempView(name)
    try:
        return compare(engine.sql(sql, dialect).schema, target)
    finally:
        for name in tables or {}:
            spark.catalog.dropTempView(name)
