"""The engine: dialect SQL in, DataFrames out."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions import geo, text
from . import tree as t
from .emit import Emitter
from .lexer import SqlError
from .parser import parse, parse_script


#: A session setting that tells that the functions are there.
REGISTERED = "spark.tributary.registered"


def to_spark_sql(sql: str, dialect: str = "any", params: dict[str, str] | None = None) -> str:
    """The Spark SQL of one query in a dialect. `params`: time keys (CURRENT_DATE ..), GEO_MODE, VARIANT_MODE."""
    return Emitter(dialect, params).query(parse(sql, dialect))


class Engine:
    """Runs SQL of several warehouses on a Spark session.

    The session zone is set to UTC and the TIME type is switched on; everything else is the session's own.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.timeType.enabled", "true")
        if spark.conf.get(REGISTERED, "") != spark.sparkContext.applicationId:
            text.register(spark)
            geo.register(spark)
            spark.conf.set(REGISTERED, spark.sparkContext.applicationId)

    def sql(self, sql: str, dialect: str = "any", params: dict[str, str] | None = None) -> DataFrame:
        """One query, or a DML statement, whose result is the new state of its table."""
        statement = parse(sql, dialect)
        if isinstance(statement, (t.Insert, t.Update, t.Delete, t.Merge)):
            from ..operators.dml import apply

            return apply(self, statement, dialect, params)
        return self.spark.sql(Emitter(dialect, params).query(statement))

    def run_script(self, sql: str, dialect: str = "any", params: dict[str, str] | None = None) -> list[DataFrame]:
        """All statements of a script, in order. DML replaces the temporary view of its table."""
        found = []
        for statement in parse_script(sql, dialect):
            if isinstance(statement, (t.Insert, t.Update, t.Delete, t.Merge)):
                from ..operators.dml import apply

                frame = apply(self, statement, dialect, params)
                frame.createOrReplaceTempView(statement.table.parts[-1])
                found.append(frame)
            elif isinstance(statement, t.Other):
                found.append(self.other(statement, dialect, params))
            else:
                found.append(self.spark.sql(Emitter(dialect, params).query(statement)))
        return found

    def other(self, statement: t.Other, dialect: str, params: dict[str, str] | None) -> DataFrame:
        """CREATE [TEMP] VIEW or TABLE .. AS makes a temporary view; DROP takes one away."""
        words = [w.upper() for w in statement.words if isinstance(w, str)]
        table = next((w for w in statement.words if isinstance(w, t.Table)), None)
        if words[0] == "CREATE" and statement.query is not None and table is not None:
            frame = self.spark.sql(Emitter(dialect, params).query(statement.query))
            frame.createOrReplaceTempView(table.parts[-1])
            return frame
        if words[0] == "DROP" and table is not None:
            self.spark.catalog.dropTempView(table.parts[-1])
            return self.spark.createDataFrame([], "dropped string")
        raise SqlError(f"can't run {' '.join(words)}")

    def run_file(self, path: str, dialect: str = "any", params: dict[str, str] | None = None) -> list[DataFrame]:
        return self.run_script(Path(path).read_text(encoding="utf-8"), dialect, params)

    def register_tables(self, folder: str, names: list[str]) -> None:
        """Temporary views over the Parquet tables of a folder."""
        for name in names:
            self.spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
