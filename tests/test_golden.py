"""Literal cases for each dialect: an expression, and its value as text."""

from pathlib import Path

import pytest

import tributary

from tributary.plans.engine import Engine, to_spark_sql
from tributary.plans.lexer import SqlError

CASES = [line.split("\t") for line in (Path(tributary.__file__).parent / "cases.tsv").read_text(encoding="utf-8").splitlines() if line]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


@pytest.mark.parametrize("dialect", ["any", "bigquery", "redshift", "snowflake", "databricks"])
def test_expressions(engine, dialect):
    wrong = []
    for _, expression, want in (c for c in CASES if c[0] == dialect):
        got = str(engine.sql(f"SELECT {expression}", dialect).collect()[0][0])
        if got != want:
            wrong.append((expression, want, got))
    assert not wrong


def test_time_keys_and_modes(engine):
    row = engine.sql("SELECT CURRENT_DATE, CURRENT_TIMESTAMP()", "bigquery", {"CURRENT_DATE": "2024-02-03", "CURRENT_TIMESTAMP": "2024-02-03 04:05:06"}).collect()[0]
    assert [str(x) for x in row] == ["2024-02-03", "2024-02-03 04:05:06"]
    assert "get_json_object" in to_spark_sql("SELECT v:a.b FROM t", "snowflake", {"VARIANT_MODE": "JSON"})
    assert "get_json_object" not in to_spark_sql("SELECT v:a.b FROM t", "snowflake")


@pytest.mark.parametrize("sql", ["SELECT", "SELECT 1 FROM", "SELECT (1", "SELECT 'a", "FROM t |> NOPE 1", "SELECT APPENDS(1)"])
def test_errors(sql):
    with pytest.raises(SqlError):
        to_spark_sql(sql, "bigquery")


def test_script(engine):
    found = engine.run_script(
        "CREATE TEMP VIEW s AS SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS v(id, x); UPDATE s SET x = 'z' WHERE id = 2; INSERT INTO s VALUES (3, 'c'); DELETE FROM s WHERE id = 1; SELECT * FROM s ORDER BY id"
    )
    assert [tuple(r) for r in found[-1].collect()] == [(2, "z"), (3, "c")]
