"""Resolver, lineage, guard, refactoring, schema diff, catalog and DML."""

import json

import pytest
from pyspark.sql.types import StructType

from tributary.operators import diff, refactor, render, resolver
from tributary.plans.engine import Engine
from tributary.plans.lexer import SqlError
from tributary.sources.catalog import Catalog, ColumnNotFound, TableNotFound

CATALOG = Catalog({"a": ["col1", "col2", "col3", "colAA", "colAB"], "b": ["col1", "col2", "col3", "colBA", "colBB"], "sales.orders": {"customer_id": "int", "amount": "double"}})

STARS = [
    ("SELECT * FROM a INNER JOIN b USING (col1)", ["a.col1", "a.col2", "a.col3", "a.colAA", "a.colAB", "b.col2", "b.col3", "b.colBA", "b.colBB"]),
    ("SELECT * FROM a RIGHT JOIN b USING (col1)", ["a.col2", "a.col3", "a.colAA", "a.colAB", "b.col1", "b.col2", "b.col3", "b.colBA", "b.colBB"]),
    ("SELECT * FROM a NATURAL JOIN b", ["a.col1", "a.col2", "a.col3", "a.colAA", "a.colAB", "b.colBA", "b.colBB"]),
    ("SELECT b.* EXCEPT (col1, col2) FROM a, b", ["b.col3", "b.colBA", "b.colBB"]),
    ("SELECT x.* FROM a AS x", ["a.col1", "a.col2", "a.col3", "a.colAA", "a.colAB"]),
]


@pytest.mark.parametrize("sql, want", STARS)
def test_stars(sql, want):
    assert [c.path for c in resolver.resolve(sql, CATALOG)] == want


def test_lineage():
    told = resolver.lineage("WITH c AS (SELECT col1 AS x, colBA + colBB AS s FROM b) SELECT a.col2, s * 2 AS twice, (SELECT MAX(b.col3) FROM b WHERE b.col1 = a.col1) AS m FROM a JOIN c ON a.col1 = c.x", CATALOG)
    assert told == {"col2": {"a.col2"}, "twice": {"b.colBA", "b.colBB"}, "m": {"b.col3"}}
    assert resolver.lineage("FROM a |> AGGREGATE SUM(col2) AS s GROUP BY col1", CATALOG) == {"col1": {"a.col1"}, "s": {"a.col2"}}
    assert resolver.lineage("SELECT col1 FROM a UNION SELECT colBA FROM b", CATALOG) == {"col1": {"a.col1", "b.colBA"}}


def test_columns_by_clause_functions_and_tables():
    sql = "SELECT LOWER(a.col1) AS x, COUNT(*) AS n FROM a JOIN b ON a.col1 = b.col1 WHERE b.col2 > 1 GROUP BY a.col1 HAVING SUM(col3) > 2 ORDER BY MAX(colAA)"
    told = resolver.columns_used(sql, CATALOG)
    assert (told["on"], told["where"], told["group"], told["having"], told["order"]) == ({"a.col1", "b.col1"}, {"b.col2"}, {"a.col1"}, {"a.col3"}, {"a.colAA"})
    assert resolver.functions_used(sql, CATALOG) == {"LOWER", "COUNT", "SUM", "MAX"} and resolver.tables_used(sql, CATALOG) == {"a", "b"}


def test_modes_and_guard():
    with pytest.raises(ColumnNotFound):
        resolver.validate("SELECT nope FROM a", CATALOG)
    with pytest.raises(TableNotFound):
        resolver.validate("DELETE FROM nope WHERE x = 1", CATALOG)
    with pytest.raises(ColumnNotFound):
        resolver.validate("UPDATE a SET col1 = nope", CATALOG)
    resolver.validate("MERGE INTO a USING b ON a.col1 = b.col1 WHEN MATCHED THEN UPDATE SET col2 = b.colBA WHEN NOT MATCHED THEN INSERT (col1) VALUES (b.col1)", CATALOG)
    assert render.to_text(resolver.resolve("SELECT nope FROM a", CATALOG, "lenient")) == "nope : Unknown Not found in schema"
    assert resolver.resolve("SELECT col1, nope FROM a", CATALOG, "ignore")[0].path == "a.col1" and len(resolver.resolve("SELECT col1, nope FROM a", CATALOG, "ignore")) == 1


def test_renderers():
    columns = resolver.resolve("SELECT col1 + col2 AS s FROM a", CATALOG)
    assert json.loads(render.to_json(columns))[0]["children"][1]["name"] == "col2"
    assert 'name="col2"' in render.to_xml(columns) and render.to_map(columns) == {"s": {"a.col1", "a.col2"}}
    assert len(render.to_json(columns, brief=True)) < len(render.to_json(columns)) and "└─ a.col2" in render.to_text(columns)


def test_expanded_text():
    assert resolver.expanded("SELECT * EXCEPT (col1) FROM b", CATALOG) == "SELECT b.col2, b.col3, b.colBA, b.colBB FROM b"


REPLACED = [
    ("WITH b AS (SELECT * FROM a) SELECT a.col1 FROM a, b", "WITH b AS (SELECT * FROM n.a1 AS a) SELECT a.col1 FROM n.a1 AS a, b"),
    ("SELECT x FROM a AS q", "SELECT x FROM n.a1 AS q"),
    ("DELETE FROM a WHERE x IN (SELECT y FROM b)", "DELETE FROM n.a1 WHERE x IN (SELECT y FROM bb)"),
    ("UPDATE a SET x = 1", "UPDATE n.a1 SET x = 1"),
    ("INSERT INTO a (x) SELECT y FROM b", "INSERT INTO n.a1 (x) SELECT y FROM bb"),
    ("DROP TABLE a", "DROP TABLE n.a1"),
    ("TRUNCATE TABLE a", "TRUNCATE TABLE n.a1"),
    ("ALTER TABLE a RENAME TO z", "ALTER TABLE n.a1 RENAME TO z"),
    ("CREATE INDEX i ON a (x)", "CREATE INDEX i ON n.a1 ( x )"),
    ("MERGE INTO a USING b ON x = y WHEN MATCHED THEN DELETE", "MERGE INTO n.a1 USING bb ON x = y WHEN MATCHED THEN DELETE"),
]


@pytest.mark.parametrize("sql, want", REPLACED)
def test_replace_tables(sql, want):
    assert refactor.replace_tables(sql, {"A": "n.a1", "b": "bb"}) == want


def test_unpipe():
    assert refactor.unpipe("FROM a |> WHERE x > 1 |> SELECT x |> LIMIT 3") == "SELECT x FROM a WHERE x > 1 LIMIT 3"


def test_catalog_round_trip_names_and_session(spark):
    catalog = Catalog({"t": ["x", "x"]}, catalog="c", schema="s")
    assert catalog.find(["c", "s", "T"]).columns == {"x": "", "x_1": ""} and Catalog.from_json(catalog.to_json()).find(["t"]).name == "c.s.t"
    catalog.add_synonym("u", "t")
    assert catalog.find(["u"]).name == "c.s.t"
    catalog.drop("t")
    with pytest.raises(TableNotFound):
        catalog.find(["t"])
    spark.range(3).createOrReplaceTempView("ids")
    assert Catalog.of_session(spark).find(["ids"]).columns == {"id": "bigint"}


def test_schema_diff(spark):
    tables = {"src": StructType.fromDDL("id INT, s STRUCT<a: INT, b: STRING>, tags ARRAY<STRING>, x DOUBLE")}
    target = StructType.fromDDL("id BIGINT, s STRUCT<a: INT, c: STRING>, tags ARRAY<STRING>, gone DATE")
    told = diff.schema_diff(Engine(spark), "SELECT id, s, tags, x FROM src WHERE id > 1", target, "any", tables)
    assert [(a.name, a.status) for a in told] == [("id", "MODIFIED"), ("s", "UNCHANGED"), ("tags", "UNCHANGED"), ("x", "ADDED"), ("gone", "REMOVED")]
    assert [(a.name, a.status) for a in told[1].nested] == [("a", "UNCHANGED"), ("b", "ADDED"), ("c", "REMOVED")] and told[2].array


def test_merge_by_source_and_nulls(spark):
    spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, x string").createOrReplaceTempView("target")
    spark.createDataFrame([(2, "B"), (3, "C")], "id int, x string").createOrReplaceTempView("source")
    engine = Engine(spark)
    sql = "MERGE INTO target t USING source s ON t.id = s.id WHEN MATCHED THEN UPDATE SET x = s.x WHEN NOT MATCHED THEN INSERT (id, x) VALUES (s.id, s.x) WHEN NOT MATCHED BY SOURCE AND t.id = 1 THEN DELETE"
    assert sorted((tuple(r) for r in engine.sql(sql).collect()), key=str) == [(2, "B"), (3, "C"), (None, "n")]
    with pytest.raises(SqlError):
        engine.sql("UPDATE target SET nope = 1")
