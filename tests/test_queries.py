"""All registered queries of the SQL engine against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tributary import queries
from tributary.plans.engine import Engine

from .compare import connect, differ

ORACLES = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, sf_dir, name):
    assert differ(queries.queries()[name](spark, sf_dir), duck, ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_safe_cast_has_all_events(spark, sf_dir):
    got = {r["event_id"]: r["v"] for r in queries.queries()["safe_cast_all"](spark, sf_dir).collect()}
    values = {r["event_id"]: r["value"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()}
    away = {i: int(abs(x) + 0.5) * (1 if x > 0 else -1) for i, x in values.items() if x is not None and abs(x) % 1 == 0.5}
    assert set(got) == set(values) and away and {i: got[i] for i in away} == away


def test_unnest_has_all_elements(spark, sf_dir):
    sizes = {r["vec_id"]: len(r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = queries.queries()["unnest_embedding_all"](spark, sf_dir).groupBy("vec_id").count().collect()
    assert {r["vec_id"]: r["count"] for r in got} == sizes


#: Values in ascending order, and their type.
TIED = [("bigint", [-(2**62) - 1, -(2**62), -3, 2, 10, 2**53, 2**53 + 1]), ("double", [-1e300, -0.5, 9.0, 10.0, 1e300, float("nan")]), ("string", ["", "a", "ab", "b", "ba"]), ("date", ["1999-12-31", "2000-01-01", "2000-10-01"]), ("boolean", [False, True]), ("array<int>", [[1], [2]])]


@pytest.mark.parametrize("kind, values", TIED)
def test_ties_at_the_extreme_give_the_least_value(spark, kind, values):
    engine = Engine(spark)
    for order in (values, values[::-1], values[1:] + values[:1]):
        rows = [("t", v, 1.0) for v in order] + [("u", v, 1.0) for v in order[:-1]] + [("t", None, 1.0), ("t", None, None), ("n", None, None)] + [("v", None, 2.0), ("v", order[0], 1.0)]
        text = [(g, None if v is None else str(v).lower() if isinstance(v, bool) else "[" + ",".join(map(str, v)) + "]" if isinstance(v, list) else str(v), y) for g, v, y in rows]
        cast = "from_json(x, 'array<int>')" if kind == "array<int>" else f"CAST(x AS {kind})"
        spark.createDataFrame(text, "g string, x string, y double").repartition(5).selectExpr("g", f"{cast} AS x", "y").createOrReplaceTempView("tied")
        for dialect in ("snowflake", "bigquery"):
            got = {r["g"]: r for r in engine.sql("SELECT g, MAX_BY(x, y) AS hi, MIN_BY(x, y) AS lo FROM tied GROUP BY g", dialect).collect()}
            assert str(got["t"]["hi"]) == str(got["t"]["lo"]) == str(values[0])
            least = min(order[:-1], key=values.index)
            assert str(got["u"]["hi"]) == str(got["u"]["lo"]) == str(least)
            assert (got["n"]["hi"], got["n"]["lo"], got["v"]["hi"], str(got["v"]["lo"])) == (None, None, None, str(order[0]))


def test_max_by_with_ties_equals_its_sql(spark, sf_dir, tmp_path):
    """Customers repeated with shifted keys: the SQL read in order keeps the first, which has the least key."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = customers.count()
    copies = customers.crossJoin(spark.range(7).withColumnRenamed("id", "copy")).withColumn("c_custkey", F.expr(f"c_custkey + copy * {n}"))
    for name, rows in (("up", copies.orderBy("c_custkey")), ("mixed", copies.repartition(5, "c_name"))):
        rows.drop("copy").write.parquet(f"{tmp_path}/{name}/customer.parquet")
    connection = duckdb.connect()
    connection.execute("SET threads = 1")
    connection.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/up/customer.parquet/*.parquet' ORDER BY c_custkey")
    for name in ("up", "mixed"):
        assert differ(queries.queries()["agg_max_by"](spark, f"{tmp_path}/{name}"), connection, ORACLES["agg_max_by"]) is None
