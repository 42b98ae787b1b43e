"""Registered queries over the driver's tables: name, dialect, the query in that dialect, and the same in DuckDB SQL."""

from __future__ import annotations

import ast
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import function_queries
from .plans import tree as t
from .plans.emit import Emitter
from .plans.engine import Engine
from .plans.parser import parse

Q13 = """FROM customer |> LEFT JOIN orders ON c_custkey = o_custkey |> AGGREGATE COUNT(o_orderkey) AS c_count GROUP BY c_custkey
|> AGGREGATE COUNT(*) AS custdist GROUP BY c_count |> ORDER BY custdist DESC, c_count DESC"""
Q13_ORACLE = "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) GROUP BY c_count"
LINES = "l_orderkey, l_linenumber"

#: (name, dialect, query, oracle); an oracle of None is the query itself.
QUERIES: list[tuple[str, str, str, str | None]] = [
    # Pipes
    ("piped_q13", "bigquery", Q13, Q13_ORACLE),
    ("piped_extend_set_drop", "bigquery", "FROM orders |> WHERE o_orderstatus = 'F' |> EXTEND o_totalprice * 2 AS twice |> SET o_orderpriority = LOWER(o_orderpriority) |> DROP o_orderdate, o_custkey", "SELECT o_orderkey, o_orderstatus, o_totalprice, lower(o_orderpriority) AS o_orderpriority, o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus = 'F'"),
    ("piped_rename_as", "bigquery", "FROM nation |> RENAME n_name AS label |> AS n |> WHERE n.n_nationkey < 9 |> SELECT n.label, n.n_nationkey", "SELECT n_name AS label, n_nationkey FROM nation WHERE n_nationkey < 9"),
    ("piped_limit_where", "bigquery", "FROM nation |> ORDER BY n_nationkey |> LIMIT 5 OFFSET 2 |> WHERE n_regionkey > 0 |> SELECT n_nationkey", "SELECT n_nationkey FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 2) WHERE n_regionkey > 0"),
    ("piped_window", "bigquery", "FROM customer |> WINDOW RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r |> WHERE r <= 2 |> SELECT c_custkey, r", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS r FROM customer QUALIFY r <= 2"),
    ("piped_setops", "bigquery", "FROM nation |> SELECT n_regionkey AS k |> UNION ALL (SELECT r_regionkey FROM region), (SELECT 9) |> EXCEPT DISTINCT (SELECT 0)", "(SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region UNION ALL SELECT 9) EXCEPT SELECT 0"),
    ("piped_join_distinct", "bigquery", "FROM orders |> JOIN customer ON o_custkey = c_custkey |> SELECT DISTINCT c_mktsegment, o_orderstatus", "SELECT DISTINCT c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey"),
    ("piped_pivot", "bigquery", "FROM orders |> SELECT o_orderpriority, o_orderstatus, o_orderkey |> PIVOT(COUNT(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p)) |> SELECT o_orderpriority, COALESCE(f, 0) AS f, COALESCE(o, 0) AS o, COALESCE(p, 0) AS p", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1"),
    ("piped_unpivot", "bigquery", "FROM lineitem |> SELECT l_orderkey, l_linenumber, l_discount, l_tax |> UNPIVOT(rate FOR kind IN (l_discount AS 'discount', l_tax AS 'tax'))".replace("AS 'discount'", "").replace("AS 'tax'", ""), "SELECT l_orderkey, l_linenumber, 'l_discount' AS kind, l_discount AS rate FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem"),
    ("piped_aggregate_order", "bigquery", "FROM lineitem |> AGGREGATE SUM(l_quantity) AS q, COUNT(*) AS n GROUP AND ORDER BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL"),
    # Selection
    ("top_n", "redshift", "SELECT TOP 10 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    ("fetch_first", "any", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 5 ROWS FETCH NEXT 7 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5"),
    ("qualify_topk", "snowflake", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2", None),
    ("qualify_alias", "snowflake", "SELECT s_nationkey, s_suppkey, RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS r FROM supplier WHERE s_acctbal > 0 QUALIFY r = 1", "SELECT s_nationkey, s_suppkey, CAST(RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS INT) AS r FROM supplier WHERE s_acctbal > 0 QUALIFY r = 1"),
    ("star_except", "bigquery", "SELECT * EXCEPT (o_orderdate, o_custkey) FROM orders", "SELECT * EXCLUDE (o_orderdate, o_custkey) FROM orders"),
    ("star_replace", "bigquery", "SELECT * EXCEPT (o_orderdate) REPLACE (o_totalprice / 2 AS o_totalprice) FROM orders", "SELECT * EXCLUDE (o_orderdate) REPLACE (o_totalprice / 2 AS o_totalprice) FROM orders"),
    ("dual", "any", "SELECT 1 AS one, 'x' AS x FROM dual", "SELECT 1 AS one, 'x' AS x"),
    ("values_columns", "snowflake", "SELECT column1, column2 FROM (VALUES (1, 'a'), (2, 'b')) AS v", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS v(column1, column2)"),
    ("like_any", "snowflake", "SELECT p_partkey FROM part WHERE p_type LIKE ANY ('%TIN', 'SMALL%') AND p_name NOT ILIKE '%RED%'", "SELECT p_partkey FROM part WHERE (p_type LIKE '%TIN' OR p_type LIKE 'SMALL%') AND p_name NOT ILIKE '%RED%'"),
    ("like_all", "snowflake", "SELECT p_partkey FROM part WHERE p_type LIKE ALL ('%S%', '%T%')", "SELECT p_partkey FROM part WHERE p_type LIKE '%S%' AND p_type LIKE '%T%'"),
    ("rlike_whole", "snowflake", "SELECT p_partkey FROM part WHERE p_brand RLIKE 'Brand#[1-2][0-9]*'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-2][0-9]*')"),
    ("case_in_between", "any", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 10 AND 20 THEN 'mid' WHEN l_quantity > 20 THEN 'high' ELSE 'low' END AS band FROM lineitem WHERE l_returnflag IN ('A', 'R')", None),
    ("select_as_struct", "bigquery", "SELECT s.value_table.k AS k, s.value_table.n AS n FROM (SELECT AS STRUCT n_nationkey AS k, n_name AS n FROM nation) AS s", "SELECT n_nationkey AS k, n_name AS n FROM nation"),
    ("safe_cast_all", "bigquery", "SELECT event_id, SAFE_CAST(event_type AS INT64) AS bad, CAST(value AS INT64) AS v FROM events", "SELECT event_id, try_cast(event_type AS BIGINT) AS bad, CAST(round(value) AS BIGINT) AS v FROM events"),
    ("cte_nested", "any", "WITH a AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey), b AS (SELECT * FROM a WHERE total > 100000) SELECT c_name, total FROM b JOIN customer ON c_custkey = o_custkey", None),
    ("recursive_cte", "any", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT n FROM r", None),
    ("set_operations", "any", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier MINUS SELECT r_regionkey FROM region", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT r_regionkey FROM region"),
    # Joins
    ("join_inner", "any", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", None),
    ("join_left", "any", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'", None),
    ("join_right", "any", "SELECT r_name, n_name FROM nation RIGHT OUTER JOIN region ON n_regionkey = r_regionkey AND n_nationkey > 10", None),
    ("join_full", "any", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 50 AND c_acctbal > 0", None),
    ("join_using", "any", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)", None),
    ("join_natural", "any", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b", None),
    ("join_cross_comma", "any", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    ("join_theta", "any", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal", None),
    ("join_semi", "any", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", None),
    ("join_anti", "any", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    ("join_in", "any", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)", None),
    ("join_tree", "any", "SELECT c_custkey, n_name, r_name FROM customer JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey", None),
    ("join_lateral", "snowflake", "SELECT n_name, x.n FROM nation, LATERAL (SELECT COUNT(*) AS n FROM customer WHERE c_nationkey = n_nationkey) AS x", None),
    # Aggregation
    ("agg_countif", "bigquery", "SELECT l_returnflag, COUNTIF(l_quantity > 25) AS n, COUNT(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(*) FILTER (l_quantity > 25) AS n, count(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY 1"),
    ("agg_logical", "bigquery", "SELECT l_returnflag, LOGICAL_AND(l_quantity > 0) AS a, LOGICAL_OR(l_tax > 0.07) AS o FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, bool_and(l_quantity > 0) AS a, bool_or(l_tax > 0.07) AS o FROM lineitem GROUP BY 1"),
    ("agg_grouping_sets", "bigquery", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, GROUPING(l_returnflag) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS TINYINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"),
    ("agg_rollup", "any", "SELECT n_regionkey, n_name, COUNT(*) AS n FROM nation GROUP BY ROLLUP(n_regionkey, n_name)", None),
    ("agg_cube", "any", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)", None),
    ("agg_filter_having", "databricks", "SELECT o_custkey, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY o_custkey HAVING COUNT(*) > 5", None),
    ("agg_listagg", "redshift", "SELECT n_regionkey, LISTAGG(n_name, ';') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY 1"),
    ("agg_string_agg", "bigquery", "SELECT n_regionkey, STRING_AGG(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    ("agg_percentiles", "snowflake", "SELECT l_returnflag, PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY l_quantity) AS m, PERCENTILE_DISC(0.9) WITHIN GROUP (ORDER BY l_quantity) AS d, MEDIAN(l_tax) AS t FROM lineitem GROUP BY l_returnflag", None),
    ("agg_bitwise", "snowflake", "SELECT o_orderstatus, BITAND_AGG(o_orderkey) AS a, BITOR_AGG(o_orderkey) AS o, BITXOR_AGG(o_orderkey) AS x FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, bit_and(o_orderkey) AS a, bit_or(o_orderkey) AS o, bit_xor(o_orderkey) AS x FROM orders GROUP BY 1"),
    ("agg_boolean", "snowflake", "SELECT n_regionkey, BOOLAND_AGG(n_nationkey > 3) AS a, BOOLOR_AGG(n_nationkey > 20) AS o, BOOLXOR_AGG(n_nationkey > 22) AS x FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, bool_and(n_nationkey > 3) AS a, bool_or(n_nationkey > 20) AS o, count(*) FILTER (n_nationkey > 22) = 1 AS x FROM nation GROUP BY 1"),
    ("agg_regr", "databricks", "SELECT ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS s, ROUND(REGR_INTERCEPT(l_extendedprice, l_quantity), 2) AS i, ROUND(REGR_R2(l_extendedprice, l_quantity), 6) AS r, ROUND(CORR(l_tax, l_discount), 6) AS c, ROUND(COVAR_POP(l_tax, l_quantity), 6) AS p, REGR_COUNT(l_tax, l_quantity) AS n FROM lineitem", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS s, round(regr_intercept(l_extendedprice, l_quantity), 2) AS i, round(regr_r2(l_extendedprice, l_quantity), 6) AS r, round(corr(l_tax, l_discount), 6) AS c, round(covar_pop(l_tax, l_quantity), 6) AS p, CAST(regr_count(l_tax, l_quantity) AS BIGINT) AS n FROM lineitem"),
    ("agg_variance", "snowflake", "SELECT l_returnflag, ROUND(VARIANCE_POP(l_quantity), 6) AS vp, ROUND(VARIANCE_SAMP(l_quantity), 6) AS vs, ROUND(STDDEV(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, round(stddev(l_quantity), 6) AS sd FROM lineitem GROUP BY 1"),
    ("agg_max_by", "snowflake", "SELECT c_nationkey, MAX_BY(c_custkey, c_acctbal) AS hi, MIN_BY(c_custkey, c_acctbal) AS lo FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, arg_max(c_custkey, c_acctbal) AS hi, arg_min(c_custkey, c_acctbal) AS lo FROM customer GROUP BY 1"),
    ("agg_array", "snowflake", "SELECT n_regionkey, ARRAY_TO_STRING(ARRAY_AGG(n_name) WITHIN GROUP (ORDER BY n_nationkey DESC), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_nationkey DESC), ',') AS names FROM nation GROUP BY 1"),
    ("agg_array_limit", "bigquery", "SELECT o_custkey, ARRAY_TO_STRING(ARRAY_AGG(CAST(o_orderkey AS STRING) ORDER BY o_totalprice DESC LIMIT 2), ',') AS top FROM orders GROUP BY o_custkey", "SELECT o_custkey, array_to_string(list_slice(array_agg(CAST(o_orderkey AS VARCHAR) ORDER BY o_totalprice DESC), 1, 2), ',') AS top FROM orders GROUP BY 1"),
    ("agg_approx_distinct", "redshift", "SELECT ABS(APPROXIMATE COUNT(DISTINCT l_orderkey) - COUNT(DISTINCT l_orderkey)) < 0.15 * COUNT(DISTINCT l_orderkey) AS near FROM lineitem", "SELECT true AS near"),
    ("pivot_sql", "snowflake", "SELECT * FROM (SELECT n_regionkey, CASE WHEN n_nationkey < 12 THEN 'lo' ELSE 'hi' END AS half, n_nationkey FROM nation) PIVOT (SUM(n_nationkey) FOR half IN ('lo' AS lo, 'hi' AS hi))", "SELECT n_regionkey, CAST(sum(n_nationkey) FILTER (n_nationkey < 12) AS BIGINT) AS lo, CAST(sum(n_nationkey) FILTER (n_nationkey >= 12) AS BIGINT) AS hi FROM nation GROUP BY 1"),
    # Windows
    ("win_rank", "any", "SELECT c_custkey, RANK() OVER w AS r, DENSE_RANK() OVER w AS d, NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q, ROUND(PERCENT_RANK() OVER w, 6) AS p, ROUND(CUME_DIST() OVER w, 6) AS u FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)", "SELECT c_custkey, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS d, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INT) AS q, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS u FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)"),
    ("win_lag_lead", "any", "SELECT event_id, LAG(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, LEAD(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events", None),
    ("win_nth", "snowflake", "SELECT o_orderkey, NTH_VALUE(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders", None),
    ("win_frame_rows", "any", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders", None),
    ("win_frame_range", "any", "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM part", None),
    ("win_percentile", "bigquery", "SELECT DISTINCT c_nationkey, PERCENTILE_CONT(c_acctbal, 0.5) OVER (PARTITION BY c_nationkey) AS m FROM customer", "SELECT DISTINCT c_nationkey, quantile_cont(c_acctbal, 0.5) OVER (PARTITION BY c_nationkey) AS m FROM customer"),
    ("win_countif", "bigquery", "SELECT c_custkey, COUNTIF(c_acctbal > 0) OVER (PARTITION BY c_nationkey) AS n FROM customer", "SELECT c_custkey, count(*) FILTER (c_acctbal > 0) OVER (PARTITION BY c_nationkey) AS n FROM customer"),
    ("win_distinct", "snowflake", "SELECT c_custkey, COUNT(DISTINCT c_mktsegment) OVER (PARTITION BY c_nationkey) AS n FROM customer", "SELECT c_custkey, CAST(count(DISTINCT c_mktsegment) OVER (PARTITION BY c_nationkey) AS INT) AS n FROM customer"),
    ("win_ignore_nulls", "snowflake", "SELECT event_id, LAST_VALUE(CASE WHEN event_type = 'click' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click FROM events", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click FROM events"),
    # Dates
    *((f"date_diff_{p.lower()}", "bigquery", f"SELECT o_orderkey, DATE_DIFF(CAST(o_orderdate AS DATE), DATE '1995-06-14', {p}) AS n FROM orders", f"SELECT o_orderkey, date_diff('{p.lower()}', DATE '1995-06-14', CAST(o_orderdate AS DATE)) AS n FROM orders") for p in ("DAY", "MONTH", "QUARTER", "YEAR")),
    ("date_diff_isoweek", "bigquery", "SELECT o_orderkey, DATE_DIFF(CAST(o_orderdate AS DATE), DATE '1995-06-14', ISOWEEK) AS n FROM orders", "SELECT o_orderkey, date_diff('day', DATE '1995-06-12', CAST(date_trunc('week', o_orderdate) AS DATE)) // 7 AS n FROM orders"),
    *((f"datediff_{p}", "snowflake", f"SELECT event_id, DATEDIFF({p}, TIMESTAMP '2024-01-01 10:20:30', ts) AS n FROM events", f"SELECT event_id, date_diff('{p}', TIMESTAMP '2024-01-01 10:20:30', ts) AS n FROM events") for p in ("hour", "minute", "second")),
    *((f"date_trunc_{p}", "redshift", f"SELECT event_id, DATE_TRUNC('{p}', ts) AS x FROM events", f"SELECT event_id, CAST(date_trunc('{p}', ts) AS TIMESTAMP) AS x FROM events") for p in ("hour", "day", "week", "month", "quarter", "year")),
    ("date_add_sub", "bigquery", "SELECT o_orderkey, DATE_ADD(CAST(o_orderdate AS DATE), INTERVAL 3 MONTH) AS a, DATE_SUB(CAST(o_orderdate AS DATE), INTERVAL 10 DAY) AS s, DATE_TRUNC(CAST(o_orderdate AS DATE), WEEK(MONDAY)) AS w FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) - INTERVAL 10 DAY AS DATE) AS s, CAST(date_trunc('week', o_orderdate) AS DATE) AS w FROM orders"),
    ("dateadd_parts", "snowflake", "SELECT event_id, DATEADD(hour, 5, ts) AS h, DATEADD(minute, -7, ts) AS m FROM events", "SELECT event_id, ts + INTERVAL 5 HOUR AS h, ts - INTERVAL 7 MINUTE AS m FROM events"),
    ("last_day", "snowflake", "SELECT o_orderkey, LAST_DAY(CAST(o_orderdate AS DATE)) AS d, ADD_MONTHS(LAST_DAY(CAST(o_orderdate AS DATE)), 1) AS a FROM orders", "SELECT o_orderkey, last_day(o_orderdate) AS d, last_day(last_day(o_orderdate) + INTERVAL 1 DAY) AS a FROM orders"),
    ("format_date", "bigquery", "SELECT o_orderkey, FORMAT_DATE('%d/%m/%Y %j', CAST(o_orderdate AS DATE)) AS f FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %j') AS f FROM orders"),
    ("to_char", "redshift", "SELECT event_id, TO_CHAR(ts, 'YYYY-MM-DD HH24:MI:SS') AS f FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS f FROM events"),
    ("parse_date", "bigquery", "SELECT o_orderkey, PARSE_DATE('%Y%m%d', FORMAT_DATE('%Y%m%d', CAST(o_orderdate AS DATE))) AS d FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders"),
    ("unix_convert", "bigquery", "SELECT event_id, UNIX_SECONDS(CAST(ts AS TIMESTAMP)) AS s, UNIX_DATE(CAST(ts AS DATE)) AS d FROM events", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INT) AS d FROM events"),
    ("time_slice", "snowflake", "SELECT event_id, TIME_SLICE(ts, 15, 'MINUTE') AS s, TIME_SLICE(ts, 2, 'MONTH', 'END') AS e FROM events", "SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS s, CAST(time_bucket(INTERVAL 2 MONTH, ts, TIMESTAMP '1970-01-01') + INTERVAL 2 MONTH AS TIMESTAMP) AS e FROM events"),
    ("extract_parts", "bigquery", "SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(ISOWEEK FROM ts) AS w, EXTRACT(DAYOFYEAR FROM ts) AS j, EXTRACT(HOUR FROM ts) AS h, EXTRACT(SECOND FROM ts) AS s FROM events", "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(week(ts) AS INT) AS w, CAST(dayofyear(ts) AS INT) AS j, CAST(hour(ts) AS INT) AS h, CAST(second(ts) AS INT) AS s FROM events"),
    ("generate_dates", "bigquery", "SELECT d FROM UNNEST(GENERATE_DATE_ARRAY(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 1 WEEK)) AS d", "SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 7 DAY)) AS DATE) AS d"),
    ("convert_timezone", "redshift", "SELECT event_id, CONVERT_TIMEZONE('UTC', 'Asia/Bangkok', ts) AS b FROM events", "SELECT event_id, ts + INTERVAL 7 HOUR AS b FROM events"),
    # Text
    ("text_regexp", "bigquery", "SELECT p_partkey, REGEXP_EXTRACT(p_brand, r'#(\\d)') AS d, REGEXP_REPLACE(p_type, r'([A-Z])[A-Z]+', r'\\1') AS s, REGEXP_CONTAINS(p_name, r'^[a-m]') AS c FROM part", "SELECT p_partkey, nullif(regexp_extract(p_brand, '#(\\d)', 1), '') AS d, regexp_replace(p_type, '([A-Z])[A-Z]+', '\\1', 'g') AS s, regexp_matches(p_name, '^[a-m]') AS c FROM part"),
    ("text_regexp_count", "redshift", "SELECT p_partkey, REGEXP_COUNT(p_type, '[AEIOU]') AS n, REGEXP_SUBSTR(p_type, '[A-Z]+', 1, 2) AS w FROM part", "SELECT p_partkey, CAST(len(regexp_extract_all(p_type, '[AEIOU]')) AS INT) AS n, regexp_extract_all(p_type, '[A-Z]+')[2] AS w FROM part"),
    ("text_pad", "bigquery", "SELECT p_partkey, LPAD(p_brand, 12, '*') AS l, RPAD(p_brand, 5) AS r, LENGTH(p_name) AS n, BYTE_LENGTH(p_name) AS b FROM part", "SELECT p_partkey, lpad(p_brand, 12, '*') AS l, rpad(p_brand, 5, ' ') AS r, CAST(length(p_name) AS INT) AS n, CAST(strlen(p_name) AS INT) AS b FROM part"),
    ("text_split", "bigquery", "SELECT p_partkey, SPLIT(p_type, ' ')[OFFSET(0)] AS f, ARRAY_LENGTH(SPLIT(p_type, ' ')) AS n FROM part", "SELECT p_partkey, string_split(p_type, ' ')[1] AS f, CAST(len(string_split(p_type, ' ')) AS INT) AS n FROM part"),
    ("text_split_part", "redshift", "SELECT p_partkey, SPLIT_PART(p_type, ' ', 2) AS s, LEN(p_type) AS n, REPLICATE(p_brand, 2) AS r FROM part", "SELECT p_partkey, split_part(p_type, ' ', 2) AS s, CAST(length(p_type) AS INT) AS n, repeat(p_brand, 2) AS r FROM part"),
    ("text_strtok", "snowflake", "SELECT p_partkey, STRTOK(p_brand, '#', 2) AS t, INSERT(p_brand, 1, 5, 'B') AS i FROM part", "SELECT p_partkey, string_split(p_brand, '#')[2] AS t, 'B' || substr(p_brand, 6) AS i FROM part"),
    ("text_position", "snowflake", "SELECT p_partkey, CHARINDEX('a', p_name) AS c, POSITION('e' IN p_name) AS p, CONTAINS(p_name, 'an') AS x, STARTSWITH(p_name, 'a') AS s FROM part", "SELECT p_partkey, CAST(instr(p_name, 'a') AS INT) AS c, CAST(instr(p_name, 'e') AS INT) AS p, contains(p_name, 'an') AS x, starts_with(p_name, 'a') AS s FROM part"),
    ("text_hash", "databricks", "SELECT p_partkey, MD5(p_name) AS m, SHA2(p_name, 256) AS s FROM part", "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s FROM part"),
    ("text_trim_translate", "redshift", "SELECT p_partkey, BTRIM(p_type, 'SLM') AS b, TRANSLATE(p_brand, 'Bd', 'xy') AS t, REVERSE(p_brand) AS r, UPPER(p_name) AS u FROM part", "SELECT p_partkey, trim(p_type, 'SLM') AS b, translate(p_brand, 'Bd', 'xy') AS t, reverse(p_brand) AS r, upper(p_name) AS u FROM part"),
    ("text_distance", "snowflake", "SELECT p_partkey, EDITDISTANCE(p_name, p_type) AS d, EDITDISTANCE(p_name, p_brand, 3) AS m FROM part", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INT) AS d, CAST(least(levenshtein(p_name, p_brand), 3) AS INT) AS m FROM part"),
    ("text_concat", "any", "SELECT c_custkey, c_name || '-' || c_mktsegment AS x, CONCAT(c_name, c_mktsegment) AS y FROM customer", None),
    # Numbers
    ("math_div0", "snowflake", "SELECT l_orderkey, l_linenumber, DIV0(l_extendedprice, l_discount) AS d, SQUARE(l_quantity) AS s FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice / l_discount END AS d, pow(l_quantity, 2) AS s FROM lineitem"),
    ("math_safe", "bigquery", "SELECT l_orderkey, l_linenumber, SAFE_DIVIDE(l_extendedprice, l_tax) AS d, SAFE_NEGATE(l_quantity) AS n, DIV(l_orderkey, 7) AS i FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 THEN l_extendedprice / l_tax END AS d, -l_quantity AS n, l_orderkey // 7 AS i FROM lineitem"),
    ("math_log", "redshift", "SELECT l_orderkey, l_linenumber, ROUND(LOG(l_extendedprice), 8) AS l, ROUND(DLOG1(l_extendedprice), 8) AS n, ROUND(DEXP(l_tax), 8) AS e FROM lineitem", "SELECT l_orderkey, l_linenumber, round(log10(l_extendedprice), 8) AS l, round(ln(l_extendedprice), 8) AS n, round(exp(l_tax), 8) AS e FROM lineitem"),
    ("math_trunc", "bigquery", "SELECT l_orderkey, l_linenumber, TRUNC(l_quantity / 7, 1) AS t, CAST(TRUNC(l_extendedprice) AS INT64) AS i, MOD(l_orderkey, 5) AS m FROM lineitem", "SELECT l_orderkey, l_linenumber, floor(abs(l_quantity / 7) * 10) / 10 AS t, CAST(trunc(l_extendedprice) AS BIGINT) AS i, l_orderkey % 5 AS m FROM lineitem"),
    ("math_trig", "any", "SELECT c_custkey, ROUND(SIN(c_acctbal), 8) AS s, ROUND(SQRT(ABS(c_acctbal)), 8) AS q, SIGN(c_acctbal) AS g, ROUND(ATAN2(c_acctbal, 2), 8) AS a FROM customer", "SELECT c_custkey, round(sin(c_acctbal), 8) AS s, round(sqrt(abs(c_acctbal)), 8) AS q, CAST(sign(c_acctbal) AS DOUBLE) AS g, round(atan2(c_acctbal, 2), 8) AS a FROM customer"),
    ("math_bucket", "bigquery", "SELECT c_custkey, RANGE_BUCKET(c_acctbal, [0.0, 1000.0, 5000.0]) AS b, GREATEST(c_acctbal, 100) AS g FROM customer", "SELECT c_custkey, CAST(len(list_filter([0.0, 1000.0, 5000.0], lambda x: x <= c_acctbal)) AS INT) AS b, greatest(c_acctbal, 100) AS g FROM customer"),
    # Arrays
    ("arr_generate", "bigquery", "SELECT n_nationkey, x FROM nation CROSS JOIN UNNEST(GENERATE_ARRAY(1, n_regionkey)) AS x", "SELECT n_nationkey, CAST(x AS INT) AS x FROM nation, unnest(range(1, n_regionkey + 1)) AS u(x)"),
    ("arr_slice", "snowflake", "SELECT vec_id, ARRAY_SIZE(embedding) AS n, ROUND(ARRAY_MAX(ARRAY_SLICE(embedding, 0, 5)), 5) AS m FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(list_max(embedding[1:5]), 5) AS m FROM embeddings"),
    ("arr_position", "snowflake", "SELECT n_nationkey, ARRAY_POSITION(n_regionkey, ARRAY_CONSTRUCT(4, 3, 2, 1)) AS p, ARRAY_CONTAINS(n_regionkey, ARRAY_CONSTRUCT(1, 2)) AS c FROM nation", "SELECT n_nationkey, CAST(list_position([4, 3, 2, 1], n_regionkey) - 1 AS BIGINT) AS p, list_contains([1, 2], n_regionkey) AS c FROM nation"),
    ("arr_compact", "snowflake", "SELECT n_nationkey, ARRAY_SIZE(ARRAY_CONSTRUCT_COMPACT(n_regionkey, NULLIF(n_regionkey, 1), NULL)) AS n FROM nation", "SELECT n_nationkey, CAST(CASE WHEN n_regionkey = 1 THEN 1 ELSE 2 END AS INT) AS n FROM nation"),
    ("unnest_embedding_all", "bigquery", "SELECT vec_id, o, CAST(x AS FLOAT64) AS x FROM embeddings, UNNEST(embedding) AS x WITH OFFSET AS o", "SELECT vec_id, CAST(o - 1 AS INT) AS o, CAST(embedding[o] AS DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(o)"),
    ("split_to_table", "snowflake", "SELECT p_partkey, s.index, s.value FROM part, LATERAL SPLIT_TO_TABLE(p_type, ' ') AS s WHERE s.index > 0", "SELECT p_partkey, CAST(i AS INT) AS index, string_split(p_type, ' ')[i] AS value FROM part, unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS u(i)"),
    ("generator", "snowflake", "SELECT seq4 AS n FROM TABLE(GENERATOR(ROWCOUNT => 50))", "SELECT range AS n FROM range(50)"),
    ("array_subquery", "bigquery", "SELECT n_nationkey, ARRAY_LENGTH(ARRAY(SELECT x * 2 FROM UNNEST([1, 2, 3]) AS x WHERE x > 1)) AS n FROM nation", "SELECT n_nationkey, 2::INT AS n FROM nation"),
    # JSON
    ("json_path", "bigquery", "SELECT event_id, CAST(JSON_VALUE(props, '$.k') AS INT64) AS k, JSON_QUERY(props, '$.k') AS q FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS q FROM events"),
    ("json_path_text", "redshift", "SELECT event_id, JSON_EXTRACT_PATH_TEXT(props, 'k') AS k, IS_VALID_JSON(props) AS v, JSON_TYPEOF(props) AS t FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS v, lower(json_type(props)) AS t FROM events"),
    ("variant_path", "snowflake", "SELECT event_id, PARSE_JSON(props):k::INT AS k, OBJECT_KEYS(PARSE_JSON(props))[0] AS n FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_keys(props)[1] AS n FROM events"),
    ("json_build", "bigquery", "SELECT n_nationkey, JSON_OBJECT('k', n_nationkey, 'r', n_regionkey) AS j FROM nation", "SELECT n_nationkey, '{\"k\":' || n_nationkey || ',\"r\":' || n_regionkey || '}' AS j FROM nation"),
    ("get_json_object", "databricks", "SELECT event_id, GET_JSON_OBJECT(props, '$.k') AS k, JSON_ARRAY_LENGTH('[1,2]') AS n FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, 2::INT AS n FROM events"),
    # Decision-support shapes
    ("tpch_q1", "any", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, ROUND(AVG(l_discount), 6) AS d, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus", None),
    ("tpch_q3", "snowflake", "SELECT TOP 10 l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY revenue DESC, l_orderkey LIMIT 10"),
    ("tpch_q5", "any", "SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name", None),
    ("tpch_q6", "redshift", "SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", None),
    ("tpch_q18", "bigquery", "SELECT o_orderkey, SUM(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 200) GROUP BY o_orderkey", None),
]


QUERIES += function_queries.queries()


def run(spark: SparkSession, sf_dir: str, dialect: str, sql: str) -> DataFrame:
    """The query with views over the tables that it names."""
    engine, node = Engine(spark), parse(sql, dialect)
    ctes = {x.name.lower() for x in t.walk(node) if isinstance(x, t.With)}
    names = {x.parts[-1].lower() for x in t.walk(node) if isinstance(x, t.Table)} - ctes - {"dual", ""}
    engine.register_tables(sf_dir, sorted(names))
    return engine.sql(sql, dialect)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: (lambda spark, sf_dir, d=dialect, q=sql: run(spark, sf_dir, d, q)) for name, dialect, sql, _ in QUERIES}
    return found | EXTRA


def oracle_sql() -> dict[str, str]:
    return {name: oracle or sql for name, _, sql, oracle in QUERIES} | EXTRA_ORACLES


# Operators that aren't one query


def dml(sql: str, dialect: str = "any"):
    return lambda spark, sf_dir: run(spark, sf_dir, dialect, sql)


def lineage_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.resolver import lineage
    from .sources.catalog import Catalog

    catalog = Catalog({n: list(spark.read.parquet(f"{sf_dir}/{n}.parquet").columns) for n in ("customer", "orders")})
    found = lineage("WITH t AS (SELECT o_custkey AS k, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c_name, s * 2 AS twice FROM customer JOIN t ON k = c_custkey", catalog)
    return spark.createDataFrame([(c, x) for c, xs in found.items() for x in sorted(xs)], "col string, source string")


def schema_diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.types import StructType

    from .operators.diff import schema_diff

    engine = Engine(spark)
    engine.register_tables(sf_dir, ["nation"])
    target = StructType.fromDDL("n_nationkey INT, n_name BIGINT, gone STRING")
    return spark.createDataFrame([(a.name, a.status) for a in schema_diff(engine, "SELECT n_nationkey, n_name, n_regionkey FROM nation", target)], "name string, status string")


def replaced_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.refactor import replace_tables

    return run(spark, sf_dir, "any", replace_tables("WITH part AS (SELECT n_name FROM area) SELECT part.n_name FROM part", {"area": "nation", "part": "nowhere"}))


def unpiped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.refactor import unpipe

    return run(spark, sf_dir, "bigquery", unpipe(Q13, "bigquery"))


def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last statement of a script that makes, changes and reads a temporary view."""
    engine = Engine(spark)
    engine.register_tables(sf_dir, ["supplier"])
    return engine.run_script(
        "CREATE TEMP VIEW script_rows AS SELECT s_suppkey, s_acctbal FROM supplier; UPDATE script_rows SET s_acctbal = 0 WHERE s_acctbal < 0; "
        "INSERT INTO script_rows VALUES (-1, 1.5); DELETE FROM script_rows WHERE s_suppkey = 3; SELECT s_suppkey, s_acctbal FROM script_rows"
    )[-1]


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    Engine(spark)  # the session zone
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def tumbling_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.windows import tumbling

    return tumbling(events_of(spark, sf_dir), "ts", "6 hours", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s")])


def sliding_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.windows import tumbling

    return tumbling(events_of(spark, sf_dir), "ts", "6 hours", [], [F.count("*").alias("n")], slide="3 hours")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.windows import sessions

    return sessions(events_of(spark, sf_dir), "ts", "2 hours", ["user_id"], [F.count("*").alias("n")])


def filled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.windows import gap_filled

    daily = events_of(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return gap_filled(daily, "day", "1 DAY", ["user_id"], ["n"])


EXTRA: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "update_rows": dml("UPDATE supplier SET s_acctbal = s_acctbal + 1, s_name = 'x' WHERE s_nationkey < 5"),
    "update_from": dml("UPDATE supplier SET s_name = n_name FROM nation WHERE s_nationkey = n_nationkey AND n_regionkey = 1"),
    "delete_rows": dml("DELETE FROM customer WHERE c_acctbal < 0 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)"),
    "insert_rows": dml("INSERT INTO region (r_regionkey, r_name) SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 2"),
    "merge_upsert": dml(
        "MERGE INTO supplier t USING (SELECT c_custkey + 50 AS k, c_name, c_acctbal FROM customer WHERE c_custkey <= 100) s ON t.s_suppkey = s.k "
        "WHEN MATCHED AND s.c_acctbal < 0 THEN DELETE WHEN MATCHED THEN UPDATE SET s_acctbal = s.c_acctbal WHEN NOT MATCHED THEN INSERT (s_suppkey, s_name) VALUES (s.k, s.c_name)"
    ),
    "unpiped_q13": unpiped,
    "run_script": script,
    "window_tumbling": tumbling_hours,
    "window_sliding": sliding_hours,
    "window_sessions": user_sessions,
    "window_gap_fill": filled_days,
    "lineage_flat": lineage_flat,
    "schema_diff": schema_diff_rows,
    "replace_tables": replaced_tables,
}
EXTRA_ORACLES = {
    "unpiped_q13": Q13_ORACLE,
    "run_script": "SELECT s_suppkey, greatest(s_acctbal, 0) AS s_acctbal FROM supplier WHERE s_suppkey <> 3 UNION ALL SELECT -1, 1.5",
    "window_tumbling": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY ALL",
    "window_sliding": "SELECT w AS window_start, w + INTERVAL 6 HOUR AS window_end, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 3 HOUR]) AS w FROM events) GROUP BY ALL",
    "window_sessions": "SELECT min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT ts, user_id, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k",
    "window_gap_fill": "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY user_id) SELECT g.user_id, g.day, last_value(n IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.day) AS n FROM g LEFT JOIN d ON g.user_id = d.user_id AND g.day = d.day",
    "update_rows": "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'x' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_nationkey < 5 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier",
    "update_from": "SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
    "delete_rows": "SELECT * FROM customer WHERE NOT (c_acctbal < 0 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0))",
    "insert_rows": "SELECT * FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 2",
    "merge_upsert": "SELECT coalesce(s_suppkey, k) AS s_suppkey, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS s_name, s_nationkey, CASE WHEN k IS NULL THEN s_acctbal WHEN s_suppkey IS NOT NULL THEN c_acctbal END AS s_acctbal FROM supplier FULL JOIN (SELECT c_custkey + 50 AS k, c_name, c_acctbal FROM customer WHERE c_custkey <= 100) ON s_suppkey = k WHERE NOT (s_suppkey IS NOT NULL AND k IS NOT NULL AND c_acctbal < 0)",
    "lineage_flat": "SELECT * FROM (VALUES ('c_name', 'customer.c_name'), ('twice', 'orders.o_totalprice')) AS v(col, source)",
    "schema_diff": "SELECT * FROM (VALUES ('n_nationkey', 'UNCHANGED'), ('n_name', 'MODIFIED'), ('n_regionkey', 'ADDED'), ('gone', 'REMOVED')) AS v(name, status)",
    "replace_tables": "SELECT n_name FROM nation",
}


# Literal cases of each dialect


def cases() -> list[list[str]]:
    """(dialect, expression, value as Python prints it)."""
    text = (Path(__file__).parent / "cases.tsv").read_text(encoding="utf-8")
    return [line.split("\t") for line in text.splitlines() if line]


def as_spark_text(value: str) -> str | None:
    """A printed Python value as Spark casts it to a string."""
    if value in {"None", "True", "False", "inf"}:
        return {"None": None, "True": "true", "False": "false", "inf": "Infinity"}[value]
    try:
        items = ast.literal_eval(value) if value.startswith("[") else None
    except (ValueError, SyntaxError):
        items = None
    if items is not None and str(items) == value:
        return "[" + ", ".join("null" if x is None else str(x) for x in items) + "]"
    return value


def literals(dialect: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, parts = Engine(spark), []
        for _, expression, _ in (c for c in cases() if c[0] == dialect):
            node = parse(f"SELECT {expression}", dialect)
            (item,) = node.items
            node.items = [t.Item(t.Text(expression), "expression"), t.Item(t.Cast(item.value, "STRING"), "value")]
            parts.append(f"({Emitter(dialect).query(node)})")
        return engine.spark.sql(" UNION ALL ".join(parts))

    return build


def literal_oracle(dialect: str) -> str:
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(e)}, {quoted(as_spark_text(v))})" for d, e, v in cases() if d == dialect)
    return f"SELECT CAST(expression AS VARCHAR) AS expression, CAST(value AS VARCHAR) AS value FROM (VALUES {rows}) AS v(expression, value)"


for _dialect in ("any", "bigquery", "redshift", "snowflake", "databricks"):
    EXTRA[f"literals_{_dialect}"] = literals(_dialect)
    EXTRA_ORACLES[f"literals_{_dialect}"] = literal_oracle(_dialect)
