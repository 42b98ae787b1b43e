"""Registered queries of single functions over whole tables: expressions of a dialect beside the same in DuckDB SQL."""

from __future__ import annotations

#: (name, dialect, key columns, FROM, FROM of the oracle or None, GROUP BY, [(alias, expression, oracle)])
GROUPS: list[tuple[str, str, str, str, str | None, bool, list[tuple[str, str, str]]]] = [
    ("fn_date_parts", "databricks", "o_orderkey", "orders", None, False, [
        ("d1", "DAY(o_orderdate)", "CAST(day(o_orderdate) AS INT)"),
        ("d2", "DAYOFMONTH(o_orderdate)", "CAST(dayofmonth(o_orderdate) AS INT)"),
        ("d3", "DAYOFWEEK(o_orderdate)", "CAST(dayofweek(o_orderdate) + 1 AS INT)"),
        ("d4", "DAYOFYEAR(o_orderdate)", "CAST(dayofyear(o_orderdate) AS INT)"),
        ("d5", "MONTH(o_orderdate)", "CAST(month(o_orderdate) AS INT)"),
        ("d6", "QUARTER(o_orderdate)", "CAST(quarter(o_orderdate) AS INT)"),
        ("d7", "YEAR(o_orderdate)", "CAST(year(o_orderdate) AS INT)"),
        ("d8", "WEEKDAY(o_orderdate)", "CAST(isodow(o_orderdate) - 1 AS INT)"),
        ("d9", "WEEKOFYEAR(o_orderdate)", "CAST(weekofyear(o_orderdate) AS INT)"),
        ("d10", "MAKE_DATE(YEAR(o_orderdate), 1, DAY(o_orderdate))", "make_date(year(o_orderdate), 1, day(o_orderdate))"),
    ]),
    ("fn_date_parts_warehouse", "snowflake", "o_orderkey", "orders", None, False, [
        ("d1", "DAY(o_orderdate)", "CAST(day(o_orderdate) AS INT)"),
        ("d2", "DAYOFMONTH(o_orderdate)", "CAST(dayofmonth(o_orderdate) AS INT)"),
        ("d4", "DAYOFYEAR(o_orderdate)", "CAST(dayofyear(o_orderdate) AS INT)"),
        ("d5", "MONTH(o_orderdate)", "CAST(month(o_orderdate) AS INT)"),
        ("d6", "QUARTER(o_orderdate)", "CAST(quarter(o_orderdate) AS INT)"),
        ("d7", "YEAR(o_orderdate)", "CAST(year(o_orderdate) AS INT)"),
        ("d8", "TIMESTAMPDIFF(MONTH, DATE '1990-01-15', o_orderdate)", "CAST(date_diff('month', DATE '1990-01-15', o_orderdate) AS BIGINT)"),
    ]),
    ("fn_time_parts", "databricks", "event_id", "events", None, False, [
        ("t1", "HOUR(ts)", "CAST(hour(ts) AS INT)"),
        ("t2", "MINUTE(ts)", "CAST(minute(ts) AS INT)"),
        ("t3", "SECOND(ts)", "CAST(second(ts) AS INT)"),
        ("t4", "TO_UNIX_TIMESTAMP(ts)", "CAST(floor(epoch(ts)) AS BIGINT)"),
        ("t5", "DATE_FORMAT(ts, 'HH:mm')", "strftime(ts, '%H:%M')"),
    ]),
    ("fn_time_parts_warehouse", "snowflake", "event_id", "events", None, False, [
        ("t1", "HOUR(ts)", "CAST(hour(ts) AS INT)"),
        ("t2", "MINUTE(ts)", "CAST(minute(ts) AS INT)"),
        ("t3", "SECOND(ts)", "CAST(second(ts) AS INT)"),
        ("t4", "TIMEFROMPARTS(HOUR(ts), MINUTE(ts), 7)", "make_time(hour(ts), minute(ts), 7.0)"),
        ("t5", "TIMESTAMPNTZFROMPARTS(2020, 1, DAY(ts), HOUR(ts), 3, 4)", "make_timestamp(2020, 1, day(ts), hour(ts), 3, 4.0)"),
        ("t6", "TIMESTAMPFROMPARTS(2020, 1, DAY(ts), HOUR(ts), 3, 4)", "make_timestamp(2020, 1, day(ts), hour(ts), 3, 4.0)"),
        ("t7", "CAST(TIMESTAMPLTZFROMPARTS(2020, 1, DAY(ts), HOUR(ts), 3, 4) AS TIMESTAMP_NTZ)", "make_timestamp(2020, 1, day(ts), hour(ts), 3, 4.0)"),
        ("t8", "CAST(TIMESTAMPTZFROMPARTS(2020, 1, DAY(ts), HOUR(ts), 3, 4) AS TIMESTAMP_NTZ)", "make_timestamp(2020, 1, day(ts), hour(ts), 3, 4.0)"),
        ("t9", "TO_TIMESTAMP_NTZ(CAST(ts AS VARCHAR))", "ts"),
        ("u1", "TRY_TO_TIMESTAMP_NTZ(event_type)", "CAST(NULL AS TIMESTAMP)"),
        ("u2", "CAST(TO_TIMESTAMP_LTZ(CAST(ts AS VARCHAR)) AS TIMESTAMP_NTZ)", "ts"),
        ("u3", "TRY_TO_TIMESTAMP_LTZ(event_type) IS NULL", "true"),
        ("u4", "TRY_TO_TIMESTAMP_TZ(event_type) IS NULL", "true"),
    ]),
    ("fn_text_databricks", "databricks", "c_custkey", "customer", None, False, [
        ("s1", "HEX(BINARY(c_name))", "hex(c_name)"),
        ("s2", "HEX(ENCODE(c_name, 'UTF-8'))", "hex(c_name)"),
        ("s3", "DECODE(ENCODE(c_name, 'UTF-8'), 'UTF-8')", "c_name"),
        ("s4", "BASE64(ENCODE(c_name, 'UTF-8'))", "base64(encode(c_name))"),
        ("s5", "CAST(UNBASE64(BASE64(ENCODE(c_name, 'UTF-8'))) AS STRING)", "c_name"),
        ("s6", "BIN(c_custkey)", "bin(c_custkey)"),
        ("s7", "HEX(c_custkey)", "upper(to_hex(c_custkey))"),
        ("s8", "LCASE(c_name)", "lower(c_name)"),
        ("s9", "LEFT(c_name, 3)", "left(c_name, 3)"),
        ("s10", "RIGHT(c_name, 4)", "right(c_name, 4)"),
        ("s11", "REPEAT(c_mktsegment, 2)", "repeat(c_mktsegment, 2)"),
        ("s12", "RTRIM(c_name || '  ') || SPACE(2)", "rtrim(c_name || '  ') || '  '"),
        ("s13", "RTRIM('G', c_mktsegment)", "rtrim(c_mktsegment, 'G')"),
        ("s14", "CONCAT_WS('-', c_name, c_mktsegment)", "concat_ws('-', c_name, c_mktsegment)"),
        ("s15", "PRINTF('%05d|%s', c_nationkey, c_mktsegment)", "printf('%05d|%s', c_nationkey, c_mktsegment)"),
        ("s16", "BIT_LENGTH(c_mktsegment)", "CAST(bit_length(c_mktsegment) AS INT)"),
        ("s17", "HEX(TO_BINARY(c_name, 'UTF-8'))", "hex(c_name)"),
        ("s18", "TRY_TO_BINARY(c_name, 'HEX') IS NULL", "true"),
        ("s19", "SUBSTRING(c_name, 3, 4)", "substring(c_name, 3, 4)"),
        ("s20", "CHAR_LENGTH(c_name) + CHARACTER_LENGTH(c_mktsegment)", "CAST(length(c_name) + length(c_mktsegment) AS INT)"),
        ("s21", "STARTSWITH(c_name, 'Cust') AND ENDSWITH(c_name, '1')", "starts_with(c_name, 'Cust') AND ends_with(c_name, '1')"),
        ("s22", "FIND_IN_SET(c_mktsegment, 'BUILDING,FURNITURE')", "CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 ELSE 0 END AS INT)"),
        ("s23", "LEVENSHTEIN(c_mktsegment, 'MACHINE')", "CAST(levenshtein(c_mktsegment, 'MACHINE') AS INT)"),
        ("s24", "SUBSTRING_INDEX(c_name, '#', 1)", "split_part(c_name, '#', 1)"),
        ("s25", "LOCATE('0', c_name)", "CAST(instr(c_name, '0') AS INT)"),
        ("s26", "REGEXP_LIKE(c_mktsegment, 'B.*G')", "regexp_matches(c_mktsegment, 'B.*G')"),
    ]),
    ("fn_text_bigquery", "bigquery", "c_custkey", "customer", None, False, [
        ("s1", "LEFT(c_name, 3)", "left(c_name, 3)"),
        ("s2", "RIGHT(c_name, 4)", "right(c_name, 4)"),
        ("s3", "REPEAT(c_mktsegment, 2)", "repeat(c_mktsegment, 2)"),
        ("s4", "SUBSTRING(c_name, 3, 4)", "substring(c_name, 3, 4)"),
        ("s5", "ASCII(c_mktsegment)", "CAST(ascii(c_mktsegment) AS INT)"),
        ("s6", "RTRIM(c_mktsegment, 'G')", "rtrim(c_mktsegment, 'G')"),
        ("s7", "LTRIM(c_mktsegment, 'B')", "ltrim(c_mktsegment, 'B')"),
        ("s8", "TRIM(c_mktsegment, 'BG')", "trim(c_mktsegment, 'BG')"),
        ("s9", "COLLATE(c_mktsegment, 'und:ci') = LOWER(c_mktsegment)", "true"),
        ("s10", "TO_HEX(FROM_BASE64(TO_BASE64(CAST(c_name AS BYTES))))", "lower(hex(c_name))"),
        ("s11", "LENGTH(GENERATE_UUID())", "CAST(36 AS INT)"),
        ("s12", "RAND() BETWEEN 0 AND 1", "true"),
        ("s13", "CHAR_LENGTH(c_name) + CHARACTER_LENGTH(c_name)", "CAST(2 * length(c_name) AS INT)"),
        ("s14", "OCTET_LENGTH(c_name)", "CAST(strlen(c_name) AS INT)"),
        ("s15", "UNICODE(c_mktsegment)", "CAST(unicode(c_mktsegment) AS INT)"),
        ("s16", "EDIT_DISTANCE(c_mktsegment, 'MACHINE')", "CAST(levenshtein(c_mktsegment, 'MACHINE') AS INT)"),
        ("s17", "CONTAINS_SUBSTR(c_mktsegment, 'build')", "contains(lower(c_mktsegment), 'build')"),
        ("s18", "INSTR(c_name, '0')", "CAST(instr(c_name, '0') AS INT)"),
        ("s19", "STRPOS(c_name, '#')", "CAST(instr(c_name, '#') AS INT)"),
        ("s20", "STARTS_WITH(c_name, 'Cust') AND ENDS_WITH(c_name, '1')", "starts_with(c_name, 'Cust') AND ends_with(c_name, '1')"),
        ("s21", "NVL(NULLIF(c_mktsegment, 'BUILDING'), 'none')", "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none')"),
        ("s22", "IF(c_acctbal > 0, 'plus', 'minus')", "CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END"),
        ("s23", "CODE_POINTS_TO_STRING(TO_CODE_POINTS(c_mktsegment))", "c_mktsegment"),
        ("s24", "FORMAT('%d-%s', c_nationkey, c_mktsegment)", "printf('%d-%s', c_nationkey, c_mktsegment)"),
        ("s25", "TO_JSON_STRING(STRUCT(c_custkey AS k))", "'{\"k\":' || c_custkey || '}'"),
        ("s26", "TO_JSON(STRUCT(c_nationkey AS n))", "'{\"n\":' || c_nationkey || '}'"),
        ("s27", "BYTE_LENGTH(c_name)", "CAST(strlen(c_name) AS INT)"),
    ]),
    ("fn_text_snowflake", "snowflake", "c_custkey", "customer", None, False, [
        ("s1", "'[' || SPACE(3) || ']'", "'[   ]'"),
        ("s2", "TO_VARCHAR(TO_BINARY(c_name, 'UTF-8'), 'UTF-8')", "c_name"),
        ("s3", "TRY_TO_BINARY(c_name, 'HEX') IS NULL", "true"),
        ("s4", "TRY_TO_NUMERIC(c_mktsegment) IS NULL", "true"),
        ("s5", "RANDOM() IS NOT NULL", "true"),
        ("s6", "ARRAY_SIZE(ARRAY_CAT(ARRAY_CONSTRUCT(c_custkey), ARRAY_CONSTRUCT(1, 2)))", "CAST(3 AS INT)"),
        ("s7", "INSERT(c_name, 1, 4, 'x')", "'x' || substring(c_name, 5)"),
        ("s8", "CONTAINS(c_mktsegment, 'UIL')", "contains(c_mktsegment, 'UIL')"),
        ("s9", "OCTET_LENGTH(c_name) + BIT_LENGTH(c_name)", "CAST(9 * strlen(c_name) AS INT)"),
        ("s10", "REGEXP_LIKE(c_mktsegment, 'B.*')", "regexp_full_match(c_mktsegment, 'B.*')"),
        ("s11", "STRTOK(c_name, '#', 2)", "split_part(c_name, '#', 2)"),
        ("s12", "IFF(c_acctbal > 0, 1, 0)", "CAST(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS INT)"),
        ("s13", "ZEROIFNULL(NULLIFZERO(c_nationkey))", "CAST(c_nationkey AS INT)"),
        ("s14", "SPLIT_PART(c_name, '#', 1)", "split_part(c_name, '#', 1)"),
        ("s15", "UPPER(LEFT(c_name, 2)) || RIGHT(c_name, 2)", "upper(left(c_name, 2)) || right(c_name, 2)"),
        ("s16", "TO_DOUBLE(CAST(c_nationkey AS VARCHAR))", "CAST(c_nationkey AS DOUBLE)"),
        ("s17", "TRY_TO_DOUBLE(c_mktsegment)", "CAST(NULL AS DOUBLE)"),
        ("s18", "ARRAY_TO_STRING(ARRAY_SORT(ARRAY_CONSTRUCT(c_nationkey, 3, 7)), ',')", "array_to_string(list_sort([c_nationkey, 3, 7]), ',')"),
        ("s19", "ARRAYS_OVERLAP(ARRAY_CONSTRUCT(c_nationkey), ARRAY_CONSTRUCT(1, 2, 3))", "c_nationkey IN (1, 2, 3)"),
        ("s20", "ARRAY_MIN(ARRAY_CONSTRUCT(c_nationkey, 9))", "CAST(least(c_nationkey, 9) AS INT)"),
    ]),
    ("fn_numbers", "bigquery", "c_custkey", "customer", None, False, [
        ("n1", "ROUND(ACOS(c_acctbal / 20000), 9)", "round(acos(c_acctbal / 20000), 9)"),
        ("n2", "ROUND(ASIN(c_acctbal / 20000), 9)", "round(asin(c_acctbal / 20000), 9)"),
        ("n3", "ROUND(ATAN(c_acctbal), 9)", "round(atan(c_acctbal), 9)"),
        ("n4", "ROUND(COS(c_acctbal), 9)", "round(cos(c_acctbal), 9)"),
        ("n5", "ROUND(TAN(c_acctbal / 20000), 9)", "round(tan(c_acctbal / 20000), 9)"),
        ("n6", "ROUND(COT(c_acctbal / 20000 + 2), 9)", "round(cot(c_acctbal / 20000 + 2), 9)"),
        ("n7", "ROUND(EXP(c_acctbal / 20000), 9)", "round(exp(c_acctbal / 20000), 9)"),
        ("n8", "ROUND(LN(ABS(c_acctbal) + 1), 9)", "round(ln(abs(c_acctbal) + 1), 9)"),
        ("n9", "ROUND(LOG10(ABS(c_acctbal) + 1), 9)", "round(log10(abs(c_acctbal) + 1), 9)"),
        ("n10", "CAST(CEIL(c_acctbal) AS INT64)", "CAST(ceil(c_acctbal) AS BIGINT)"),
        ("n11", "CAST(CEILING(c_acctbal) AS INT64)", "CAST(ceil(c_acctbal) AS BIGINT)"),
        ("n12", "CAST(FLOOR(c_acctbal) AS INT64)", "CAST(floor(c_acctbal) AS BIGINT)"),
        ("n13", "ROUND(CBRT(c_acctbal), 9)", "round(cbrt(c_acctbal), 9)"),
        ("n14", "SAFE_ADD(c_custkey, 1) + SAFE_SUBTRACT(c_custkey, 1) + SAFE_MULTIPLY(c_custkey, 2)", "CAST(4 * c_custkey AS BIGINT)"),
        ("n15", "POW(c_nationkey, 2)", "CAST(pow(c_nationkey, 2) AS DOUBLE)"),
        ("n16", "LEAST(c_acctbal, 100.0)", "least(c_acctbal, 100.0)"),
        ("n17", "IEEE_DIVIDE(c_acctbal, 4)", "c_acctbal / 4"),
        ("n18", "BIT_COUNT(c_custkey)", "CAST(bit_count(c_custkey) AS INT)"),
        ("n19", "IS_INF(c_acctbal) OR IS_NAN(c_acctbal)", "isinf(c_acctbal) OR isnan(c_acctbal)"),
    ]),
    ("fn_numbers_warehouse", "snowflake", "n_nationkey", "nation", None, False, [
        ("n1", "FACTORIAL(n_regionkey)", "CAST(factorial(n_regionkey) AS BIGINT)"),
        ("n2", "DIV0NULL(n_nationkey, n_regionkey)", "CASE WHEN n_regionkey = 0 THEN 0 ELSE n_nationkey / n_regionkey END"),
        ("n3", "ROUND(DEGREES(n_nationkey), 6)", "round(degrees(n_nationkey), 6)"),
        ("n4", "ROUND(RADIANS(n_nationkey), 6)", "round(radians(n_nationkey), 6)"),
    ]),
    ("fn_numbers_redshift", "redshift", "n_nationkey", "nation", None, False, [
        ("n1", "ROUND(PI() * n_nationkey, 8)", "round(pi() * n_nationkey, 8)"),
        ("n2", "ROUND(DEGREES(n_nationkey), 6)", "round(degrees(n_nationkey), 6)"),
        ("n3", "ROUND(RADIANS(n_nationkey), 6)", "round(radians(n_nationkey), 6)"),
        ("n4", "ROUND(DLOG10(n_nationkey + 1), 8)", "round(log10(n_nationkey + 1), 8)"),
        ("n5", "RANDOM() BETWEEN 0 AND 1", "true"),
        ("n6", "STRTOL(CAST(n_nationkey AS VARCHAR), 16)", "CAST(('0x' || n_nationkey) AS BIGINT)"),
        ("n7", "CONVERT(VARCHAR, n_nationkey)", "CAST(n_nationkey AS VARCHAR)"),
        ("n8", "TEXTLEN(n_name) + LEN(n_name)", "CAST(2 * length(n_name) AS INT)"),
        ("n9", "OCTETINDEX('_', n_name)", "CAST(instr(n_name, '_') AS INT)"),
    ]),
    ("fn_compare_redshift", "redshift", "o_orderkey", "orders", None, False, [
        ("c1", "DATE_CMP(CAST(o_orderdate AS DATE), DATE '1996-01-01')", "CAST(CASE WHEN o_orderdate < DATE '1996-01-01' THEN -1 WHEN o_orderdate > DATE '1996-01-01' THEN 1 ELSE 0 END AS INT)"),
        ("c2", "DATE_CMP_TIMESTAMPTZ(CAST(o_orderdate AS DATE), TIMESTAMPTZ '1996-01-01 00:00:00+00')", "CAST(CASE WHEN o_orderdate < DATE '1996-01-01' THEN -1 WHEN o_orderdate > DATE '1996-01-01' THEN 1 ELSE 0 END AS INT)"),
        ("c3", "TIMESTAMP_CMP_TIMESTAMPTZ(o_orderdate, TIMESTAMPTZ '1996-01-01 00:00:00+00')", "CAST(CASE WHEN o_orderdate < DATE '1996-01-01' THEN -1 WHEN o_orderdate > DATE '1996-01-01' THEN 1 ELSE 0 END AS INT)"),
        ("c4", "TIMESTAMPTZ_CMP_DATE(TIMESTAMPTZ '1996-01-01 00:00:00+00', CAST(o_orderdate AS DATE))", "CAST(CASE WHEN o_orderdate < DATE '1996-01-01' THEN 1 WHEN o_orderdate > DATE '1996-01-01' THEN -1 ELSE 0 END AS INT)"),
        ("c5", "TIMESTAMPTZ_CMP_TIMESTAMP(TIMESTAMPTZ '1996-01-01 00:00:00+00', o_orderdate)", "CAST(CASE WHEN o_orderdate < DATE '1996-01-01' THEN 1 WHEN o_orderdate > DATE '1996-01-01' THEN -1 ELSE 0 END AS INT)"),
        ("c6", "TIMESTAMP_CMP(o_orderdate, TIMESTAMP '1996-01-01 00:00:00')", "CAST(CASE WHEN o_orderdate < DATE '1996-01-01' THEN -1 WHEN o_orderdate > DATE '1996-01-01' THEN 1 ELSE 0 END AS INT)"),
        ("c7", "DATE_PART_YEAR(CAST(o_orderdate AS DATE))", "CAST(year(o_orderdate) AS INT)"),
        ("c8", "BPCHARCMP(o_orderpriority, '3-MEDIUM')", "CAST(CASE WHEN o_orderpriority < '3-MEDIUM' THEN -1 WHEN o_orderpriority > '3-MEDIUM' THEN 1 ELSE 0 END AS INT)"),
    ]),
    ("fn_json_redshift", "redshift", "event_id", "events", None, False, [
        ("j1", "JSON_SERIALIZE(JSON_PARSE(props))", "json(props)"),
        ("j2", "CAST(JSON_SERIALIZE_TO_VARBYTE(JSON_PARSE(props)) AS VARCHAR)", "json(props)"),
        ("j3", "CAN_JSON_PARSE(event_type)", "json_valid(event_type)"),
        ("j4", "IS_VALID_JSON_ARRAY(props)", "false"),
    ]),
    ("fn_json_databricks", "databricks", "event_id", "events", None, False, [
        ("j1", "ARRAY_JOIN(JSON_OBJECT_KEYS(props), ',')", "array_to_string(json_keys(props), ',')"),
        ("j2", "FROM_JSON(props, 'k INT').k", "CAST(json_extract(props, '$.k') AS INT)"),
        ("j3", "TO_JSON(NAMED_STRUCT('e', event_type))", "'{\"e\":\"' || event_type || '\"}'"),
        ("j4", "SCHEMA_OF_JSON('{\"a\": 1}')", "'STRUCT<a: BIGINT>'"),
    ]),
    ("agg_moments", "databricks", "l_returnflag", "lineitem", None, True, [
        ("a1", "ROUND(KURTOSIS(l_quantity), 6)", "round(kurtosis_pop(l_quantity), 6)"),
        ("a2", "ROUND(SKEWNESS(l_extendedprice), 6)", "round(skewness(l_extendedprice) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 6)"),
        ("a3", "ROUND(STD(l_quantity), 6)", "round(stddev_samp(l_quantity), 6)"),
        ("a4", "ROUND(STDDEV_POP(l_quantity), 6)", "round(stddev_pop(l_quantity), 6)"),
        ("a5", "ROUND(STDDEV_SAMP(l_quantity), 6)", "round(stddev_samp(l_quantity), 6)"),
        ("a6", "ROUND(VAR_POP(l_quantity), 6)", "round(var_pop(l_quantity), 6)"),
        ("a7", "ROUND(VAR_SAMP(l_quantity), 6)", "round(var_samp(l_quantity), 6)"),
        ("a8", "ROUND(COVAR_SAMP(l_quantity, l_discount), 6)", "round(covar_samp(l_quantity, l_discount), 6)"),
        ("a9", "MIN(l_quantity)", "min(l_quantity)"),
        ("a10", "MAX(l_quantity)", "max(l_quantity)"),
        ("a11", "ROUND(REGR_AVGX(l_quantity, l_tax), 6)", "round(regr_avgx(l_quantity, l_tax), 6)"),
        ("a12", "ROUND(REGR_AVGY(l_quantity, l_tax), 6)", "round(regr_avgy(l_quantity, l_tax), 6)"),
        ("a13", "ROUND(REGR_SXX(l_quantity, l_tax), 4)", "round(regr_sxx(l_quantity, l_tax), 4)"),
        ("a14", "ROUND(REGR_SXY(l_quantity, l_tax), 3)", "round(regr_sxy(l_quantity, l_tax), 3)"),
        ("a15", "ROUND(REGR_SYY(l_quantity, l_tax), 2)", "round(regr_syy(l_quantity, l_tax), 2)"),
        ("a16", "BIT_AND(l_orderkey)", "CAST(bit_and(l_orderkey) AS BIGINT)"),
        ("a17", "BIT_OR(l_orderkey)", "CAST(bit_or(l_orderkey) AS BIGINT)"),
        ("a18", "BIT_XOR(l_orderkey)", "CAST(bit_xor(l_orderkey) AS BIGINT)"),
        ("a19", "BOOL_AND(l_quantity > 0)", "bool_and(l_quantity > 0)"),
        ("a20", "BOOL_OR(l_quantity > 49)", "bool_or(l_quantity > 49)"),
        ("a21", "ROUND(TRY_AVG(l_quantity), 6)", "round(avg(l_quantity), 6)"),
        ("a22", "ROUND(MEAN(l_quantity), 6)", "round(avg(l_quantity), 6)"),
        ("a23", "SIZE(COLLECT_LIST(l_orderkey))", "CAST(count(*) AS INT)"),
        ("a24", "APPROX_PERCENTILE(l_quantity, 0.5, 100000)", "quantile_disc(l_quantity, 0.5)"),
        ("a25", "PERCENTILE_APPROX(l_quantity, 0.25, 100000)", "quantile_disc(l_quantity, 0.25)"),
        ("a26", "PERCENTILE(l_quantity, 0.3)", "quantile_cont(l_quantity, 0.3)"),
        ("a27", "SIZE(COLLECT_SET(l_linenumber))", "CAST(count(DISTINCT l_linenumber) AS INT)"),
        ("a28", "TRY_SUM(l_linenumber)", "CAST(sum(l_linenumber) AS BIGINT)"),
        ("a29", "COUNT_IF(l_tax > 0.05)", "CAST(count(*) FILTER (WHERE l_tax > 0.05) AS BIGINT)"),
        ("a30", "MIN_BY(l_orderkey, l_extendedprice * 1000000 + l_orderkey) IS NOT NULL", "true"),
    ]),
    ("agg_warehouse", "snowflake", "l_linestatus", "lineitem", None, True, [
        ("a1", "ROUND(KURTOSIS(l_quantity), 6)", "round(kurtosis_pop(l_quantity), 6)"),
        ("a2", "ROUND(SKEW(l_extendedprice), 6)", "round(skewness(l_extendedprice) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 6)"),
        ("a3", "ROUND(STDDEV(l_quantity), 6)", "round(stddev_samp(l_quantity), 6)"),
        ("a4", "COUNT_IF(l_tax > 0.05)", "CAST(count(*) FILTER (WHERE l_tax > 0.05) AS BIGINT)"),
        ("a5", "ARRAY_SIZE(ARRAY_UNIQUE_AGG(l_linenumber))", "CAST(count(DISTINCT l_linenumber) AS INT)"),
        ("a6", "ROUND(MEDIAN(l_quantity), 6)", "round(median(l_quantity), 6)"),
        ("a7", "MODE(l_linestatus)", "l_linestatus"),
    ]),
    ("agg_redshift", "redshift", "l_returnflag", "lineitem", None, True, [
        ("a1", "APPROXIMATE PERCENTILE_DISC(0.5) WITHIN GROUP (ORDER BY l_quantity)", "quantile_disc(l_quantity, 0.5)"),
        ("a2", "ABS(APPROXIMATE COUNT(DISTINCT l_linenumber) - COUNT(DISTINCT l_linenumber)) <= 1", "true"),
    ]),
    ("agg_bigquery_lists", "bigquery", "n_regionkey", "nation", None, True, [
        ("a1", "STRING_AGG(n_name, '/' ORDER BY n_name LIMIT 2)", "array_to_string(list_sort(list(n_name))[1:2], '/')"),
        ("a2", "ARRAY_TO_STRING(ARRAY_AGG(NULLIF(n_name, 'NATION_3') IGNORE NULLS ORDER BY n_nationkey DESC LIMIT 3), '/')", "array_to_string(list(n_name ORDER BY n_nationkey DESC) FILTER (WHERE n_name <> 'NATION_3')[1:3], '/')"),
        ("a3", "ARRAY_TO_STRING(ARRAY_AGG(n_name ORDER BY n_name), ',')", "string_agg(n_name, ',' ORDER BY n_name)"),
        ("a4", "APPROX_QUANTILES(n_nationkey, 2)[OFFSET(1)]", "CAST(quantile_disc(n_nationkey, 0.5) AS INT)"),
        ("a5", "ANY_VALUE(n_regionkey)", "CAST(n_regionkey AS INT)"),
        ("a6", "ARRAY_LENGTH(ARRAY_CONCAT_AGG([n_name, 'x']))", "CAST(2 * count(*) AS INT)"),
    ]),
    ("now_functions", "bigquery", "r_regionkey", "region", None, False, [
        ("n1", "CURRENT_DATE() = DATE(CURRENT_TIMESTAMP())", "true"),
        ("n2", "CURRENT_DATETIME() IS NOT NULL AND CURRENT_TIME() IS NOT NULL", "true"),
        ("n3", "DATE_DIFF(CURRENT_DATE('UTC'), DATE '2020-01-01', DAY) > 0", "true"),
    ]),
    ("now_functions_others", "databricks", "r_regionkey", "region", None, False, [
        ("n1", "CURDATE() = TO_DATE(NOW())", "true"),
        ("n2", "GETDATE() = CURRENT_TIMESTAMP()", "true"),
        ("n3", "CURRENT_TIMEZONE()", "'UTC'"),
    ]),
    ("now_functions_redshift", "redshift", "r_regionkey", "region", None, False, [
        ("n1", "LEN(TIMEOFDAY()) > 20", "true"),
        ("n2", "SYSDATE IS NOT NULL AND GETDATE() IS NOT NULL", "true"),
    ]),
    ("geo_round_trips", "redshift", "c_custkey", "customer", None, False, [
        ("g1", "ST_X(ST_GEOMFROMWKB(ST_ASBINARY(ST_MAKEPOINT(c_nationkey, 2))))", "CAST(c_nationkey AS DOUBLE)"),
        ("g2", "ST_Y(ST_GEOMFROMEWKB(ST_ASEWKB(ST_MAKEPOINT(1, c_nationkey))))", "CAST(c_nationkey AS DOUBLE)"),
        ("g3", "ST_LENGTH2D(ST_GEOMFROMTEXT('LINESTRING(0 0,3 4,' || (c_nationkey + 3) || ' 4)'))", "CAST(c_nationkey + 5 AS DOUBLE)"),
        ("g4", "ST_PERIMETER2D(ST_GEOMFROMTEXT('POLYGON((0 0,' || (c_nationkey + 1) || ' 0,' || (c_nationkey + 1) || ' 1,0 1,0 0))'))", "CAST(2 * (c_nationkey + 2) AS DOUBLE)"),
        ("g5", "ST_AREA(ST_GEOMFROMTEXT('POLYGON((0 0,' || (c_nationkey + 1) || ' 0,' || (c_nationkey + 1) || ' 1,0 1,0 0))'))", "CAST(c_nationkey + 1 AS DOUBLE)"),
        ("g6", "ST_X(ST_GEOMFROMGEOJSON('{\"type\":\"Point\",\"coordinates\":[' || c_nationkey || ',5]}'))", "CAST(c_nationkey AS DOUBLE)"),
        ("g7", "ST_ASHEXWKB(ST_MAKEPOINT(0, 0))", "'010100000000000000000000000000000000000000'"),
        ("g8", "ST_DISTANCE(ST_MAKEPOINT(0, 0), ST_MAKEPOINT(3, c_nationkey))", "sqrt(9 + c_nationkey * c_nationkey)"),
        ("g9", "ST_NPOINTS(ST_GEOMFROMTEXT('LINESTRING(0 0,3 4,5 ' || c_nationkey || ')'))", "CAST(3 AS INT)"),
        ("g10", "ST_X(ST_CENTROID(ST_GEOMFROMTEXT('LINESTRING(0 0,' || c_nationkey * 2 || ' 0)')))", "CAST(c_nationkey AS DOUBLE)"),
    ]),
    ("geo_overlays", "redshift", "c_custkey", "(SELECT c_custkey, ST_MAKEENVELOPE(0, 0, c_nationkey + 2, 2) AS a, ST_MAKEENVELOPE(1, 1, c_nationkey + 4, 3) AS b FROM customer) AS t", "customer", False, [
        ("g1", "ROUND(ST_AREA(ST_UNION(a, b)), 6)", "CAST((c_nationkey + 2) * 2 + (c_nationkey + 3) * 2 - (c_nationkey + 1) AS DOUBLE)"),
        ("g2", "ROUND(ST_AREA(ST_INTERSECTION(a, b)), 6)", "CAST(c_nationkey + 1 AS DOUBLE)"),
        ("g3", "ROUND(ST_AREA(ST_DIFFERENCE(a, b)), 6)", "CAST((c_nationkey + 2) * 2 - (c_nationkey + 1) AS DOUBLE)"),
        ("g4", "ABS(ST_AREA(ST_BUFFER(a, 1)) - ST_AREA(a) - ST_PERIMETER(a) - 3.14) < 0.05", "true"),
    ]),
    ("geo_union_agg", "redshift", "c_mktsegment", "customer", None, True, [
        ("g1", "ROUND(ST_AREA(ST_UNION(ST_MAKEENVELOPE(c_nationkey, 0, c_nationkey + 1, 1))), 6)", "CAST(count(DISTINCT c_nationkey) AS DOUBLE)"),
    ]),
    ("geo_round_trips_bigquery", "bigquery", "c_custkey", "customer", None, False, [
        ("g1", "ST_X(ST_GEOGFROMWKB(ST_ASBINARY(ST_GEOGPOINT(c_nationkey, 2))))", "CAST(c_nationkey AS DOUBLE)"),
        ("g2", "ST_NUMPOINTS(ST_GEOGFROMTEXT('LINESTRING(0 0,3 4,5 ' || c_nationkey || ')'))", "CAST(3 AS INT)"),
        ("g3", "ST_ASGEOJSON(ST_GEOGPOINT(c_nationkey, 2)) LIKE '%coordinates%'", "true"),
        ("g4", "ST_Y(ST_CENTROID(ST_GEOGFROMTEXT('LINESTRING(0 0,0 ' || c_nationkey * 2 || ')')))", "CAST(c_nationkey AS DOUBLE)"),
    ]),
    ("geo_round_trips_snowflake", "snowflake", "c_custkey", "customer", None, False, [
        (f"g{k}", f"ST_X({f}(ST_ASWKB(ST_MAKEPOINT(c_nationkey, 2))))", "CAST(c_nationkey AS DOUBLE)") for k, f in enumerate(("ST_GEOMETRYFROMWKB", "ST_GEOMFROMWKB", "ST_GEOMETRYFROMEWKB", "ST_GEOMFROMEWKB"))
    ] + [
        (f"h{k}", f"ST_X({f}('POINT(' || c_nationkey || ' 2)'))", "CAST(c_nationkey AS DOUBLE)")
        for k, f in enumerate(("ST_GEOMFROMWKT", "ST_GEOMETRYFROMEWKT", "ST_GEOMFROMEWKT", "ST_GEOMETRYFROMTEXT", "ST_GEOMFROMTEXT", "ST_GEOMETRYFROMWKT"))
    ]),
]

#: (name, dialect, query, oracle)
WHOLE: list[tuple[str, str, str, str | None]] = [
    ("win_ordered_lists", "bigquery", "SELECT n_nationkey, ARRAY_TO_STRING(ARRAY_AGG(n_name ORDER BY n_name) OVER (PARTITION BY n_regionkey), ',') AS a, STRING_AGG(n_name, '-' ORDER BY n_nationkey DESC) OVER (PARTITION BY n_regionkey) AS s FROM nation", "SELECT n_nationkey, string_agg(n_name, ',' ORDER BY n_name) OVER (PARTITION BY n_regionkey) AS a, string_agg(n_name, '-' ORDER BY n_nationkey DESC) OVER (PARTITION BY n_regionkey) AS s FROM nation"),
    ("win_listagg", "redshift", "SELECT n_nationkey, LISTAGG(n_name, '|') WITHIN GROUP (ORDER BY n_nationkey) OVER (PARTITION BY n_regionkey) AS s FROM nation", "SELECT n_nationkey, string_agg(n_name, '|' ORDER BY n_nationkey) OVER (PARTITION BY n_regionkey) AS s FROM nation"),
    ("win_arrayagg", "snowflake", "SELECT n_nationkey, ARRAY_TO_STRING(ARRAYAGG(n_name) WITHIN GROUP (ORDER BY n_nationkey DESC) OVER (PARTITION BY n_regionkey), '|') AS s FROM nation", "SELECT n_nationkey, string_agg(n_name, '|' ORDER BY n_nationkey DESC) OVER (PARTITION BY n_regionkey) AS s FROM nation"),
    ("agg_listagg_distinct", "redshift", "SELECT l_returnflag, LISTAGG(DISTINCT l_linestatus, '+') WITHIN GROUP (ORDER BY l_linestatus) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, string_agg(DISTINCT l_linestatus, '+' ORDER BY l_linestatus) AS s FROM lineitem GROUP BY l_returnflag"),
    ("win_named", "any", "SELECT o_orderkey, SUM(o_totalprice) OVER w AS s, COUNT(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", None),
    ("lateral_view", "databricks", "SELECT n_nationkey, x FROM nation LATERAL VIEW explode(sequence(0, n_regionkey)) v AS x WHERE x > 0", "SELECT n_nationkey, CAST(x AS INT) AS x FROM nation, unnest(range(0, n_regionkey + 1)) AS u(x) WHERE x > 0"),
    ("json_literals", "bigquery", "SELECT r_regionkey, BOOL(JSON 'true') AS b, INT64(JSON '10') + r_regionkey AS i, FLOAT64(JSON '9.5') AS f, STRING(JSON '\"x\"') AS s, JSON_VALUE(JSON '{\"a\": {\"b\": 7}}', '$.a.b') AS v, LAX_INT64(JSON '3') AS l FROM region", "SELECT r_regionkey, true AS b, CAST(json_extract('10', '$') AS BIGINT) + r_regionkey AS i, 9.5::DOUBLE AS f, json_extract_string('\"x\"', '$') AS s, json_extract_string('{\"a\": {\"b\": 7}}', '$.a.b') AS v, CAST(3 AS BIGINT) AS l FROM region"),
    ("select_as_value", "bigquery", "SELECT AS VALUE STRUCT(n_nationkey AS k, n_name AS n) FROM nation", "SELECT n_nationkey AS k, n_name AS n FROM nation"),
    ("sample_all", "any", "SELECT n_nationkey FROM nation TABLESAMPLE SYSTEM (100 PERCENT)", "SELECT n_nationkey FROM nation"),
    ("grouping_id", "snowflake", "SELECT l_returnflag, l_linestatus, CAST(GROUPING_ID(l_returnflag, l_linestatus) AS INT) AS g, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS INT) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    ("timestamp_diff", "bigquery", "SELECT event_id, TIMESTAMP_DIFF(ts, TIMESTAMP '2024-01-01 00:30:00+00', HOUR) AS h, TIMESTAMP_DIFF(ts, TIMESTAMP '2024-01-01 00:30:00+00', DAY) AS d FROM events", "SELECT event_id, CAST(trunc(epoch_us(ts) / 3600000000.0 - epoch_us(TIMESTAMP '2024-01-01 00:30:00') / 3600000000.0) AS BIGINT) AS h, date_sub('day', TIMESTAMP '2024-01-01 00:30:00', ts) AS d FROM events"),
    ("seq_generator", "snowflake", "SELECT SEQ4() AS n FROM TABLE(GENERATOR(ROWCOUNT => 50))", "SELECT range AS n FROM range(50)"),
    ("ifplus_macro", "any", "SELECT n_nationkey, IFPLUS(n_regionkey, 0, 10) AS p FROM nation", "SELECT n_nationkey, CAST(CASE n_regionkey WHEN 0 THEN 0 ELSE n_regionkey + 10 END AS INT) AS p FROM nation"),
]


def queries() -> list[tuple[str, str, str, str | None]]:
    """(name, dialect, query, oracle; None: the query itself)."""
    found = []
    for name, dialect, keys, source, other, grouped, items in GROUPS:
        of = lambda k, end: f"SELECT {keys}, " + ", ".join(f"{x[k]} AS {x[0]}" for x in items) + f" FROM {end}" + f" GROUP BY {keys}" * grouped
        found.append((name, dialect, of(1, source), of(2, other or source)))
    return found + WHOLE
