"""Queries through the SQL front end, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.sql.engine import SqlEngine

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_TABLES = "region nation customer supplier part orders lineitem events".split()


def _engine(spark: SparkSession, sf_dir: str, text: str) -> SqlEngine:
    engine = SqlEngine(spark)
    for t in _TABLES:
        if t in text:
            engine.execute(f"CREATE OR REPLACE MAPPING {t} TYPE FILE OPTIONS ('format' = 'parquet', 'path' = '{sf_dir}/{t}.parquet')")
    return engine


def query(name: str, sql: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = sql.replace("{dir}", sf_dir)
        return _engine(spark, sf_dir, text).execute(text)

    QUERIES[name] = run
    ORACLES[name] = oracle or sql


query("sql_select_where", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus LIKE 'F%'")
query(
    "sql_group_having",
    "SELECT l_returnflag AS f, COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS sups, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag HAVING COUNT(*) > 10",
)
query("sql_group_expression", "SELECT o_orderkey / 1000 AS thousand, COUNT(*) AS n FROM orders GROUP BY o_orderkey / 1000", "SELECT o_orderkey // 1000 AS thousand, count(*) AS n FROM orders GROUP BY 1")
query("sql_group_ordinal", "SELECT c_mktsegment AS s, COUNT(*) AS n FROM customer GROUP BY 1")
query("sql_select_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
query("sql_sum_types", "SELECT SUM(o_orderkey) AS big, SUM(CAST(o_custkey AS INT)) AS small, ROUND(SUM(o_totalprice), 1) AS d FROM orders", "SELECT sum(o_orderkey)::DECIMAL(38, 0) AS big, sum(o_custkey)::BIGINT AS small, round(sum(o_totalprice), 1) AS d FROM orders")
query("sql_avg_types", "SELECT ROUND(CAST(AVG(l_linenumber) AS DOUBLE), 6) AS a, ROUND(AVG(l_quantity), 6) AS b FROM lineitem", "SELECT round(avg(l_linenumber), 6) AS a, round(avg(l_quantity), 6) AS b FROM lineitem")
query("sql_inner_join", "SELECT o.o_orderkey, c.c_name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey")
query("sql_left_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000")
query("sql_cross_join", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
query("sql_non_equi_join", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
query("sql_comma_join", "SELECT s.s_suppkey, n.n_name FROM supplier s, nation n WHERE s.s_nationkey = n.n_nationkey")
query("sql_using_join", "SELECT n_regionkey, r_name, n_name FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) AS r USING (n_regionkey)")
query("sql_join_chain", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
query("sql_derived_table", "SELECT t.s, t.n * 2 AS twice FROM (SELECT c_mktsegment AS s, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) AS t WHERE t.n > 1")
query("sql_values", "SELECT v.a + 1 AS b, v.s FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v (a, s) WHERE v.a > 1")
query("sql_generate_series", "SELECT v * 2 AS w FROM TABLE(GENERATE_SERIES(1, 9, 2))", "SELECT (generate_series * 2)::INT AS w FROM generate_series(1, 9, 2)")
query("sql_generate_series_down", "SELECT v FROM TABLE(GENERATE_SERIES(start => 5, stop => -5, step => -3))", "SELECT unnest([5, 2, -1, -4]) AS v")
query("sql_parquet_file", "SELECT n_name, n_regionkey FROM TABLE(PARQUET_FILE('{dir}/nation.parquet')) WHERE n_regionkey = 1", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
query("sql_integer_division", "SELECT p_partkey, p_size / 3 AS q, p_size % 3 AS r, p_retailprice / 3 AS d, -p_size / 2 AS neg FROM part", "SELECT p_partkey, p_size // 3 AS q, p_size % 3 AS r, p_retailprice / 3 AS d, -(p_size // 2) AS neg FROM part")
query(
    "sql_math",
    "SELECT l_orderkey, l_linenumber, ROUND(SIN(l_quantity), 6) AS a, ROUND(COS(l_quantity), 6) AS b, ROUND(TAN(l_discount), 6) AS c, ROUND(COT(l_quantity), 6) AS d, ROUND(ACOS(l_discount), 6) AS e, ROUND(ASIN(l_discount), 6) AS f, ROUND(ATAN(l_quantity), 6) AS g, ROUND(EXP(l_discount), 6) AS h, ROUND(LN(l_quantity), 6) AS i, ROUND(LOG10(l_quantity), 6) AS j, ABS(-l_tax) AS k, SIGN(l_tax - l_discount) AS l, ROUND(DEGREES(l_tax), 6) AS m, ROUND(RADIANS(l_quantity), 6) AS n, CEIL(l_extendedprice) AS o, FLOOR(l_extendedprice) AS p, ROUND(PI(), 6) AS q FROM lineitem",
    "SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 6) AS a, round(cos(l_quantity), 6) AS b, round(tan(l_discount), 6) AS c, round(cot(l_quantity), 6) AS d, round(acos(l_discount), 6) AS e, round(asin(l_discount), 6) AS f, round(atan(l_quantity), 6) AS g, round(exp(l_discount), 6) AS h, round(ln(l_quantity), 6) AS i, round(log10(l_quantity), 6) AS j, abs(-l_tax) AS k, sign(l_tax - l_discount)::DOUBLE AS l, round(degrees(l_tax), 6) AS m, round(radians(l_quantity), 6) AS n, ceil(l_extendedprice)::BIGINT AS o, floor(l_extendedprice)::BIGINT AS p, round(pi(), 6) AS q FROM lineitem",
)
query("sql_truncate", "SELECT l_orderkey, l_linenumber, ROUND(TRUNCATE(l_extendedprice, 1), 1) AS t, CAST(TRUNCATE(-l_quantity) AS BIGINT) AS u FROM lineitem", "SELECT l_orderkey, l_linenumber, round(trunc(round(l_extendedprice * 10, 6)) / 10, 1) AS t, trunc(-l_quantity)::BIGINT AS u FROM lineitem")
query(
    "sql_strings",
    "SELECT n_nationkey, ASCII(n_name) AS a, INITCAP(n_name) AS b, CHAR_LENGTH(n_name) AS c, LOWER(n_name) AS d, UPPER(n_name) AS e, n_name || '!' AS f, SUBSTRING(n_name, 2, 3) AS g, LTRIM('  x ') AS h, RTRIM(' x  ') AS i, BTRIM('  x ') AS j, TRIM(BOTH 'A' FROM n_name) AS k, LENGTH(n_name) AS l FROM nation",
    "SELECT n_nationkey, ascii(n_name) AS a, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS b, length(n_name)::INT AS c, lower(n_name) AS d, upper(n_name) AS e, n_name || '!' AS f, substring(n_name, 2, 3) AS g, 'x ' AS h, ' x' AS i, 'x' AS j, trim(n_name, 'A') AS k, length(n_name)::INT AS l FROM nation",
)
query("sql_predicates", "SELECT n_nationkey, (n_regionkey = 1) IS TRUE AS a, (n_regionkey = 1) IS NOT FALSE AS b, NOT (n_regionkey <> 2 OR n_nationkey >= 5) AS c, NULLIF(n_regionkey, 1) IS NULL AS d FROM nation")
query("sql_cast", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS a, CAST(o_orderkey AS VARCHAR) AS b, CAST(o_orderdate AS DATE) AS c, CAST('12' AS INT) AS d FROM orders", "SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS a, o_orderkey::VARCHAR AS b, o_orderdate::DATE AS c, 12 AS d FROM orders")
query("sql_quoted_identifiers", 'SELECT "n_name" AS "Name of it", COUNT(*) AS "n" FROM "nation" GROUP BY "n_name"')


def sql_information_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir, "region nation")
    return engine.execute("SELECT mapping_name, column_name, ordinal_position, data_type FROM information_schema.columns")


QUERIES["sql_information_schema"] = sql_information_schema
ORACLES["sql_information_schema"] = """SELECT * FROM (VALUES ('nation', 'n_nationkey', 1, 'INTEGER'), ('nation', 'n_name', 2, 'VARCHAR'), ('nation', 'n_regionkey', 3, 'INTEGER'), ('region', 'r_regionkey', 1, 'INTEGER'), ('region', 'r_name', 2, 'VARCHAR')) AS t (mapping_name, column_name, ordinal_position, data_type)"""


def sql_show_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir, "region nation customer").execute("SHOW MAPPINGS")


QUERIES["sql_show_mappings"] = sql_show_mappings
ORACLES["sql_show_mappings"] = "SELECT unnest(['customer', 'nation', 'region']) AS name"

query("sql_truncate_exact", "SELECT TRUNCATE(CAST(1.15 AS DOUBLE), 2) AS a, TRUNCATE(CAST(-4.35 AS DOUBLE), 2) AS b, TRUNCATE(9007199254740993) AS c, TRUNCATE(-1250, -2) AS d", "SELECT 1.15::DOUBLE AS a, -4.35::DOUBLE AS b, 9007199254740993::BIGINT AS c, -1200::INT AS d")
query("sql_truncate_digits", "SELECT l_orderkey, l_linenumber, TRUNCATE(CAST(l_extendedprice AS DECIMAL), 1) = TRUNCATE(l_extendedprice, 1) AS same, CAST(TRUNCATE(l_orderkey, -2) AS BIGINT) AS hundreds FROM lineitem", "SELECT l_orderkey, l_linenumber, true AS same, (l_orderkey - l_orderkey % 100)::BIGINT AS hundreds FROM lineitem")
query("sql_decimal_digits", "SELECT CAST(CAST('0.12345678' AS DECIMAL) AS DOUBLE) AS c, CAST(AVG(CAST(CAST(l_linenumber AS DECIMAL(20, 9)) / 1000000 AS DECIMAL(20, 9))) AS DOUBLE) > 0 AS small FROM lineitem", "SELECT 0.12345678::DOUBLE AS c, true AS small")
