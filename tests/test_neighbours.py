"""P10: neighbours that no dialect allows, and statements that look like them and are valid."""

import pytest
from pyspark.sql import functions as F

from sqltrail.operators import tokens as tk
from sqltrail.operators.neighbours import class_text
from sqltrail.plans.statements import clean_statements

BROKEN = [
    "SELECT a b c FROM t",
    "SELECT x, a b c FROM t",
    "SELECT DISTINCT a b c, d FROM t",
    "SELECT a 5 FROM t",
    "SELECT , a FROM t",
    "SELECT a FRM t",
    "SELECT a AS, b FROM t",
    "SELECT (a AS) FROM t",
    "SELECT a FROM t u v",
    "SELECT a FROM t u v WHERE b = 1",
    "SELECT a FROM t, s u v ORDER BY a",
    "SELECT a FROM t JOIN s u v ON t.k = u.k",
    "SELECT a FROM t JION s ON t.k = s.k",
    "SELECT a FROM t JOIN s ON WHERE b = 1",
    "SELECT a FROM t LEFT JOIN WHERE b = 1",
    "SELECT a FROM t GROUP a",
    "SELECT a FROM t WHER b = 1",
    "SELECT a FROM t, WHERE b = 1",
    "SELECT a FROM t WHERE b c",
    "SELECT a FROM t WHERE b c = 1",
    "SELECT a FROM t WHERE b = 1 c",
    "SELECT a FROM t WHERE b 'x' AND c = 1",
    "SELECT a FROM t WHERE AND b = 1",
    "SELECT a FROM t WHERE b = 1 AND OR c = 2",
    "SELECT a FROM t WHERE b = 1 AND ORDER BY a",
    "SELECT a FROM t WHERE b = 1 OR",
    "SELECT a FROM t WHERE = 1",
    "SELECT a FROM t WHERE b = AND c = 1",
    "SELECT a FROM t WHERE b = = 1",
    "SELECT a FROM t WHERE b > ORDER BY a",
    "SELECT a FROM t WHERE b LIKE",
    "SELECT a FROM t WHERE b IN ORDER BY a",
    "SELECT a FROM t WHERE NOT",
    "SELECT a,, b FROM t",
    "SELECT CASE END FROM t",
    "SELECT CASE WHEN THEN 1 END FROM t",
    "SELECT CASE WHEN a = 1 THEN ELSE 2 END FROM t",
    "SELECT CASE WHEN a = 1 THEN 1 ELSE END FROM t",
    "SELECT a FROM t WHERE b = 1 2",
    "SELECT a FROM t GROUP BY a WHERE b = 1",
    "SELECT a FROM t ORDER BY a DESC, f(b) WHERE b = 1",
    "SELECT a FROM t ORDER BY a GROUP BY a",
    "SELECT a WHERE b = 1 FROM t",
    "SELECT a FROM t HAVING",
]
VALID = [
    ("oracle", "SELECT CONNECT_BY_ROOT e.name boss FROM emp e START WITH e.id = 1 CONNECT BY PRIOR e.id = e.boss"),
    ("oracle", "SELECT a FROM t u MODEL PARTITION BY (a) DIMENSION BY (b) MEASURES (c) RULES (c[1] = 2)"),
    ("oracle", "SELECT a FROM t WHERE b > 5 HAVING MAX(a) > 1 GROUP BY a"),
    ("clickhouse", "SELECT a FROM t u FINAL PREWHERE b = 1 WHERE c = 2 FORMAT JSON"),
    ("clickhouse", "SELECT a, s.1.2 FROM t FORMAT JSON"),
    ("clickhouse", "SELECT a FROM t LEFT ARRAY JOIN x WHERE like(a, 'b%') ORDER BY a WITH FILL FROM 1 TO 9"),
    ("mysql", "SELECT SQL_NO_CACHE a b FROM t u USE INDEX (i) WHERE BINARY a = 'x' AND c << 2 > 8"),
    ("mysql", "SELECT DATE \"2020-01-01\" d FROM t ORDER BY `a b` LIMIT 5"),
    ("mysql", "SELECT 'a' 'b' c FROM t STRAIGHT_JOIN u ON t.k = u.k"),
    ("postgres", "SELECT ARRAY[1, 2] x, a[1] y FROM ONLY t u WHERE a SIMILAR TO b AND ~c = 1 AND d @> e AND f >> 1 = 2"),
    ("postgres", "INSERT INTO t SELECT a FROM u ON CONFLICT DO NOTHING"),
    ("postgres", "SELECT DISTINCT ON (a) b c FROM t WHERE a ISNULL OR b NOTNULL ORDER BY a NULLS FIRST"),
    ("postgres", "SELECT a, COUNT(*) FILTER (WHERE b = 1) n FROM t GROUP BY a HAVING COUNT(*) > 1 ORDER BY n"),
    ("tsql", "SELECT TOP (@n) a b FROM t u WITH (NOLOCK) INNER HASH JOIN s ON s.k = u.k WHERE a *= b"),
    ("tsql", "SELECT a FROM [my table] [u v] WHERE b = 1 OPTION (RECOMPILE)"),
    ("tsql", "SET NOCOUNT ON"),
    ("tsql", "CREATE INDEX i ON t (a) WITH (PAD_INDEX = ON, FILLFACTOR = 80)"),
    ("bigquery", "SELECT CAST(a AS ARRAY<STRUCT<x INT64, y STRING>>), SAFE_CAST(b AS ARRAY<INT64>) c FROM t"),
    ("bigquery", "SELECT INTERVAL n DAY x, a BETWEEN 1 AND b c FROM t GROUP BY EXTRACT(YEAR FROM d)"),
    ("snowflake", "SELECT a FROM t AT (OFFSET => -60) u QUALIFY ROW_NUMBER() OVER (PARTITION BY a ORDER BY b) = 1"),
    ("databricks", "SELECT a FROM t VERSION AS OF 3 u LATERAL VIEW explode(x) e AS y WHERE m = MAP<STRING, INT>()"),
    ("hive", "FROM t u INSERT OVERWRITE TABLE o SELECT a b GROUP BY a INSERT INTO p SELECT c WHERE d = 1"),
    ("oracle", "CREATE TABLE t (a DOUBLE PRECISION, b VARCHAR(10) PRIMARY KEY, c CHARACTER VARYING (3))"),
    ("oracle", "SELECT a AS from FROM t"),
    ("oracle", "SELECT TRIM(BOTH x FROM y) z, CASE WHEN a IS NOT NULL THEN b ELSE c END d FROM t WHERE a IS DISTINCT FROM b"),
    ("oracle", "MERGE INTO t USING s ON (t.id = s.id) WHEN MATCHED THEN DELETE WHEN NOT MATCHED THEN INSERT (a) VALUES (1)"),
    ("oracle", "SELECT a FROM t UNION SELECT b FROM u INTERSECT SELECT c FROM v MINUS SELECT d FROM w"),
]


def found(spark, statements):
    rows = spark.createDataFrame([(i, s, d, 1) for i, (d, s) in enumerate(statements)], "stmt int, sql string, dialect string, copies int")
    return {statements[r.stmt][1]: r for r in clean_statements(rows).withColumn("classes", class_text(F.col("tokens"))).collect()}


def test_forbidden_neighbours(spark):
    rows = found(spark, [("oracle", s) for s in BROKEN])
    passed = {s: r.classes for s, r in rows.items() if list(r.parse_errors) != [tk.ERROR_PLACE]}
    assert not passed


def test_valid_neighbours(spark):
    rows = found(spark, VALID)
    assert {s: (r.parse_errors, r.classes) for s, r in rows.items() if r.parse_errors} == {}


@pytest.mark.parametrize("columns", [20_000])
def test_wide_statement(spark, columns):
    wide = "SELECT " + ", ".join(f"f(t.c{i}) AS d{i}" for i in range(columns)) + " FROM t GROUP BY " + ", ".join(f"c{i}" for i in range(columns))
    rows = found(spark, [("oracle", wide), ("oracle", wide + " WHERE a = 1")])
    assert [list(r.parse_errors) for r in rows.values()] == [[], [tk.ERROR_PLACE]]
