import pytest
from pyspark.sql import functions as F

from sqltrail.functions import clean
from sqltrail.sources.statements import normalize_dialect, read_sql_files, statements_from_table

CASES = [
    (clean.remove_comments, "SELECT * FROM users -- comment\nWHERE id = 1", "SELECT * FROM users \nWHERE id = 1"),
    (clean.remove_comments, "  SELECT /* a\nb */ 1 \t", "SELECT  1"),
    # Only a newline ends a line comment.
    (clean.remove_comments, "SELECT 1 -- a\rSELECT 2", "SELECT 1"),
    # Comment marks inside a literal are not spared.
    (clean.remove_comments, "SELECT '--x' FROM t", "SELECT '"),
    (clean.convert_to_cast, "CONVERT(datetime, x, 120)", "CAST(x AS datetime)"),
    (clean.convert_to_cast, "convert( Numeric(10, 2), y)", "CAST(y AS Numeric)"),
    (clean.convert_to_cast, "CONVERT(varchar(10), y)", "CAST(y AS varchar)"),
    (clean.convert_to_cast, "CONVERT(char(10), y)", "CAST(y AS char)"),
    (clean.convert_to_cast, "CONVERT(имя, y)", "CAST(y AS имя)"),
    # The argument runs on to the last bracket before a comma.
    (clean.convert_to_cast, "CONVERT(date, y) FROM t WHERE f(z) = 1", "CAST(y) FROM t WHERE f(z AS date) = 1"),
    (clean.mask_to_date, "TO_DATE(@f(1), 'YYYY') + to_date(x, 'DD') + to_date(y)", " + ".join([clean.TO_DATE_CONSTANT] * 3)),
    (clean.mask_variable_functions, "a = @f(1, g(h(2))) AND b = @имя()", "a = '' AND b = ''"),
    (clean.mask_variable_functions, "@f((((1))))", "@f((((1))))"),
    (clean.rewrite_star, "SELECT * FROM t", "SELECT  _star_ FROM t".replace("  ", " ")),
    (clean.rewrite_star, "SELECT a.*, *, COUNT(*), b, * FROM t", "SELECT a._star_,_star_, COUNT(*), b, _star_ FROM t"),
    (clean.fix_common_issues, '"a , , b ,.c\n\n d ', "a , b ,c d"),
]


@pytest.mark.parametrize("rewrite, sql, expected", CASES)
def test_rewrites(spark, rewrite, sql, expected):
    df = spark.createDataFrame([(sql,)], "sql string")
    assert df.select(rewrite(F.col("sql"))).first()[0] == expected


@pytest.mark.parametrize(
    "dialect, sql, expected",
    [
        ("oracle", "SELECT [a b], '[x]', \"[y]\" FROM [s].[t]", "SELECT \"a b\", '[x]', \"[y]\" FROM \"s\".\"t\""),
        ("mysql", "[a] 'it''s [b]' [c", "`a` 'it''s [b]' [c"),
        ("tsql", "[a] [b", "[a] [b"),
        ("oracle", "'open [a]", "'open [a]"),
        ("oracle", "a] [b]", 'a] "b"'),
        ("oracle", "[it's] [x]", "\"it's\" \"x\""),
        ("oracle", "x" * 20000 + "'" + "y" * 20000 + "' [a]", "x" * 20000 + "'" + "y" * 20000 + "' \"a\""),
    ],
)
def test_requote_brackets(spark, dialect, sql, expected):
    df = spark.createDataFrame([(sql, dialect)], "sql string, dialect string")
    assert df.select(clean.requote_brackets(F.col("sql"), F.col("dialect"))).first()[0] == expected


def test_preprocess_passes_empty_and_null(spark):
    df = spark.createDataFrame([("", "oracle"), (None, "oracle")], "sql string, dialect string")
    assert [r[0] for r in df.select(clean.preprocess(F.col("sql"), F.col("dialect"))).collect()] == ["", None]


def test_preprocess_replaces_convert_and_to_date(spark):
    sql = "SELECT CONVERT(date, x) AS d, to_date('2024-01-01','YYYY-MM-DD') AS dt FROM t"
    df = spark.createDataFrame([(sql, "oracle")], "sql string, dialect string")
    result = df.select(clean.preprocess(F.col("sql"), F.col("dialect"))).first()[0]
    assert result == "SELECT CAST(x AS date) AS d, CAST('2000-01-01' AS DATE) AS dt FROM t"


def test_validate_sql(spark):
    rows = [("",), (None,), ("   ",), ("update t",), ("select 1 where a",), ("SELECT 1",), ("select a from t where b",)]
    result = clean.validate_sql(spark.createDataFrame(rows, "sql string")).collect()
    assert [(r.is_valid, r.error) for r in result] == [
        (False, clean.ERROR_EMPTY),
        (False, clean.ERROR_EMPTY),
        (False, clean.ERROR_NO_SELECT),
        (False, clean.ERROR_NO_SELECT),
        (False, clean.ERROR_NO_FROM),
        (True, None),
        (True, None),
    ]


def test_sources(spark, tmp_path):
    (tmp_path / "a.sql").write_text("SELECT 1\nFROM имя", encoding="utf-8")
    (tmp_path / "b.txt").write_text("SELECT 2", encoding="utf-8")
    (tmp_path / "c.csv").write_text("no", encoding="utf-8")
    rows = read_sql_files(spark, str(tmp_path), "SQLSERVER").collect()
    assert sorted((r.query_id.rsplit("/")[-1], r.sql, r.dialect) for r in rows) == [
        ("a.sql", "SELECT 1\nFROM имя", "tsql"),
        ("b.txt", "SELECT 2", "tsql"),
    ]
    log = spark.createDataFrame([(1, "SELECT 1")], "id long, body string")
    table = statements_from_table(log, query_id="id", sql="body")
    assert [tuple(r) for r in table.collect()] == [(1, "SELECT 1", "oracle")]
    names = spark.createDataFrame([("PostgreSQL",), ("tsql",), ("x",), (None,)], "n string")
    assert [r[0] for r in names.select(normalize_dialect(F.col("n"))).collect()] == ["postgres", "tsql", "oracle", "oracle"]
