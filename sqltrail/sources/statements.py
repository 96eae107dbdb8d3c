"""Where statements come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltrail.plans.stages import Stages
from sqltrail.sources.scripts import split_files, statements_of

DEFAULT_DIALECT = "oracle"

# Dialect names and the canonical name of each.
DIALECTS = {
    "ORACLE": "oracle",
    "POSTGRESQL": "postgres",
    "MYSQL": "mysql",
    "SQLSERVER": "tsql",
    "SNOWFLAKE": "snowflake",
    "BIGQUERY": "bigquery",
    "SQLITE": "sqlite",
    "CLICKHOUSE": "clickhouse",
    "REDSHIFT": "redshift",
    "DATABRICKS": "databricks",
    "HIVE": "hive",
    "PRESTO": "presto",
    "TRINO": "trino",
    "DUCKDB": "duckdb",
    "TERADATA": "teradata",
}


def normalize_dialect(name: Column) -> Column:
    """S3: display or canonical name to canonical name; unknown or null is the default."""
    known = {label.lower(): value for label, value in DIALECTS.items()}
    known.update({value: value for value in DIALECTS.values()})
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, F.lower(F.trim(name))), F.lit(DEFAULT_DIALECT))


def statements_from_table(
    df: DataFrame, query_id: str = "query_id", sql: str = "sql", dialect: str | None = "dialect"
) -> DataFrame:
    """Any DataFrame that holds SQL text, as ``statements(query_id, sql, dialect)``."""
    name = F.col(dialect) if dialect and dialect in df.columns else F.lit(None).cast("string")
    return df.select(
        F.col(query_id).alias("query_id"),
        F.col(sql).cast("string").alias("sql"),
        normalize_dialect(name).alias("dialect"),
    )


def read_sql_files(spark: SparkSession, path: str, dialect: str = DEFAULT_DIALECT) -> DataFrame:
    """One ``.sql`` or ``.txt`` file is one statement, keyed by its path.

    Files are never split, so a statement stays whole; small files share a task. ``read_sql_scripts`` is for
    files that hold many statements.
    """
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{sql,txt}")
        .text(path, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("query_id"),
            F.col("value").alias("sql"),
            normalize_dialect(F.lit(dialect)).alias("dialect"),
        )
    )


def read_sql_scripts(spark: SparkSession, path: str, stages: Stages, dialect: str = DEFAULT_DIALECT) -> DataFrame:
    """S1 for scripts: every statement of each file, keyed by ``(id, part)`` with the path as id, as ``split_statements`` would.

    A file of any size is read by many tasks. ``stages`` keeps what is written on the way until it is deleted.
    """
    name = DIALECTS.get(dialect.strip().upper(), dialect.strip().lower())
    name = name if name in DIALECTS.values() else DEFAULT_DIALECT
    rows = split_files(spark, path, stages, name)
    return rows.select(F.struct(F.col("file").alias("id"), "part").alias("query_id"), "sql", F.lit(name).alias("dialect"))


def split_statements(statements: DataFrame) -> DataFrame:
    """Every statement of each text as a row of its own; ``query_id`` becomes ``(id, part)``, part 0 the first.

    The facts of a text are those of its first statement. Split first, nothing of a script is left
    out. A text without any statement stays as part 0.
    """
    found = statements_of(F.col("sql"), F.col("dialect"))
    parts = F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.array("sql"))
    return statements.select("query_id", "dialect", F.posexplode(parts).alias("part", "sql")).select(
        F.struct(F.col("query_id").alias("id"), "part").alias("query_id"), "sql", "dialect"
    )
