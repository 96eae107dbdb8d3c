"""Outputs (K1-K8). Each writes in parallel; nothing passes through the driver."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sqltrail.functions.text import comma_list
from sqltrail.plans import reports
from sqltrail.sinks.manifest import commit

# The document schema and the display headers.
JSON_SCHEMA = {
    "type": "object",
    "properties": {
        "metadata": {
            "type": "object",
            "properties": {
                "original_sql": {"type": "string"},
                "statistics": {"type": "object"},
                "parse_errors": {"type": "array", "items": {"type": "string"}},
            },
            "required": ["original_sql", "statistics", "parse_errors"],
        },
        "tables": {
            "type": "array",
            "items": {
                "type": "object",
                "properties": {
                    "name": {"type": "string"},
                    "schema": {"type": ["string", "null"]},
                    "aliases": {"type": "array", "items": {"type": "string"}},
                    "type": {"type": "string"},
                    "column_count": {"type": "integer"},
                },
            },
        },
        "columns": {
            "type": "array",
            "items": {
                "type": "object",
                "properties": {
                    "full_name": {"type": "string"},
                    "table": {"type": ["string", "null"]},
                    "table_alias": {"type": ["string", "null"]},
                    "column_name": {"type": "string"},
                    "aliases": {"type": "array", "items": {"type": "string"}},
                    "column_aliases": {"type": "array", "items": {"type": "string"}},
                    "usage_locations": {"type": "array", "items": {"type": "string"}},
                    "usage_count": {"type": "integer"},
                    "is_calculation": {"type": "boolean"},
                    "calculation_type": {"type": ["string", "null"]},
                    "calculation_expression": {"type": ["string", "null"]},
                    "dependencies": {"type": "array", "items": {"type": "string"}},
                },
            },
        },
        "json_schema": {"type": "object"},
    },
    "required": ["metadata", "tables", "columns", "json_schema"],
}
TABLE_HEADERS = {
    "schema": "Схема",
    "table": "Имя таблицы",
    "aliases": "Алиасы",
    "table_type": "Тип таблицы",
    "join_type": "Тип JOIN",
    "columns": "Колонки",
}
COLUMN_HEADERS = {
    "column_name": "Колонка",
    "schema": "Схема",
    "table": "Таблица",
    "table_alias": "Алиас таблицы",
    "object_type": "Тип объекта",
    "full_name": "Полное имя",
    "calculation_type": "Тип вычисления",
    "usage": "Использование",
    "usage_count": "Количество использований",
}
SUMMARY_HEADERS = {
    "column_name": "Колонка",
    "full_name": "Полное имя",
    "schema": "Схема",
    "table": "Таблица",
    "table_alias": "Алиас таблицы",
    "object_type": "Тип объекта",
    "aliases": "Алиасы",
    "usage": "Где используется",
    "usage_count": "Количество упоминаний",
}
BYTE_ORDER_MARK = "﻿"

# The formats and their extensions.
FORMATS = {"excel": (".xlsx", ".xls"), "json": (".json",), "csv": (".csv",), "text": (".txt",)}


def csv_tables(tables: DataFrame) -> DataFrame:
    """K2: six columns per table; column names sorted."""
    return tables.select(
        "stmt",
        reports.or_blank("schema").alias("schema"),
        F.col("name").alias("table"),
        comma_list(F.col("aliases")).alias("aliases"),
        "table_type",
        reports.or_blank("join_type").alias("join_type"),
        comma_list(F.col("columns")).alias("columns"),
    )


def csv_columns(enriched: DataFrame) -> DataFrame:
    """K3: nine columns per column; usage not filtered."""
    return enriched.select(
        "stmt",
        "column_name",
        "schema",
        F.col("table_name").alias("table"),
        reports.or_blank("table_alias").alias("table_alias"),
        "object_type",
        reports.or_blank("full_name").alias("full_name"),
        reports.or_blank("calculation_type").alias("calculation_type"),
        comma_list(F.col("usage_locations")).alias("usage"),
        "usage_count",
    )


def tsv_summary(enriched: DataFrame) -> DataFrame:
    """K7: nine columns per column; usage not filtered."""
    return enriched.select(
        "stmt",
        "column_name",
        reports.or_blank("full_name").alias("full_name"),
        "schema",
        F.col("table_name").alias("table"),
        reports.or_blank("table_alias").alias("table_alias"),
        "object_type",
        comma_list(F.col("aliases")).alias("aliases"),
        comma_list(F.col("usage_locations")).alias("usage"),
        "usage_count",
    )


def document_bodies(texts: DataFrame, statistics: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """``(stmt, body, is_read)``: a document without its opening bracket and schema, which is the same in all and need not be moved."""
    table = F.struct(
        "name", "schema", "aliases", F.col("table_type").alias("type"), "column_count", "join_type"
    )
    column = F.struct(
        "full_name", "table", "table_alias", "column_name", "aliases", "column_aliases", "usage_locations",
        "usage_count", "is_calculation", "calculation_type", "calculation_expression", "dependencies",
    )
    keep_nulls = {"ignoreNullFields": "false"}

    def json_array(values: str) -> Column:
        return F.coalesce(F.to_json(values, keep_nulls), F.lit("[]"))

    metadata = F.struct(
        F.coalesce("sql", F.lit("")).alias("original_sql"),
        F.struct(*reports.COUNTS, "table_types").alias("statistics"),
        "parse_errors",
    )
    return (
        texts.select("stmt", "sql", "parse_errors")
        .join(statistics, "stmt")
        .join(reports.listed(tables, F.col("rank"), table, "tables"), "stmt", "left")
        .join(reports.listed(columns, reports.column_order(), column, "columns"), "stmt", "left")
        .select(
            "stmt",
            F.concat(
                F.lit('"metadata":'), F.to_json(metadata, keep_nulls),
                F.lit(',"tables":'), json_array("tables"),
                F.lit(',"columns":'), json_array("columns"),
                F.lit(',"json_schema":'),
            ).alias("body"),
            (F.size("parse_errors") == 0).alias("is_read"),
        )
    )


def closed_body() -> Column:
    """A body with its schema; texts that were not read have no schema of their own."""
    return F.concat("body", F.when(F.col("is_read"), json.dumps(JSON_SCHEMA) + "}").otherwise("{}}"))


def whole_documents(bodies: DataFrame, key: str = "stmt") -> DataFrame:
    return bodies.select(key, F.concat(F.lit("{"), closed_body()).alias("document"))


def documents(texts: DataFrame, statistics: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """K1: one nested JSON document per text, nulls kept."""
    return whole_documents(document_bodies(texts, statistics, tables, columns))


def with_headers(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Display headers, in order, after the query id."""
    return df.select("query_id", *[F.col(name).alias(label) for name, label in headers.items()])


def write_csv(df: DataFrame, path: str, mode: str = "error", separator: str = ",", mark: bool = True) -> None:
    """Delimited text with a header in every file, and a byte order mark before it.

    Quotes inside a cell are doubled, as spreadsheets expect.
    """
    if mark:
        df = df.withColumnRenamed(df.columns[0], BYTE_ORDER_MARK + df.columns[0])
    df.write.mode(mode).options(header=True, sep=separator, encoding="UTF-8", escape='"', emptyValue="").csv(path)


# A page of the text output: its first line, and what ends it.
QUERY_LINE, PAGE_END = "query_id: ", "\f\n"
# Documents and reports repeat their frames for every query, so plain files would be the largest part of a run's disk. For such text
# the fastest level of gzip is close to the best in size, and compressing was most of the work of these outputs.
COMPRESSED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def write_json(bodies_per_query: DataFrame, path: str, mode: str = "error") -> None:
    """One document per line, keyed by its query in the same order of fields."""
    if isinstance(bodies_per_query.schema["query_id"].dataType, IntegralType):
        query = F.coalesce(F.col("query_id").cast("string"), F.lit("null"))
    else:
        query = F.regexp_extract(F.to_json(F.array("query_id")), r"(?s)\A\[(.*)\]\z", 1)
    line = F.concat(F.lit('{"query_id":'), query, F.lit(","), closed_body())
    bodies_per_query.select(line.alias("value")).write.mode(mode).options(**COMPRESSED).text(path)


def write_text(reports_per_query: DataFrame, path: str, mode: str = "error") -> None:
    """K4: reports one after another, each under a line that names its query, on a page of its own.

    A directory per query would not survive a large log.
    """
    named = F.concat(F.lit(QUERY_LINE), F.col("query_id").cast("string"), F.lit("\n"), F.col("report"))
    reports_per_query.select(named.alias("value")).write.mode(mode).options(lineSep=PAGE_END, **COMPRESSED).text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``query_id`` as text and ``report`` of a written text output."""
    pages = spark.read.option("lineSep", PAGE_END).text(path)
    name = F.substring_index("value", "\n", 1)
    return pages.select(
        F.replace(name, F.lit(QUERY_LINE), F.lit("")).alias("query_id"), F.substr("value", F.length(name) + 2).alias("report")
    )


def sheets(analysis, report_time: str) -> dict[str, DataFrame]:
    """K5: the six datasets of the workbook, in sheet order."""
    texts, tables, columns = analysis.texts, analysis.tables, analysis.columns
    views = {
        "columns": reports.columns_view(analysis.enriched),
        "tables": reports.tables_view(tables),
        "lineage": reports.lineage_view(columns),
        "statistics": analysis.statistics,
        "text": reports.text_line_lists(texts, tables, columns, report_time),
        "source": reports.source_view(texts),
    }
    found = {name: analysis.per_query(view) for name, view in views.items()}
    # A text meets its queries as one row, and becomes rows afterwards.
    return found | {"statistics": reports.statistics_rows(found["statistics"], "query_id"), "text": reports.line_rows(found["text"], "query_id")}


def sheet_manifest(path: str) -> str:
    return f"{path}/manifest.json"


def write_sheet_set(analysis, path: str, report_time: str, mode: str = "error") -> None:
    """K5: the sheets in one commit, a folder each; ``read_committed`` with ``sheet_manifest`` reads one back."""

    def writer(sheet: DataFrame):
        return lambda folder: sheet.write.mode("append").parquet(folder)

    parts = {name: (f"{path}/{name}", writer(sheet)) for name, sheet in sheets(analysis, report_time).items()}
    commit(analysis.session, sheet_manifest(path), parts, mode)


def csv_manifest(path: str) -> str:
    return f"{os.path.splitext(path)[0]}_manifest.json"


def write_csv_pair(analysis, path: str, mode: str = "error") -> None:
    """K2 and K3 in one commit: ``<base>_tables.csv`` and ``<base>_columns.csv``, with ``<base>_manifest.json``."""
    base = os.path.splitext(path)[0]

    def writer(view: DataFrame, headers: dict[str, str]):
        rows = with_headers(analysis.per_query(view), headers)
        return lambda folder: write_csv(rows, folder, "append")

    parts = {
        "tables": (f"{base}_tables.csv", writer(csv_tables(analysis.tables), TABLE_HEADERS)),
        "columns": (f"{base}_columns.csv", writer(csv_columns(analysis.enriched), COLUMN_HEADERS)),
    }
    commit(analysis.session, csv_manifest(path), parts, mode)


def write_tsv_summary(analysis, path: str, mode: str = "error") -> None:
    """K7: the column summary as tab-separated text."""
    summary = analysis.per_query(tsv_summary(analysis.enriched))
    write_csv(with_headers(summary, SUMMARY_HEADERS), path, mode, separator="\t", mark=False)


def choose_format(path: str, name: str | None = None) -> str:
    """K8: by name, else by extension, else an error."""
    if name in FORMATS:
        return name
    extension = os.path.splitext(path)[1].lower()
    for candidate, extensions in FORMATS.items():
        if extension in extensions:
            return candidate
    raise ValueError(f"Не удалось определить стратегию экспорта: {path}")


def write_metadata(analysis, path: str, name: str | None = None, report_time: str = "", mode: str = "error") -> None:
    """K8: write all facts in the chosen format. Write errors reach the caller."""
    chosen = choose_format(path, name)
    if chosen == "excel":
        write_sheet_set(analysis, path, report_time, mode)
    elif chosen == "json":
        found = document_bodies(analysis.texts, analysis.statistics, analysis.tables, analysis.columns)
        write_json(analysis.per_query(found), path, mode)
    elif chosen == "csv":
        write_csv_pair(analysis, path, mode)
    else:
        report = reports.text_report(analysis.texts, analysis.tables, analysis.columns, report_time)
        write_text(analysis.per_query(report), path, mode)
