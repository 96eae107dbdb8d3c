"""Statistics, views, search and text renderings of the facts.

Everything here works per statement text (``stmt``) and is handed to queries afterwards
with ``Analysis.per_query``. Lists built per statement are bounded by its own text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltrail.functions.text import comma_list, escape_formula_text, escape_source_text, filter_calculation
from sqltrail.operators.tables import CTE, SUBQUERY, TABLE
from sqltrail.plans.numbering import numbered as row_numbers

COUNTS = ("total_columns", "total_tables", "unique_tables", "calculation_columns", "total_column_mentions")

# Report texts.
SAMPLE_HEADER = "Полное имя | Алиасы | Таблица | Где используется | Количество упоминаний"
SAMPLE_RULE = "-" * 85
REPORT_TITLE = "=== РЕЗУЛЬТАТЫ ПАРСИНГА SQL ==="
REPORT_TABLES = "=== УНИКАЛЬНЫЕ ТАБЛИЦЫ ==="
REPORT_COLUMNS = "=== ДЕТАЛЬНЫЕ РЕЗУЛЬТАТЫ ==="
REPORT_RULE = "-" * 40
NOTHING = "нет"


def or_blank(name: str) -> Column:
    return F.coalesce(name, F.lit(""))


def column_order() -> Column:
    """Order of columns in renderings: owner, name, then the full key for ties."""
    return F.struct(or_blank("table").alias("by_table"), F.col("column_name").alias("by_name"), F.col("column_key").alias("by_key"))


def query_statistics(texts: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """M1: one row of counts per text; texts without facts count zero."""
    c = F.col
    labels = (TABLE, SUBQUERY, CTE)
    by_table = tables.groupBy("stmt").agg(
        F.count(F.lit(1)).alias("total_tables"),
        *[F.count_if(c("table_type") == label).alias(f"type_{i}") for i, label in enumerate(labels)],
    )
    by_column = columns.groupBy("stmt").agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if("is_calculation").alias("calculation_columns"),
        F.sum("usage_count").alias("total_column_mentions"),
    )
    entries = F.array(*[F.struct(F.lit(label).alias("key"), F.coalesce(f"type_{i}", F.lit(0)).alias("value")) for i, label in enumerate(labels)])
    joined = (
        texts.select("stmt")
        .join(by_column, "stmt", "left")
        .join(by_table, "stmt", "left")
        .withColumn("unique_tables", c("total_tables"))
    )
    return joined.select(
        "stmt",
        *[F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in COUNTS],
        F.map_from_entries(F.filter(entries, lambda e: e.value > 0)).alias("table_types"),
    )


def corpus_statistics(statistics: DataFrame, texts: DataFrame) -> DataFrame:
    """M1 over the whole log: per dialect and, with a null dialect, in total.

    Counts of a text are weighted by its copies, so no query is ever expanded.
    """
    weighted = statistics.join(texts.select("stmt", "dialect", "copies"), "stmt")
    return weighted.rollup("dialect").agg(
        F.sum("copies").alias("queries"),
        *[F.sum(F.col(name) * F.col("copies")).alias(name) for name in COUNTS],
    )


def corpus_unique_tables(tables: DataFrame, texts: DataFrame) -> DataFrame:
    """A9 over the whole log: each table with the number of queries that touch it."""
    weighted = tables.join(texts.select("stmt", "copies"), "stmt")
    return weighted.groupBy("schema", "name", "table_type").agg(F.sum("copies").alias("queries"))


def statistics_rows(statistics: DataFrame, key: str = "stmt") -> DataFrame:
    """M2: ``(parameter, value)`` rows; table types as ``table_types.X``."""
    counts = F.array(*[F.struct(F.lit(name).alias("parameter"), F.col(name).alias("value")) for name in COUNTS])
    types = F.transform(
        F.map_entries("table_types"), lambda e: F.struct(F.concat(F.lit("table_types."), e.key).alias("parameter"), e.value.cast("bigint").alias("value"))
    )
    return statistics.select(key, F.inline(F.concat(counts, types)))


def columns_view(enriched: DataFrame) -> DataFrame:
    """M3: nine display columns per column."""
    return enriched.select(
        "stmt",
        or_blank("column_name").alias("column_name"),
        or_blank("full_name").alias("full_name"),
        "schema",
        F.col("table_name").alias("table"),
        or_blank("table_alias").alias("table_alias"),
        "object_type",
        comma_list(F.col("aliases")).alias("aliases"),
        comma_list(filter_calculation(F.col("usage_locations"))).alias("usage"),
        "usage_count",
    )


def tables_view(tables: DataFrame) -> DataFrame:
    """M4: six display columns per table."""
    return tables.select(
        "stmt",
        or_blank("schema").alias("schema"),
        F.col("name").alias("table"),
        comma_list(F.col("aliases")).alias("aliases"),
        "table_type",
        "column_count",
        or_blank("join_type").alias("join_type"),
    )


def lineage_view(columns: DataFrame) -> DataFrame:
    """M5: five display columns per column."""
    return columns.select(
        "stmt",
        "column_name",
        or_blank("table").alias("table"),
        or_blank("full_name").alias("source"),
        comma_list(F.col("dependencies")).alias("dependencies"),
        comma_list(filter_calculation(F.col("usage_locations"))).alias("usage"),
    )


def search_metadata(view: DataFrame, text: str, *ignored: str) -> DataFrame:
    """M9: rows in which any cell contains the text, in any case; no text keeps all."""
    if not text:
        return view
    needle = F.lower(F.lit(text))
    cells = [F.lower(F.col(name).cast("string")).contains(needle) for name in view.columns if name not in ignored]
    return view.where(reduce(lambda a, b: a | b, [F.coalesce(cell, F.lit(False)) for cell in cells]))


def sort_view(view: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sort by one column with its own type, so counts sort as numbers.

    Most counts are equal, and equal keys would fall into one sort task; the other columns
    break the ties and let the ranges split.
    """
    chosen = F.col(column).desc() if descending else F.col(column).asc()
    return view.orderBy(chosen, *[F.col(name) for name in view.columns if name != column])


def number_sorted(view: DataFrame, column: str, store: Callable[[DataFrame], DataFrame], descending: bool = False) -> DataFrame:
    """The view with ``row_no``, the place of each row (from 1) when sorted by one column.

    Ranges of the sorted rows are numbered by the counts of earlier ranges, so no task holds all rows, and a page
    of the view is a filter on ``row_no``. The other columns break ties, as in ``sort_view``. ``store`` writes the sorted rows.
    """
    chosen = F.col(column).desc() if descending else F.col(column).asc()
    order = [chosen, *[F.col(name).asc() for name in view.columns if name != column]]
    return row_numbers(view, [], order, store, "row_no").withColumn("row_no", F.col("row_no") + 1)


def listed(df: DataFrame, order: Column, value: Column, name: str) -> DataFrame:
    """Values of each text as one array in a given order."""
    entry = F.struct(order.alias("order"), value.alias("value"))
    return df.groupBy("stmt").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.value).alias(name)
    )


def columns_sample_text(texts: DataFrame, columns: DataFrame) -> DataFrame:
    """M7: header, rule and one line per column, sorted by table and name."""
    line = F.concat_ws(
        " | ",
        "full_name",
        comma_list(F.col("aliases")),
        or_blank("table"),
        comma_list(F.col("usage_locations")),
        F.col("usage_count").cast("string"),
    )
    lines = listed(columns, column_order(), line, "lines")
    header = F.array(F.lit(SAMPLE_HEADER), F.lit(SAMPLE_RULE))
    body = F.coalesce("lines", F.array().cast("array<string>"))
    return texts.select("stmt").join(lines, "stmt", "left").select(
        "stmt", F.array_join(F.concat(header, body), "\n").alias("sample")
    )


def numbered(lines: Column) -> Column:
    return F.transform(lines, lambda line, i: F.concat((i + 1).cast("string"), F.lit(". "), line))


def table_line() -> Column:
    aliases = comma_list(F.col("aliases"))
    return F.concat(
        or_blank("schema"),
        F.lit("."),
        "name",
        F.when(F.size("aliases") > 0, F.concat(F.lit(" (алиасы: "), aliases, F.lit(")"))).otherwise(""),
        F.lit(" - "),
        "table_type",
        F.when(F.col("join_type").isNotNull(), F.concat(F.lit(" ["), "join_type", F.lit("]"))).otherwise(""),
    )


def report_parts(texts: DataFrame, tables: DataFrame, columns: DataFrame, column_line: Column) -> DataFrame:
    """Numbered table and column lines of each text."""
    empty = F.array().cast("array<string>")
    return (
        texts.select("stmt", "dialect")
        .join(listed(tables, F.col("rank"), table_line(), "table_lines"), "stmt", "left")
        .join(listed(columns, column_order(), column_line, "column_lines"), "stmt", "left")
        .select(
            "stmt",
            F.upper("dialect").alias("dialect"),
            numbered(F.coalesce("table_lines", empty)).alias("table_lines"),
            numbered(F.coalesce("column_lines", empty)).alias("column_lines"),
        )
    )


def text_report(texts: DataFrame, tables: DataFrame, columns: DataFrame, report_time: str) -> DataFrame:
    """M8: the plain text report of each text. The time is given, so reruns agree."""
    usage = comma_list(filter_calculation(F.col("usage_locations")))
    column_line = F.concat(
        F.lit("Колонка: "), "column_name",
        F.lit("\n   Таблица: "), or_blank("table"), F.lit(" (Алиас: "), or_blank("table_alias"), F.lit(")"),
        F.lit("\n   Полное имя: "), or_blank("full_name"),
        F.lit("\n   Вычисление: "), F.coalesce("calculation_type", F.lit(NOTHING)),
        F.lit("\n   Использование: "), F.when(usage == "", NOTHING).otherwise(usage),
        F.lit(f"\n{REPORT_RULE}"),
    )
    parts = report_parts(texts, tables, columns, column_line)
    newline = F.lit("\n")
    return parts.select(
        "stmt",
        F.concat(
            F.lit(f"{REPORT_TITLE}\nДата анализа: {report_time}\nДиалект SQL: "), "dialect",
            F.lit(f"\n\n{REPORT_TABLES}\n"),
            F.array_join(F.transform("table_lines", lambda x: F.concat(x, newline)), ""),
            F.lit("\nВсего уникальных таблиц: "), F.size("table_lines").cast("string"),
            F.lit(f"\n\n{REPORT_COLUMNS}\n\n"),
            F.array_join(F.transform("column_lines", lambda x: F.concat(x, newline)), ""),
        ).alias("report"),
    )


def text_line_lists(texts: DataFrame, tables: DataFrame, columns: DataFrame, report_time: str) -> DataFrame:
    """The report as a list of lines, safe to open in a spreadsheet (K5, K6)."""
    usage = comma_list(filter_calculation(F.col("usage_locations")))
    column_line = F.concat(
        F.lit("Колонка: "), "column_name",
        F.lit("\n   Таблица: "), or_blank("table"), F.lit(" (Алиас: "), or_blank("table_alias"), F.lit(")"),
        F.lit("\n   Полное имя: "), or_blank("full_name"),
        F.lit("\n   Алиасы: "), comma_list(F.col("aliases")),
        F.lit("\n   Использование: "), usage,
        F.lit("\n   Упоминаний: "), F.col("usage_count").cast("string"),
        F.lit("\n"),
    )
    parts = report_parts(texts, tables, columns, column_line)
    head = F.array(
        F.lit(REPORT_TITLE),
        F.lit(f"Дата анализа: {report_time}"),
        F.concat(F.lit("Диалект SQL: "), "dialect"),
        F.lit(""),
        F.lit(REPORT_TABLES),
    )
    middle = F.array(
        F.concat(F.lit("Всего уникальных таблиц: "), F.size("table_lines").cast("string")), F.lit(""), F.lit(REPORT_COLUMNS)
    )
    details = F.flatten(F.transform("column_lines", lambda x: F.split(x, "\n")))
    return parts.select("stmt", F.transform(F.concat(head, "table_lines", middle, details), escape_formula_text).alias("lines"))


def line_rows(lists: DataFrame, key: str = "stmt") -> DataFrame:
    """One row per line."""
    return lists.select(key, F.posexplode("lines").alias("line", "text"))


def text_lines(texts: DataFrame, tables: DataFrame, columns: DataFrame, report_time: str) -> DataFrame:
    """The report as one row per line (K5, K6)."""
    return line_rows(text_line_lists(texts, tables, columns, report_time))


def source_view(texts: DataFrame) -> DataFrame:
    """The statement as written, safe to open in a spreadsheet (K5, K6)."""
    return texts.select("stmt", escape_source_text(F.col("sql")).alias("source_sql"))


def run_summary(texts: DataFrame, statistics: DataFrame) -> DataFrame:
    """Columns, unique tables and errors of each text."""
    return (
        texts.select("stmt", F.size("parse_errors").alias("errors"))
        .join(statistics, "stmt")
        .select("stmt", "total_columns", "unique_tables", "errors")
    )
