"""Registered queries over the statement log derived from ``events``."""

from __future__ import annotations

import atexit
import threading
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle import sql as oracle
from sqltrail import Analysis
from sqltrail.functions import clean
from sqltrail.functions.text import comma_list, escape_source_text, filter_calculation
from sqltrail.operators import columns as col_ops
from sqltrail.operators import tables as tab
from sqltrail.plans import reports
from sqltrail.plans.search import read_postings, search_indexed, write_postings
from sqltrail.sinks import writers
from sqltrail.sinks.manifest import read_committed
from sqltrail.sources import corpus
from sqltrail.sources.statements import DIALECTS, normalize_dialect, read_sql_scripts, split_statements, statements_from_table

SMOKE_DIR = "/root/testdata/sf0.001"
_analyses: dict[tuple[str, str], Analysis] = {}
_lock = threading.Lock()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements_from_table(corpus.log_table(_events(spark, sf_dir)))


def _analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    """One analysis per application and data set, so its stages are written once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _lock:
        if key not in _analyses:
            _analyses[key] = Analysis(_log(spark, sf_dir))
        return _analyses[key]


@atexit.register
def _release() -> None:
    """Delete the stages of the application that is still running."""
    context = SparkContext._active_spark_context
    for (application, _), analysis in _analyses.items():
        if context and application == context.applicationId:
            analysis.release()


def entry(spark: SparkSession) -> DataFrame:
    """The most used tables and columns of the log, counted over all its queries."""
    analysis = _analysis(spark, SMOKE_DIR)
    copies = analysis.texts.select("stmt", "copies")
    return (
        analysis.columns.where(F.col("table").isNotNull())
        .join(copies, "stmt")
        .groupBy("table", "column_name")
        .agg(F.sum("copies").alias("queries"), F.sum(F.col("usage_count") * F.col("copies")).alias("mentions"))
        .orderBy(F.desc("mentions"), "table", "column_name")
    )


def _cleaned(rewrite) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _log(spark, d).select("query_id", rewrite(F.col("sql")).alias("sql_out"))


def _facts(build: Callable[[Analysis], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A fact table of the log, handed back to every query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        analysis = _analysis(spark, sf_dir)
        return analysis.per_query(build(analysis))

    return run


def _corpus(build: Callable[[Analysis], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(_analysis(spark, sf_dir))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement of the log's scripts as a row."""
    parts = split_statements(_log(spark, sf_dir))
    return parts.select(F.col("query_id.id").alias("query_id"), F.col("query_id.part").alias("part"), "sql")


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as script files, a comment with its id before each text, and their statements read back."""
    stages = _analysis(spark, sf_dir).stages
    marked = F.concat(F.lit("/*"), F.col("query_id").cast("string"), F.lit("*/"), F.col("sql"))
    path = f"{stages.root}/S1-scripts"
    _log(spark, sf_dir).select(marked).write.mode("overwrite").option("lineSep", ";\n").text(path)
    found = read_sql_scripts(spark, path, stages)
    return found.groupBy(F.regexp_replace("sql", r"\A\n", "").alias("sql")).agg(F.count(F.lit(1)).alias("statements"))


def _dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*DIALECTS, "no such dialect", None]
    picked = F.get(F.array(*[F.lit(n) for n in names]), F.pmod("event_id", F.lit(len(names))).cast("int"))
    return (
        _events(spark, sf_dir)
        .select(F.col("event_id").alias("query_id"), picked.alias("name"))
        .withColumn("dialect", normalize_dialect(F.col("name")))
    )


def _requoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    dialect = F.get(F.array(F.lit("tsql"), F.lit("mysql"), F.lit("oracle")), F.pmod("query_id", F.lit(3)).cast("int"))
    return _log(spark, sf_dir).select("query_id", clean.requote_brackets(F.col("sql"), dialect).alias("sql_out"))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.validate_sql(_log(spark, sf_dir)).select("query_id", "is_valid", "error")


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("query_id", escape_source_text(F.col("sql")).alias("source_sql"))


def _unmarked(a: Analysis) -> DataFrame:
    references = tab.table_references(a.lexemes)
    return tab.with_join_types(references, a.around, a.outer_marks.where(F.lit(False)))


def _key(table: str = "key_table", column: str = "key_column"):
    return F.concat(table, F.lit("."), column).alias("column_key")


def _mentions(a: Analysis, condition, *names) -> DataFrame:
    rows = a.mentions.where(F.col("key_table").isNotNull() & condition)
    return rows.groupBy("stmt", *names, _key()).agg(F.count(F.lit(1)).alias("mentions"))


def _unqualified(a: Analysis) -> DataFrame:
    owner = F.when(F.col("key_table") != "UNKNOWN", F.col("key_table")).alias("table")
    bare = F.col("qualifier").isNull() & ~F.col("by_alias")
    return _mentions(a, bare, F.col("column").alias("column_name"), owner)


def _joined(df: DataFrame, *lists: str) -> DataFrame:
    """Lists as text, so that results compare by value."""
    for name in lists:
        df = df.withColumn(name, comma_list(F.col(name)))
    return df


def _columns(*names: str, where=None) -> Callable[[SparkSession, str], DataFrame]:
    lists = ("aliases", "column_aliases", "usage_locations", "dependencies")

    def build(a: Analysis) -> DataFrame:
        rows = a.columns if where is None else a.columns.where(where)
        return _joined(rows.select("stmt", *names), *[n for n in names if n in lists])

    return _facts(build)


def _tables(*names: str) -> Callable[[SparkSession, str], DataFrame]:
    return _facts(lambda a: _joined(a.tables.select("stmt", *names), *[n for n in names if n in ("aliases", "columns")]))


def _is_output(a: Analysis) -> DataFrame:
    outputs = a.projections.select("stmt", F.col("relation").alias("table"), F.col("output").alias("column_name"))
    return a.columns.join(outputs.distinct(), ["stmt", "table", "column_name"], "left_semi")


def _exposed(a: Analysis) -> DataFrame:
    sources = a.projections.select(
        "stmt", F.col("source_table").alias("table"), F.col("source_column").alias("column_name")
    )
    rows = a.columns.join(sources.distinct(), ["stmt", "table", "column_name"], "left_semi")
    return _joined(rows.select("stmt", "column_key", "aliases"), "aliases")


def _of_ctes(a: Analysis) -> DataFrame:
    names = a.cte_names.select("stmt", F.col("name").alias("table"))
    rows = a.columns.join(names, ["stmt", "table"], "left_semi")
    return _joined(rows.select("stmt", "column_key", "usage_count", "usage_locations"), "usage_locations")


def _alias_refs(a: Analysis) -> DataFrame:
    refs = a.columns.select("stmt", "column_key", F.explode("aliases").alias("alias_ref"))
    return refs.where(F.col("alias_ref").contains("."))


def _named_tables(a: Analysis) -> DataFrame:
    found = tab.table_by_name(a.tables, "t_view", "s").unionByName(tab.table_by_name(a.tables, "ripe"))
    return found.select("stmt", "schema", "name", "table_type")


def _statistics(a: Analysis) -> DataFrame:
    entries = F.transform(
        F.array_sort(F.map_entries("table_types")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))
    )
    return a.statistics.withColumn("table_types", F.array_join(entries, ", "))


def _sorted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysis = _analysis(spark, sf_dir)
    return reports.sort_view(analysis.per_query(reports.columns_view(analysis.enriched)), "usage_count", descending=True)


def _numbered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted view of columns with its row numbers."""
    analysis = _analysis(spark, sf_dir)

    def store(df: DataFrame) -> DataFrame:
        analysis.stages.write("M10-sorted", lambda: df)
        return analysis.stages.read("M10-sorted", spark)

    view = analysis.per_query(reports.columns_view(analysis.enriched))
    return reports.number_sorted(view, "usage_count", store, descending=True)


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of columns searched by its postings."""
    analysis = _analysis(spark, sf_dir)
    view, path = reports.columns_view(analysis.enriched), f"{analysis.stages.root}/M9-postings"
    write_postings(view, path, mode="overwrite")
    return analysis.per_query(search_indexed(view, read_postings(spark, path), "LEAKS"))


def _sheets_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 as a user has it: all sheets in one commit, then the one of columns read by its manifest."""
    analysis = _analysis(spark, sf_dir)
    path = f"{analysis.stages.root}/K5.xlsx"
    writers.write_metadata(analysis, path, report_time=oracle.REPORT_TIME, mode="overwrite")
    return read_committed(spark, writers.sheet_manifest(path), "columns")


def _report(a: Analysis) -> DataFrame:
    return reports.text_report(a.texts, a.tables, a.columns, oracle.REPORT_TIME)


def _training_data():
    """The modules of the training-data operators and their pipeline, where they are installed."""
    try:
        import corpus_pipeline
        from sqltrail.llm import queries as operators
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "sqltrail.llm"):
            raise
        return None
    return operators, corpus_pipeline


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = engine_queries()
    if more := _training_data():
        operators, pipeline = more
        found |= operators.queries() | {"pipeline": pipeline.run}
    return found


def _text_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 as a user has it: the text output written, then read."""
    analysis = _analysis(spark, sf_dir)
    path = f"{analysis.stages.root}/K4.txt"
    writers.write_metadata(analysis, path, report_time=oracle.REPORT_TIME, mode="overwrite")
    return writers.read_text(spark, path).withColumn("query_id", F.col("query_id").cast("bigint"))


def _json_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 as a user has it: the format chosen by the path, the document written, then read."""
    analysis = _analysis(spark, sf_dir)
    path = f"{analysis.stages.root}/K8.json"
    writers.write_metadata(analysis, path, mode="overwrite")
    line = F.col("value")
    head = F.substring_index(line, ",", 1)
    return spark.read.text(path).select(
        F.get_json_object(line, "$.query_id").cast("bigint").alias("query_id"),
        F.concat(F.lit("{"), F.substr(line, F.length(head) + 2)).alias("document"),
    )


def engine_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    calculated = "is_calculation"
    return {
        "S1_read_sql_scripts": _scripts,
        "S2_statements_from_table": _log,
        "S2_split_statements": _split,
        "S2_unread_statements": _facts(lambda a: a.scripts),
        "S3_normalize_dialect": _dialects,
        "P1_remove_comments": _cleaned(clean.remove_comments),
        "P2_convert_to_cast": _cleaned(clean.convert_to_cast),
        "P3_mask_to_date": _cleaned(clean.mask_to_date),
        "P4_mask_variable_functions": _cleaned(clean.mask_variable_functions),
        "P5_rewrite_star": _cleaned(clean.rewrite_star),
        "P6_requote_brackets": _requoted,
        "P7_fix_common_issues": _cleaned(clean.fix_common_issues),
        "P8_preprocess": _facts(lambda a: a.texts.select("stmt", "sql_clean")),
        "P9_validate_sql": _validated,
        "P10_capture_errors": _facts(lambda a: _joined(a.texts.select("stmt", "parse_errors"), "parse_errors")),
        "A1_cte_definitions": _facts(lambda a: a.ctes.select("stmt", "name")),
        "A2_table_references": _facts(
            lambda a: tab.table_references(a.lexemes).select("stmt", "schema", "name", "alias")
        ),
        "A3_classify_cte_reference": _facts(lambda a: a.references.select("stmt", "name", "alias", "table_type")),
        "A4_derived_tables": _facts(lambda a: a.derived.select("stmt", "name")),
        "A5_join_type_per_table": _facts(lambda a: _unmarked(a).select("stmt", "name", "alias", "join_type")),
        "A6_oracle_outer_marks": _facts(lambda a: a.outer_marks),
        "A7_apply_oracle_outer_marks": _facts(lambda a: a.references.select("stmt", "name", "alias", "join_type")),
        "A8_upsert_tables": _tables("schema", "name", "table_type", "aliases", "join_type"),
        "A9_unique_tables": _facts(lambda a: _joined(tab.unique_tables(a.tables), "aliases", "columns")),
        "A9_unique_tables_corpus": _corpus(lambda a: tab.corpus_table_members(a.tables)),
        "A9_table_usage_corpus": _corpus(lambda a: reports.corpus_unique_tables(a.tables, a.texts)),
        "A10_table_by_name": _facts(_named_tables),
        "A11_columns_per_table": _tables("schema", "name", "table_type", "columns", "column_count"),
        "R1_scope_tables": _facts(
            lambda a: a.scope_tables.groupBy("stmt", "alias", "name").agg(F.count_distinct("scope").alias("selects"))
        ),
        "R2_resolve_qualified": _facts(
            lambda a: _mentions(a, F.col("qualifier").isNotNull(), "qualifier", F.col("column").alias("column_name"))
        ),
        "R3_resolve_unqualified": _facts(_unqualified),
        "R4_resolve_select_alias": _facts(
            lambda a: _mentions(a, F.col("by_alias"), F.col("column").alias("column_name"))
        ),
        "R5_expand_star": _facts(lambda a: _mentions(a, F.col("column") == "*")),
        "R6_projection_map": _facts(
            lambda a: a.projections.select(
                "stmt", "relation", "output", _key("source_table", "source_column").alias("source_key")
            )
        ),
        "C1_column_mentions": _facts(lambda a: _mentions(a, F.lit(True))),
        "C2_usage_contexts": _columns("column_key", "usage_locations"),
        "C3_calculation_flag": _columns("column_key", "is_calculation"),
        "C4_calculation_type": _columns("column_key", "calculation_type", where=calculated),
        "C5_calculation_expression": _columns("column_key", "calculation_expression", where=calculated),
        "C6_select_aliases": _columns("column_key", "column_aliases", where="size(column_aliases) > 0"),
        "C7_calculated_columns": _columns(
            "full_name", "usage_locations", "usage_count", "calculation_type", "calculation_expression",
            where="column_key LIKE 'CALC.%'",
        ),
        "C8_relation_output_columns": _facts(
            lambda a: _is_output(a).select("stmt", "column_key", "usage_count", "is_calculation", "calculation_type")
        ),
        "C9_column_dependencies": _facts(lambda a: a.edges),
        "C10_using_columns": _facts(lambda a: a.using.select("stmt", _key("table", "column"))),
        "C11_qualified_alias_refs": _facts(_alias_refs),
        "C12_exposed_alias_hints": _facts(_exposed),
        "C13_preferred_table_alias": _columns("column_key", "table_alias", where="table_alias IS NOT NULL"),
        "C14_cte_mention_bump": _facts(_of_ctes),
        "C15_query_columns": _columns(
            "column_key", "full_name", "table", "table_alias", "column_name", "aliases", "column_aliases",
            "usage_locations", "usage_count", "is_calculation", "calculation_type", "calculation_expression",
            "dependencies",
        ),
        "C16_column_table_enrichment": _facts(
            lambda a: a.enriched.select("stmt", "column_key", "schema", "table_name", "object_type")
        ),
        "M1_query_statistics": _facts(_statistics),
        "M1_corpus_statistics": _corpus(lambda a: reports.corpus_statistics(a.statistics, a.texts)),
        "M2_statistics_rows": _corpus(lambda a: reports.statistics_rows(a.per_query(a.statistics), "query_id")),
        "M3_columns_view": _facts(lambda a: reports.columns_view(a.enriched)),
        "M4_tables_view": _facts(lambda a: reports.tables_view(a.tables)),
        "M5_lineage_view": _facts(lambda a: reports.lineage_view(a.columns)),
        "M6_filter_calculation": _facts(
            lambda a: a.columns.select(
                "stmt", "column_key", comma_list(filter_calculation(F.col("usage_locations"))).alias("usage")
            )
        ),
        "M7_columns_sample_text": _facts(lambda a: reports.columns_sample_text(a.texts, a.columns)),
        "M8_text_report": _facts(_report),
        "M9_search_columns": _facts(
            lambda a: reports.search_metadata(reports.columns_view(a.enriched), "LEAKS", "stmt")
        ),
        "M9_search_columns_indexed": _searched,
        "M9_search_tables": _facts(lambda a: reports.search_metadata(reports.tables_view(a.tables), "LEAKS", "stmt")),
        "M10_sort_view": _sorted_columns,
        "M10_number_sorted_view": _numbered_columns,
        "M11_run_summary": _facts(lambda a: reports.run_summary(a.texts, a.statistics)),
        "K1_json_documents": _corpus(
            lambda a: writers.whole_documents(a.per_query(writers.document_bodies(a.texts, a.statistics, a.tables, a.columns)), "query_id")
        ),
        "K2_csv_tables": _facts(lambda a: writers.csv_tables(a.tables)),
        "K3_csv_columns": _facts(lambda a: writers.csv_columns(a.enriched)),
        "K4_text_output": _text_read_back,
        "K5_text_sheet": _corpus(
            lambda a: reports.line_rows(a.per_query(reports.text_line_lists(a.texts, a.tables, a.columns, oracle.REPORT_TIME)), "query_id")
        ),
        "K5_sheet_set": _sheets_read_back,
        "K6_escape_source_text": _source,
        "K7_tsv_summary": _facts(lambda a: writers.tsv_summary(a.enriched)),
        "K8_write_metadata": _json_read_back,
    }


def oracle_sql() -> dict[str, str]:
    """Expected results as DuckDB SQL, for each query that SQL can express."""
    found = oracle.all_sql()
    if more := _training_data():
        operators, pipeline = more
        found |= operators.oracle_sql()
        if pipeline.ORACLE_SQL:
            found["pipeline"] = pipeline.ORACLE_SQL
    return found
