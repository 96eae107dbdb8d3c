"""Which tables a statement touches, and how."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqltrail.functions.text import sorted_set

# Table type labels and the outer mark pattern.
TABLE = "Таблица"
SUBQUERY = "Подзапрос"
CTE = "CTE"
OUTER_MARK = r"(?U)([A-Z0-9_]+(?:\.[A-Z0-9_]+)?)\s*\(\+\)"

AROUND = "array<struct<scope:int,clause:string,item:int,join_type:string>>"


def cte_definitions(lex: DataFrame) -> DataFrame:
    """A1: ``(stmt, pos, name, body)`` of every CTE."""
    return lex.where((F.col("role") == "cte") & F.col("alias").isNotNull()).select(
        "stmt", "pos", F.col("alias").alias("name"), "body"
    )


def derived_tables(lex: DataFrame) -> DataFrame:
    """A4: ``(stmt, pos, name, body)`` of every aliased subquery in a FROM or JOIN."""
    return lex.where((F.col("role") == "derived") & F.col("alias").isNotNull()).select(
        "stmt", "pos", F.col("alias").alias("name"), "body"
    )


def cte_names(lex: DataFrame) -> DataFrame:
    return cte_definitions(lex).select("stmt", "name").distinct()


def outer_marks(texts: DataFrame) -> DataFrame:
    """``(stmt, qualifier)`` of every ``qualifier.column(+)`` in the raw text."""
    marks = F.regexp_extract_all(F.upper("sql"), F.lit(OUTER_MARK), F.lit(1))
    return (
        texts.where(F.col("sql").contains("(+)"))
        .select("stmt", F.explode(marks).alias("mark"))
        .where(F.col("mark").contains("."))
        .select("stmt", F.split_part("mark", F.lit("."), F.lit(1)).alias("qualifier"))
        .distinct()
    )


def enclosing_scopes(lex: DataFrame, write: Callable[[int, DataFrame], DataFrame]) -> DataFrame:
    """For each subquery, where it and the queries around it stand: ``(stmt, qid, around)``.

    ``around`` runs from the outermost query inwards. A subquery knows the one around it; each round
    puts the list of that one before its own and goes on where that one ends, so the rounds
    grow with the logarithm of the nesting. ``write(step, df)`` stores a round.
    """
    place = F.struct("scope", "clause", "item", "join_type")
    step = 0
    now = write(
        step,
        lex.where("opens_query").select(
            "stmt", F.col("pos").alias("qid"), F.when(F.col("qid") >= 0, F.col("qid")).alias("outer"), F.array(place).cast(AROUND).alias("around")
        ),
    )
    while not now.where("outer IS NOT NULL").isEmpty():
        step += 1
        further = now.select("stmt", F.col("qid").alias("outer"), F.col("outer").alias("beyond"), F.col("around").alias("before"))
        longer = F.when(F.col("before").isNull(), F.col("around")).otherwise(F.concat("before", "around"))
        now = write(step, now.join(further, ["stmt", "outer"], "left").select("stmt", "qid", F.col("beyond").alias("outer"), longer.alias("around")))
    return now.select("stmt", "qid", "around")


def table_references(lex: DataFrame) -> DataFrame:
    """A2: every mention of a stored table or CTE, with schema and alias as written."""
    parts = F.col("parts")
    return lex.where(F.col("role") == "table").select(
        "stmt",
        "pos",
        F.element_at(parts, -1).alias("name"),
        F.try_element_at(parts, F.lit(-2)).alias("schema"),
        "alias",
        "scope",
        "qid",
        "clause",
        "join_type",
    )


def with_join_types(references: DataFrame, around: DataFrame, marks: DataFrame) -> DataFrame:
    """Own join, else the nearest one around; outer marks override inner or none."""
    joins = around.select(
        "stmt",
        "qid",
        F.try_element_at(F.filter("around", lambda p: p.clause == "JOIN"), F.lit(-1)).join_type.alias("outer_join"),
    ).where(F.col("outer_join").isNotNull())
    own = F.when(F.col("clause") == "JOIN", F.col("join_type"))
    typed = references.join(joins, ["stmt", "qid"], "left").withColumn("join_type", F.coalesce(own, "outer_join"))
    marked = marks.groupBy("stmt").agg(F.collect_set("qualifier").alias("marked"))
    hit = F.array_contains("marked", F.upper("alias")) | F.array_contains("marked", F.upper("name"))
    open_type = F.col("join_type").isNull() | (F.col("join_type") == "INNER JOIN")
    return (
        typed.join(marked, "stmt", "left")
        .withColumn("join_type", F.when(open_type & hit, "LEFT JOIN").otherwise(F.col("join_type")))
        .drop("marked", "outer_join")
    )


def classify_references(references: DataFrame, names: DataFrame) -> DataFrame:
    """A3: a reference named like a CTE of its statement is a CTE."""
    known = names.withColumn("is_cte", F.lit(True))
    return (
        references.join(known, ["stmt", "name"], "left")
        .withColumn("table_type", F.when(F.col("is_cte"), CTE).otherwise(TABLE))
        .drop("is_cte")
    )


def found_tables(references: DataFrame, ctes: DataFrame, derived: DataFrame) -> DataFrame:
    """Every table, CTE and subquery as it was found, by ``step`` (CTEs, references, subqueries) and ``pos``."""

    def named(df: DataFrame, label: str, step: int) -> DataFrame:
        return df.select(
            "stmt",
            F.lit(None).cast("string").alias("schema"),
            "name",
            F.lit(label).alias("table_type"),
            F.col("name").alias("alias"),
            F.lit(None).cast("string").alias("join_type"),
            F.lit(step).alias("step"),
            "pos",
        )

    found = references.select(
        "stmt", "schema", "name", "table_type", "alias", "join_type", F.lit(1).alias("step"), "pos"
    )
    return named(ctes, CTE, 0).unionByName(found).unionByName(named(derived, SUBQUERY, 2))


def upsert_tables(found: DataFrame) -> DataFrame:
    """One row per schema, name and type; aliases united, first join type kept.

    ``rank`` is the order in which the rows were found.
    """
    position = F.struct("step", "pos")
    return found.groupBy("stmt", "schema", "name", "table_type").agg(
        sorted_set(F.collect_set("alias")).alias("aliases"),
        F.min_by("join_type", F.when(F.col("join_type").isNotNull(), position)).alias("join_type"),
        F.min(position).alias("rank"),
    )


def columns_per_table(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Attach column names to the first table of that name."""
    same_name = Window.partitionBy("stmt", "name")
    owned = (
        columns.where(F.col("table").isNotNull())
        .groupBy("stmt", F.col("table").alias("name"))
        .agg(sorted_set(F.collect_set("full_name")).alias("owned"))
    )
    listed = F.when(F.col("rank") == F.min("rank").over(same_name), F.col("owned"))
    return (
        tables.join(owned, ["stmt", "name"], "left")
        .withColumn("columns", F.coalesce(listed, F.array().cast("array<string>")))
        .withColumn("column_count", F.size("columns"))
        .drop("owned")
    )


def unique_tables(tables: DataFrame) -> DataFrame:
    """Distinct tables of each statement with united aliases and columns."""
    keys = ("stmt", "schema", "name", "table_type")
    return tables.groupBy(*keys).agg(
        sorted_set(F.flatten(F.collect_list("aliases"))).alias("aliases"),
        sorted_set(F.flatten(F.collect_list("columns"))).alias("columns"),
    )


def corpus_table_members(tables: DataFrame) -> DataFrame:
    """A9 over the whole log: every alias and column a table goes by, one row each.

    A popular table may stand in a third of all statements under any number of names, so
    its names stay rows and are made distinct, never gathered into one list.
    """
    keys = ("schema", "name", "table_type")
    members = [
        tables.select(*keys, F.lit(part).alias("part"), F.explode(column).alias("value"))
        for part, column in (("alias", "aliases"), ("column", "columns"))
    ]
    return members[0].unionByName(members[1]).distinct()


def table_by_name(tables: DataFrame, name: str, schema: str | None = None) -> DataFrame:
    """A10: exact name and schema; no schema matches only tables without one."""
    return tables.where((F.col("name") == name) & F.col("schema").eqNullSafe(F.lit(schema)))
