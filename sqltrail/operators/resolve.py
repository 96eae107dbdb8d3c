"""Which column a mention means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltrail.operators import tokens as tk

UNKNOWN = "UNKNOWN"
CALC = "CALC"
ALIAS_CLAUSES = ("ORDER BY", "GROUP BY", "HAVING")


def scope_tables(references: DataFrame, around: DataFrame) -> DataFrame:
    """``(stmt, scope, alias, name, pos)``: tables under the FROM and JOINs of a SELECT.

    Tables inside its derived tables and ON subqueries count too.
    """
    under = F.col("clause").isin(*tk.TABLE_CLAUSES) & F.col("scope").isNotNull()
    own = F.when(under, F.array("scope")).otherwise(F.array().cast("array<int>"))
    outer = F.filter("around", lambda p: p.clause.isin(*tk.TABLE_CLAUSES) & p.scope.isNotNull())
    scopes = F.concat(own, F.coalesce(F.transform(outer, lambda p: p.scope), F.array().cast("array<int>")))
    return (
        references.join(around, ["stmt", "qid"], "left")
        .select("stmt", "alias", "name", "pos", F.explode(scopes).alias("scope"))
        .select("stmt", "scope", "alias", "name", "pos")
    )


def column_mentions(lex: DataFrame, tables: DataFrame, around: DataFrame) -> DataFrame:
    """Mentions with the owner their own SELECT gives them, before any projection map.

    ``holders`` lists the select items a mention stands in, own SELECT and outer ones.
    """
    parts = F.col("parts")
    written = F.element_at(parts, -1)
    mentions = lex.where(F.col("role") == "column").select(
        "stmt",
        "pos",
        "qid",
        "scope",
        "alias_scope",
        "clause",
        "places",
        "calc",
        F.try_element_at(parts, F.lit(-2)).alias("qualifier"),
        F.when(written == "_star_", "*").otherwise(written).alias("column"),
        written.alias("written"),
        F.when(F.col("clause") == "SELECT", F.struct("scope", "item")).alias("holder"),
    )
    # R3 needs to know only whether a scope has one distinct table name; of tables under
    # the same alias the last one counts.
    named = F.struct("pos", "alias", "name")
    scopes = tables.groupBy("stmt", "scope").agg(
        F.min("name").alias("low"),
        F.max("name").alias("high"),
        F.array_sort(F.collect_list(F.when(F.col("alias").isNotNull(), named))).alias("named"),
    )
    aliased = F.try_element_at(F.filter("named", lambda t: t["alias"] == F.col("qualifier")), F.lit(-1)).getField("name")
    single = F.when(F.col("low") == F.col("high"), F.col("low"))
    outer_items = around.select(
        "stmt",
        "qid",
        F.transform(
            F.filter("around", lambda p: p.clause == "SELECT"),
            lambda p: F.struct(p.scope.alias("scope"), p.item.alias("item")),
        ).alias("outer_items"),
    )
    own = F.filter(F.array("holder"), lambda h: h.isNotNull())
    return (
        mentions.join(scopes, ["stmt", "scope"], "left")
        .join(outer_items, ["stmt", "qid"], "left")
        .withColumn(
            "base_table",
            F.when(F.col("qualifier").isNotNull(), F.coalesce(aliased, "qualifier")).otherwise(
                F.coalesce(single, F.lit(UNKNOWN))
            ),
        )
        .withColumn("holders", F.when(F.col("outer_items").isNull(), own).otherwise(F.concat(own, "outer_items")))
        .drop("low", "high", "named", "outer_items")
    )


def select_items(lex: DataFrame) -> DataFrame:
    """Select list items: alias, calculation at the top of the expression, extent."""
    c = F.col
    pos = c("pos")
    operand = ~c("delimiter")
    tokens = lex.where(c("own") & (c("clause") == "SELECT") & c("scope").isNotNull())
    first = F.struct("w", "n1w", "tok", "role", "typed_literal", "parts")

    def has(condition: Column) -> Column:
        return F.max(F.coalesce(condition, F.lit(False)))

    items = tokens.groupBy("stmt", "qid", "scope", "item").agg(
        F.max_by("alias_name", F.when(c("is_alias"), pos)).alias("alias"),
        has(c("w").isin(*tk.PREDICATES)).alias("predicate"),
        has(c("w") == "||").alias("joined"),
        has(c("arithmetic")).alias("arithmetic"),
        has(c("w") == "::").alias("cast"),
        has(c("w") == "OVER").alias("over"),
        has((c("w") == "WITHIN GROUP") | ((F.upper("tok") == "FILTER") & (c("n1w") == "("))).alias("wrapped"),
        F.min_by(first, F.when(operand, pos)).alias("first"),
        F.min_by("bracket_type", F.when(c("bracket_type").isNotNull(), pos)).alias("bracket_type"),
        F.count(F.when(operand, 1)).alias("operands"),
        F.min(F.when(operand, pos)).alias("lo"),
        F.max(F.when(operand, pos)).alias("hi"),
    )
    top = (
        F.when(c("predicate") | c("joined"), None)
        .when(c("arithmetic"), "ARITHMETIC")
        .when(c("cast"), "CAST")
        .when(c("over"), "WINDOW")
        .when(c("wrapped"), None)
        .when(c("first.w") == "CASE", "CASE")
        .when(c("first.w").isin(*tk.NAMES) & (c("first.n1w") == "("), c("bracket_type"))
        .when((c("first.w") == "call") & (c("operands") == 1), tk.lookup(tk.BARE_FUNCTIONS, F.upper("first.tok")))
        .when(c("first.typed_literal") & (c("operands") == 2), "CAST")
    )
    bare = (c("operands") == 1) & (c("first.role") == "column")
    return items.where(c("operands") > 0).select(
        "stmt",
        "qid",
        "scope",
        "item",
        "alias",
        F.coalesce(bare, F.lit(False)).alias("bare"),
        F.coalesce("alias", F.when(bare, F.element_at("first.parts", -1))).alias("output"),
        F.when(top.isNotNull(), F.struct(top.alias("type"), "lo", "hi", F.lit(None).cast("int").alias("open"))).alias("calc"),
    )


def relation_items(items: DataFrame, lex: DataFrame) -> DataFrame:
    """Items that are outputs of a CTE or derived table whose body is one plain SELECT."""
    bodies = lex.where(F.col("role").isin("cte", "derived") & F.col("alias").isNotNull() & F.col("body").isNotNull()).select(
        "stmt", F.col("body").alias("qid"), F.col("alias").alias("relation"), F.col("pos").alias("relation_pos"), (F.col("role") == "cte").alias("is_cte")
    )
    unions = lex.where(F.col("own") & (F.col("w") == "SETOP")).select("stmt", "qid").distinct()
    return (
        items.where(F.col("output").isNotNull())
        .join(bodies.join(unions, ["stmt", "qid"], "left_anti"), ["stmt", "qid"])
        .select("stmt", "scope", "item", "output", "calc", "relation", "relation_pos", "is_cte")
    )


def relation_sources(mentions: DataFrame, outputs: DataFrame) -> DataFrame:
    """First source column of each relation output, as the output's own SELECT names it."""
    held = mentions.select("stmt", "pos", "qualifier", "column", "base_table", F.inline_outer("holders"))
    first = held.groupBy("stmt", "scope", "item").agg(
        F.min_by(F.struct("qualifier", "column", "base_table"), "pos").alias("source")
    )
    return outputs.join(first, ["stmt", "scope", "item"]).select(
        "stmt", "scope", "item", "output", "calc", "relation", "relation_pos", "is_cte", "source.*"
    )


def last_by_output(projections: DataFrame) -> DataFrame:
    """Source of each output by name; a later definition replaces an earlier one."""
    source = F.struct("source_table", "source_column")
    order = F.struct("relation_pos", "item")
    return projections.groupBy("stmt", F.col("relation").alias("qualifier"), F.col("output").alias("column")).agg(
        F.max_by(source, F.when(~F.col("is_cte"), order)).alias("from_derived"),
        F.max_by(source, F.when(F.col("is_cte"), order)).alias("from_cte"),
    )


def numbered_outputs(sources: DataFrame) -> DataFrame:
    """Relation outputs of a statement numbered: those of derived tables before those of CTEs, then in text order."""
    order = ("is_cte", "relation_pos", "item", "scope", "relation", "output")
    return sources.withColumn("number", F.row_number().over(Window.partitionBy("stmt").orderBy(*order)) - 1)


def earlier_outputs(rows: DataFrame) -> DataFrame:
    """``(stmt, number, parent)``: the output before it that a CTE output names, the last one of a derived table or else of a CTE."""
    c = F.col
    named = rows.select("stmt", c("relation").alias("qualifier"), c("output").alias("column"), c("number").alias("earlier"), c("is_cte").alias("from_cte"))
    return (
        rows.where("is_cte")
        .select("stmt", "qualifier", "column", "number")
        .join(named, ["stmt", "qualifier", "column"])
        .where("earlier < number")
        .groupBy("stmt", "number")
        .agg(F.max_by("earlier", F.struct(~c("from_cte"), "earlier")).alias("parent"))
    )


def projection_map(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Every relation output with the column it stands for.

    A derived table maps to what its own SELECT names. A CTE may name a derived table or an
    earlier CTE; ``ends`` has the output at the end of such a chain, whose own source it is.
    """
    c = F.col
    root = ends.withColumnRenamed("parent", "root")
    own = rows.select("stmt", c("number").alias("root"), c("base_table").alias("root_table"), c("column").alias("root_column"))
    return (
        rows.join(root, ["stmt", "number"], "left")
        .join(own, ["stmt", "root"], "left")
        .select(
            "stmt", "is_cte", "relation_pos", "item", "scope", "relation", "output", "calc",
            F.coalesce("root_table", "base_table").alias("source_table"),
            F.when(c("root").isNotNull(), c("root_column")).otherwise(c("column")).alias("source_column"),
        )
    )


def resolve_mentions(
    mentions: DataFrame, projections: DataFrame, items: DataFrame, names: DataFrame
) -> DataFrame:
    """Final ``(key_table, key_column)`` of every mention.

    Order: derived-table map, CTE map, alias or name in the own SELECT; for a bare name in
    ORDER BY, GROUP BY or HAVING the select aliases of that SELECT come first.
    """
    c = F.col
    flagged = names.select("stmt", c("name").alias("qualifier"), F.lit(True).alias("qualifier_is_cte"))
    own_item = items.select(
        "stmt",
        c("scope").alias("item_scope"),
        c("item").alias("own_item"),
        (c("bare") | c("alias").isNotNull()).alias("shown"),
    )
    mapped = (
        mentions.join(last_by_output(projections), ["stmt", "qualifier", "column"], "left")
        .join(flagged, ["stmt", "qualifier"], "left")
        .withColumn("item_scope", c("holder.scope"))
        .withColumn("own_item", c("holder.item"))
        .join(own_item, ["stmt", "item_scope", "own_item"], "left")
        .withColumn("mapped_table", F.coalesce("from_derived.source_table", "from_cte.source_table", "base_table"))
        .withColumn("mapped_column", F.coalesce("from_derived.source_column", "from_cte.source_column", "column"))
        .withColumn("qualifier_is_cte", F.coalesce("qualifier_is_cte", F.lit(False)))
        .withColumn("through_cte", c("qualifier_is_cte") & c("from_cte").isNotNull())
        .drop("from_derived", "from_cte")
    )
    first = (
        mapped.select("stmt", "pos", "mapped_table", "mapped_column", F.inline_outer("holders"))
        .groupBy("stmt", "scope", "item")
        .agg(F.min_by(F.struct("mapped_table", "mapped_column"), "pos").alias("source"), F.min("pos").alias("first_pos"))
    )
    aliases = (
        items.where(c("alias").isNotNull())
        .join(first, ["stmt", "scope", "item"], "left")
        .groupBy("stmt", c("scope").alias("alias_scope"), c("alias").alias("column"))
        .agg(
            F.max(c("calc").isNotNull()).alias("calculated"),
            F.min_by("source", "first_pos").alias("source"),
            F.lit(True).alias("is_alias"),
        )
    )
    clause = c("clause").isin(*ALIAS_CLAUSES) & c("qualifier").isNull()
    hit = clause & c("is_alias").isNotNull()
    key_table = F.when(
        hit, F.when(c("calculated"), CALC).otherwise(c("source.mapped_table"))
    ).otherwise(c("mapped_table"))
    key_column = F.when(
        hit, F.when(c("calculated"), c("column")).otherwise(c("source.mapped_column"))
    ).otherwise(c("mapped_column"))
    shown = F.when(F.coalesce("shown", F.lit(False)), F.array(F.lit("SELECT"))).otherwise(F.array().cast("array<string>"))
    places = F.concat("places", shown)
    return (
        mapped.join(aliases, ["stmt", "alias_scope", "column"], "left")
        .withColumn("key_table", key_table)
        .withColumn("key_column", key_column)
        .withColumn("by_alias", hit)
        .withColumn("places", F.when(F.size(places) == 0, F.array(F.lit("UNKNOWN"))).otherwise(F.array_sort(F.array_distinct(places))))
        .select(
            "stmt", "pos", "qualifier", "column", "scope", "clause", "places", "calc", "holders",
            "base_table", "mapped_table", "mapped_column", "qualifier_is_cte", "through_cte",
            "key_table", "key_column", "by_alias",
        )
    )
