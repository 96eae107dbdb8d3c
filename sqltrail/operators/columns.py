"""Column facts from resolved mentions.

Everything that says something about a column is turned into a contribution row: a
mention, an alias, a definition, a dependency. One aggregate per ``(stmt, column)``
merges them, so the facts need one grouping however many operators feed them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltrail.functions.text import sorted_set
from sqltrail.operators.resolve import CALC, UNKNOWN
from sqltrail.operators.tokens import token_pieces

CALC_TYPE = "struct<open:int,type:string,lo:int,hi:int>"
CONTRIBUTION = (
    "struct<key_table:string,key_column:string,mentions:bigint,rank:bigint,places:array<string>,"
    "aliases:array<string>,column_aliases:array<string>,qualifier:string,qualifier_is_cte:boolean,"
    f"mentioned:boolean,relation_output:boolean,hinted:boolean,calc:{CALC_TYPE},calc_rank:bigint,depends_on:string>"
)
# Relation outputs exist before any mention is read.
BEFORE_MENTIONS = -(1 << 40)


def contribution(table: Column, column: Column, **fields: Column) -> Column:
    """One contribution; fields that are not given are empty."""
    empty_list = F.array().cast("array<string>")
    defaults = {
        "mentions": F.lit(0),
        "rank": F.lit(0),
        "places": empty_list,
        "aliases": empty_list,
        "column_aliases": empty_list,
        "qualifier": F.lit(None),
        "qualifier_is_cte": F.lit(False),
        "mentioned": F.lit(False),
        "relation_output": F.lit(False),
        "hinted": F.lit(False),
        "calc": F.lit(None),
        "calc_rank": F.lit(0),
        "depends_on": F.lit(None),
    }
    values = {**defaults, **fields}
    return F.struct(
        table.alias("key_table"), column.alias("key_column"), *[v.alias(k) for k, v in values.items()]
    ).cast(CONTRIBUTION)


def calc_struct(calc: str) -> Column:
    c = F.col
    return F.when(
        c(calc).isNotNull(),
        F.struct(c(f"{calc}.open").alias("open"), c(f"{calc}.type").alias("type"), c(f"{calc}.lo").alias("lo"), c(f"{calc}.hi").alias("hi")),
    )


def dotted(table: Column, column: Column) -> Column:
    return F.concat(table, F.lit("."), column)


def spread(rows: DataFrame, *contributions: Column) -> DataFrame:
    """Contribution rows of each input row; null ones are left out.

    An outer generator, as a plain one makes the optimizer build every array twice, once
    only to see that it is not empty.
    """
    present = F.filter(F.array(*contributions), lambda x: x.isNotNull())
    return rows.select("stmt", F.inline_outer(present)).where(
        F.col("key_table").isNotNull() & F.col("key_column").isNotNull()
    )


def mention_contributions(mentions: DataFrame) -> DataFrame:
    """The mention itself. C14: the CTE column it also counts for."""
    c = F.col
    foreign = c("qualifier").isNotNull() & (c("qualifier") != c("key_table"))
    itself = contribution(
        c("key_table"),
        c("key_column"),
        mentions=F.lit(1),
        rank=c("pos"),
        places=c("places"),
        aliases=F.when(foreign, F.array(dotted(c("qualifier"), c("key_column")))).otherwise(F.array().cast("array<string>")),
        qualifier=c("qualifier"),
        qualifier_is_cte=c("qualifier_is_cte"),
        mentioned=F.lit(True),
        calc=calc_struct("calc"),
        calc_rank=c("pos"),
    )
    apart = (c("qualifier") != c("key_table")) | (c("column") != c("key_column"))
    bump = F.when(
        c("through_cte") & apart,
        contribution(c("qualifier"), c("column"), mentions=F.lit(1), rank=c("pos"), places=c("places")),
    )
    return spread(mentions, itself, bump)


def held_mentions(mentions: DataFrame, items: DataFrame, projections: DataFrame) -> DataFrame:
    """Mentions paired with the select items they stand in, outer items included."""
    outputs = projections.select("stmt", "scope", "item", "relation", "output", "is_cte")
    return (
        mentions.select(
            "stmt", "pos", "key_table", "key_column", "base_table", "column", "mapped_table", "mapped_column", F.inline_outer("holders")
        )
        .join(items.select("stmt", "scope", "item", "alias", F.col("calc").isNotNull().alias("calculated")), ["stmt", "scope", "item"])
        .join(outputs, ["stmt", "scope", "item"], "left")
    )


def item_contributions(held: DataFrame) -> DataFrame:
    """Alias of a plain item. C9: what calculated items and relation outputs read."""
    c = F.col
    alias = F.when(
        c("alias").isNotNull() & ~c("calculated"),
        contribution(
            c("key_table"), c("key_column"), rank=c("pos"), aliases=F.array("alias"), column_aliases=F.array("alias")
        ),
    )
    reads = F.when(
        c("alias").isNotNull() & c("calculated"),
        contribution(F.lit(CALC), c("alias"), depends_on=dotted(c("key_table"), c("key_column"))),
    )
    source = F.when(c("is_cte"), dotted(c("mapped_table"), c("mapped_column"))).otherwise(
        dotted(c("base_table"), c("column"))
    )
    exposes = F.when(c("relation").isNotNull(), contribution(c("relation"), c("output"), depends_on=source))
    return spread(held, alias, reads, exposes)


def definition_contributions(items: DataFrame) -> DataFrame:
    """A calculated item with an alias is a column of its own."""
    c = F.col
    defined = contribution(
        F.lit(CALC),
        c("alias"),
        mentions=F.lit(1),
        rank=c("item"),
        places=F.array(F.lit("SELECT")),
        aliases=F.array("alias"),
        calc=calc_struct("calc"),
        # The first of several definitions gives the type.
        calc_rank=F.lit(BEFORE_MENTIONS) - c("item"),
    )
    return spread(items.where(c("alias").isNotNull() & c("calc").isNotNull()), defined)


def output_contributions(projections: DataFrame) -> DataFrame:
    """Columns of CTEs and derived tables. C12: their name on the source column."""
    c = F.col
    name = dotted(c("relation"), c("output"))
    output = contribution(
        c("relation"),
        c("output"),
        mentions=F.lit(1),
        rank=F.lit(BEFORE_MENTIONS) + c("relation_pos"),
        places=F.array(F.lit("SELECT")),
        aliases=F.array(name),
        qualifier=c("relation"),
        qualifier_is_cte=c("is_cte"),
        relation_output=F.lit(True),
        calc=calc_struct("calc"),
        calc_rank=F.lit(BEFORE_MENTIONS) + c("relation_pos"),
    )
    hint = contribution(c("source_table"), c("source_column"), aliases=F.array(name), hinted=F.lit(True))
    return spread(projections, output, hint)


def using_mentions(lex: DataFrame, tables: DataFrame) -> DataFrame:
    """``(stmt, pos, table, column)`` for every table of the SELECT, per USING name."""
    names = lex.where((F.col("role") == "using") & F.col("scope").isNotNull()).select(
        "stmt", "pos", "scope", F.element_at("parts", -1).alias("column")
    )
    owners = tables.select("stmt", "scope", F.col("name").alias("table")).distinct()
    return names.join(owners, ["stmt", "scope"]).select("stmt", "pos", "table", "column")


def using_contributions(using: DataFrame) -> DataFrame:
    joined = contribution(
        F.col("table"), F.col("column"), mentions=F.lit(1), rank=F.col("pos"), places=F.array(F.lit("JOIN"))
    )
    return spread(using, joined)


def expression_text(lo: Column, hi: Column, tokens: Column) -> Column:
    """Source tokens of an expression, joined as readable text."""
    return F.ltrim(F.array_join(token_pieces(tokens, lo, hi), ""))


def merge_columns(contributions: DataFrame, closes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Contributions to ``query_columns``, one row per column of a statement."""
    c = F.col

    def united(name: str) -> Column:
        return F.flatten(F.collect_list(name))

    merged = (
        contributions.groupBy("stmt", "key_table", "key_column")
        .agg(
            F.sum("mentions").alias("usage_count"),
            united("places").alias("places"),
            united("aliases").alias("aliases"),
            united("column_aliases").alias("column_aliases"),
            F.collect_set("depends_on").alias("dependencies"),
            F.min_by(F.struct("qualifier"), F.when(c("mentioned"), c("rank"))).alias("created"),
            F.min_by("qualifier", F.when(c("qualifier").isNotNull(), F.struct("qualifier_is_cte", "rank"))).alias("table_alias"),
            F.max("relation_output").alias("relation_output"),
            F.max("hinted").alias("hinted"),
            F.max_by("calc", F.when(c("calc").isNotNull(), c("calc_rank"))).alias("calc"),
        )
        .where(c("usage_count") > 0)
    )
    owned = ~c("key_table").isin(UNKNOWN, CALC)
    key = dotted(c("key_table"), c("key_column"))
    full_name = F.when(owned, key).otherwise(c("key_column"))
    creation = F.when(
        ~c("relation_output") & c("created.qualifier").isNotNull(), F.array(dotted(c("created.qualifier"), c("key_column")))
    ).otherwise(F.array().cast("array<string>"))
    aliases = F.concat("aliases", creation)
    calculated = c("calc").isNotNull()
    ends = closes.select("stmt", c("closes_calc").alias("calc_open"), c("pos").alias("calc_close"))
    return (
        merged.withColumn("calc_open", F.when(c("calc.hi").isNull(), c("calc.open")))
        .join(ends, ["stmt", "calc_open"], "left")
        # Only calculated columns meet the token list of their statement.
        .join(tokens.withColumnRenamed("stmt", "text_stmt"), (c("stmt") == c("text_stmt")) & calculated, "left")
        .select(
            "stmt",
            key.alias("column_key"),
            full_name.alias("full_name"),
            F.when(owned, c("key_table")).alias("table"),
            "table_alias",
            c("key_column").alias("column_name"),
            sorted_set(F.when(c("hinted"), F.array_remove(aliases, full_name)).otherwise(aliases)).alias("aliases"),
            sorted_set(c("column_aliases")).alias("column_aliases"),
            sorted_set(c("places")).alias("usage_locations"),
            "usage_count",
            calculated.alias("is_calculation"),
            c("calc.type").alias("calculation_type"),
            F.when(
                calculated, expression_text(c("calc.lo"), F.coalesce("calc.hi", "calc_close"), c("tokens"))
            ).alias("calculation_expression"),
            sorted_set(c("dependencies")).alias("dependencies"),
        )
    )


def column_edges(columns: DataFrame) -> DataFrame:
    """``(column_key, depends_on)``, one row per pair."""
    return columns.select("stmt", "column_key", F.explode("dependencies").alias("depends_on"))


def enrich_with_tables(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Schema, bare table name and object type of each column.

    A name of the form ``schema.table`` looks for both parts, then for the name alone; the
    table found first wins.
    """
    c = F.col
    split = c("table").contains(".")
    columns = columns.withColumn(
        "table_schema", F.when(split, F.substring_index("table", ".", 1))
    ).withColumn(
        "table_name",
        F.when(split, F.substring(c("table"), F.instr("table", ".") + 1, F.length("table"))).otherwise(c("table")),
    )
    by_name = tables.groupBy("stmt", c("name").alias("table_name")).agg(
        F.min_by(F.struct("schema", "table_type"), "rank").alias("named")
    )
    by_both = (
        tables.where(c("schema").isNotNull())
        .groupBy("stmt", c("schema").alias("table_schema"), c("name").alias("table_name"))
        .agg(F.min_by("table_type", "rank").alias("exact_type"))
    )
    return (
        columns.join(by_both, ["stmt", "table_schema", "table_name"], "left")
        .join(by_name, ["stmt", "table_name"], "left")
        .withColumn("object_type", F.coalesce("exact_type", "named.table_type", F.lit("")))
        .withColumn("schema", F.coalesce("table_schema", "named.schema", F.lit("")))
        .withColumn("table_name", F.coalesce("table_name", F.lit("")))
        .drop("exact_type", "named", "table_schema")
    )
