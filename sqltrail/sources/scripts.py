"""SQL scripts split into statements, whole texts in a row or files of any size over many tasks.

A file is read as segments between semicolons, wherever its blocks are cut. Whether a semicolon ends a
statement depends on all text before it, so each segment is read from every state in which it could begin:
plain, or inside what a quote, a bracket, a comment or a dollar tag has opened. That gives a small map from
state to state. Maps of ``FAN`` neighbours compose to one, level by level, up to one map for each file; on the way
back down each level learns the state its parts begin in. Rounds grow with the logarithm of the
segments, no task holds a file, and no row is larger than its statement.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqltrail.operators.tokens import BACKSLASH_DIALECTS
from sqltrail.plans.stages import Stages

# Segments, or maps of one level, that one row of the next level composes.
FAN = 256
PLAIN = ""
TAG = r"\$\w*+\$"
# What stands in each state up to and with its end. A dollar tag ends at itself.
INSIDE = {
    "--": r"[^\n]*+\n",
    "/*": r"(?:[^*]++|\*(?!/))*+\*/",
    "'": r"[^']*+(?:''[^']*+)*+'",
    '"': r'[^"]*+(?:""[^"]*+)*+"',
    "`": r"[^`]*+`",
    "[": r"[^\]]*+\]",
}
BEGIN = {"--": "--", "/*": r"/\*", "'": "'", '"': '"', "`": "`", "[": r"\["}
BACKSLASH_INSIDE = r"[^'\\]*+(?:(?:''|\\.)[^'\\]*+)*+'"
# Words take the dollars in them along; a lone opening character is plain text.
OUTSIDE = rf"\w[\w$]*+|[^\w;'\"`\[$/-]++|-(?!-)|/(?!\*)|\$(?!\w*+\$)"
OPENER = "|".join((*BEGIN.values(), TAG))
DOLLAR_QUOTED = r"\$(?<tag>\w*+)\$.*?\$\k<tag>\$"


def escapes(dialect: Column) -> Column:
    """Whether a backslash escapes in a literal."""
    return F.coalesce(dialect.isin(*BACKSLASH_DIALECTS), F.lit(False))


def _inside(backslash: bool) -> dict[str, str]:
    return INSIDE | {"'": BACKSLASH_INSIDE} if backslash else INSIDE


def closed(backslash: bool) -> str:
    """Pattern of whatever ends where it began: plain text, literals, quoted names, comments."""
    quoted = (BEGIN[opener] + rest for opener, rest in _inside(backslash).items())
    return "|".join((OUTSIDE, *quoted, DOLLAR_QUOTED))


def statement_pattern(backslash: bool) -> str:
    """Pattern of one statement of a text; what is never closed runs to the end of the text, or to a semicolon there."""
    return rf"(?s)(?:{closed(backslash)}|(?:{OPENER})(?:[^;]++|;(?!\z))*+)++"


def statements_of(sql: Column, dialect: Column) -> Column:
    """The statements of a text as an array, those of white space left out."""

    def found(backslash: bool) -> Column:
        return F.regexp_extract_all(sql, F.lit(statement_pattern(backslash)), F.lit(0))

    return F.filter(F.when(escapes(dialect), found(True)).otherwise(found(False)), lambda x: x.rlike(r"\S"))


def _end(text: Column, backslash: bool) -> Column:
    """The state after a text that begins plain."""
    return F.regexp_extract(F.regexp_replace(text, rf"(?s)\A(?:{closed(backslash)})*+", ""), rf"\A(?:{OPENER})", 0)


def segment_map(text: Column, backslash: bool) -> Column:
    """What a segment does: map from the state it begins in to ``(state, more)``, ``more`` statements begun.

    States that the map does not name stay as they are and begin nothing: a dollar tag is left only in a
    segment that holds it.
    """

    def entry(key: Column, state: Column, more: Column) -> Column:
        return F.struct(key.alias("key"), F.struct(state.alias("state"), more.cast("bigint").alias("more")).alias("value"))

    none = F.lit(0)
    entries = [entry(F.lit(PLAIN), _end(text, backslash), text.rlike(r"\S").cast("int"))]
    for opener, rest in _inside(backslash).items():
        rest = rf"(?s)\A{rest}"
        left = F.when(text.rlike(rest), _end(F.regexp_replace(text, rest, ""), backslash)).otherwise(F.lit(opener))
        entries.append(entry(F.lit(opener), left, none))
    tags = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$(?=(\w*+)\$)"), F.lit(1)))

    def leave(name: Column) -> Column:
        tag = F.concat(F.lit("$"), name, F.lit("$"))
        return entry(tag, _end(F.substr(text, F.instr(text, tag) + F.length(tag)), backslash), none)

    return F.map_from_entries(F.concat(F.array(*entries), F.transform(tags, leave)))


def _after(ends: Column, state: Column, more: Column) -> Column:
    step = F.try_element_at(ends, state)
    return F.struct(F.coalesce(step.state, state).alias("state"), (more + F.coalesce(step.more, F.lit(0))).alias("more"))


def _in_order(rows: DataFrame) -> DataFrame:
    """``(file, n, parts)``: rows of ``FAN`` neighbours gathered in order."""
    above = F.floor(F.col("n") / FAN).alias("above")
    parts = F.array_sort(F.collect_list(F.struct("n", "ends")), lambda a, b: (a.n - b.n).cast("int"))
    return rows.groupBy("file", above).agg(parts.alias("parts")).withColumnRenamed("above", "n")


def _composed(rows: DataFrame) -> DataFrame:
    """One map for the rows of each group, from every state that one of them names."""
    keys = F.array_distinct(F.flatten(F.transform("parts", lambda p: F.map_keys(p.ends))))
    start = F.transform(keys, lambda k: F.struct(k.alias("key"), F.struct(k.alias("state"), F.lit(0).cast("bigint").alias("more")).alias("value")))
    walked = F.aggregate(
        "parts",
        start,
        lambda acc, p: F.transform(acc, lambda a: F.struct(a.key.alias("key"), _after(p.ends, a.value.state, a.value.more).alias("value"))),
    )
    return _in_order(rows).select("file", "n", F.map_from_entries(walked).alias("ends"))


def _begun(rows: DataFrame, above: DataFrame) -> DataFrame:
    """The state in which each row begins, and the statements begun before it, from those of the groups."""
    start = F.struct(
        F.struct("state", "more").alias("now"),
        F.expr("CAST(array() AS array<struct<n: bigint, state: string, more: bigint>>)").alias("rows"),
    )
    walked = F.aggregate(
        "parts",
        start,
        lambda acc, p: F.struct(
            _after(p.ends, acc.now.state, acc.now.more).alias("now"),
            F.concat(acc.rows, F.array(F.struct(p.n.alias("n"), acc.now.state.alias("state"), acc.now.more.alias("more")))).alias("rows"),
        ),
        lambda acc: acc.rows,
    )
    return _in_order(rows).join(above, ["file", "n"]).select("file", F.explode(walked).alias("row")).select("file", "row.*")


def _segments(files: DataFrame, stages: Stages, name: str, backslash: bool) -> DataFrame:
    """``(file, n, text, ends)``: segments of each file, numbered from 0, written once."""
    rows = files.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("text"),
    )
    stages.write(name, lambda: rows.withColumn("ends", segment_map(F.col("text"), backslash)))
    rows = stages.read(name, stages.spark)
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before")).alias("n"), "text", "ends")


def split_files(spark: SparkSession, path: str, stages: Stages, dialect: str) -> DataFrame:
    """``(file, part, sql)``: every statement of the ``.sql`` and ``.txt`` files under a path, part 0 the first.

    Equal to ``statements_of`` on each whole file, but a file without any statement gives no row. ``stages`` holds the
    segments until it is deleted. A statement is one row; so is a literal without semicolons, however long.
    """
    backslash = dialect in BACKSLASH_DIALECTS
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{sql,txt}").option("lineSep", ";").text(path)
    run = f"scripts-{uuid.uuid4().hex}"
    segments = _segments(files, stages, f"{run}-segments", backslash)
    last = segments.agg(F.max("n")).first()[0] or 0
    levels = [segments.select("file", "n", "ends")]
    while last >= FAN:
        last //= FAN
        name = f"{run}-level-{len(levels)}"
        below = levels[-1]
        stages.write(name, lambda below=below: _composed(below))
        levels.append(stages.read(name, spark))
    top = levels[-1].select("file").distinct()
    top = top.select("file", F.lit(0).cast("bigint").alias("n"), F.lit(PLAIN).alias("state"), F.lit(0).cast("bigint").alias("more"))
    begun = reduce(lambda above, rows: _begun(rows, above), reversed(levels), top)
    plain = F.col("state") == PLAIN
    placed = (
        segments.join(begun, ["file", "n"])
        .where(~plain | F.col("text").rlike(r"\S"))
        .select(
            "file", "n", "text",
            F.when(plain, F.col("more")).otherwise(F.col("more") - 1).alias("part"),
            (plain & (F.col("ends")[PLAIN].state == PLAIN)).alias("whole"),
        )
    )
    # Most statements are one segment and need no further exchange.
    several = placed.where(~F.col("whole")).groupBy("file", "part").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("rows"))
    joined = several.select("file", "part", F.array_join("rows.text", ";").alias("sql"))
    return placed.where("whole").select("file", "part", F.col("text").alias("sql")).unionByName(joined).withColumn("part", F.col("part").cast("int"))
