"""Statements to be read once each, and back to every query that ran them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltrail.functions.clean import preprocess
from sqltrail.operators import tokens as tk
from sqltrail.operators.neighbours import misplaced

# Rows of (query, fact) that one bucket of a text gives at most, whatever the size of the log.
BUCKET_ROWS = 4_000_000
FACTS = 40
# The list of split texts is broadcast up to this many, and joined by shuffle beyond.
BROADCAST_TEXTS = 1_000_000
# A text becomes token rows of some 400 times its size, so a task gets little text. The driver
# keeps the state of every task, so their number has a ceiling; beyond it tasks grow and spill.
TEXT_BYTES_PER_TASK = 1 << 20
MAX_TASKS = 50_000


def statement_key(sql: Column, dialect: Column) -> Column:
    """Identity of a text in its dialect; null text is its own text."""
    return F.unhex(F.sha2(F.concat_ws("\u0000", dialect, F.coalesce(sql, F.lit("\u0000"))), 256))


def query_keys(statements: DataFrame) -> DataFrame:
    """``(query_id, stmt)``: which text each query ran."""
    return statements.select("query_id", statement_key(F.col("sql"), F.col("dialect")).alias("stmt"))


def distinct_statements(statements: DataFrame) -> DataFrame:
    """One row per text with the number of queries that share it.

    Copies are counted on the map side first, so a text that fills a third of the log
    reaches the exchange as one row per task.
    """
    texts = statements.groupBy("sql", "dialect").agg(F.count(F.lit(1)).alias("copies"))
    return texts.select(statement_key(F.col("sql"), F.col("dialect")).alias("stmt"), "sql", "dialect", "copies")


def clean_statements(texts: DataFrame) -> DataFrame:
    """Add ``sql_clean``, ``tokens`` and ``parse_errors`` (P8, P10). Row-wise, so no exchange.

    A text is tokenised here and nowhere else. The outer generator of one row keeps the optimizer
    from repeating the tokenising in each expression that reads it.
    """
    cleaned = texts.withColumn("sql_clean", preprocess(F.col("sql"), F.col("dialect")))
    once = F.array(F.struct(tk.token_array(F.col("sql_clean"), F.col("dialect")).alias("tokens")))
    tokens = F.col("tokens")
    return (
        cleaned.select("*", F.inline_outer(once))
        .withColumn("parse_errors", tk.structural_errors(F.col("sql"), F.col("sql_clean"), tk.bracket_balance(tokens), misplaced(tokens)))
        .select("stmt", "sql", "dialect", "copies", "sql_clean", "parse_errors", "tokens")
    )


def text_bytes(texts: DataFrame) -> int:
    """Bytes of all texts as they are read; files of texts made from a few templates are some ten times smaller."""
    return texts.agg(F.sum(F.octet_length("sql").cast("bigint"))).first()[0] or 0


def token_partitions(text_bytes: int, at_least: int) -> int:
    """Tasks for the token stage, from the bytes of the texts."""
    return min(MAX_TASKS, max(at_least, -(-text_bytes // TEXT_BYTES_PER_TASK)))


def hot_statements(texts: DataFrame, bucket_rows: int) -> DataFrame:
    """Texts with more copies than one bucket takes, and how many buckets each needs."""
    copies = max(1, bucket_rows // FACTS)
    return texts.where(F.col("copies") > copies).select("stmt", F.ceil(F.col("copies") / copies).cast("int").alias("buckets"))


def per_query(facts: DataFrame, queries: DataFrame, texts: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Facts of a text, repeated for every query that ran it.

    A plain join on ``stmt`` would send all copies of a hot text to one task. Its queries
    are spread over buckets by their id, and its few facts are copied to each bucket. A bucket
    holds a fixed number of rows, so the list of hot texts may grow with the log; it is counted first and
    broadcast only up to ``BROADCAST_TEXTS``.
    """
    hot = hot_statements(texts, bucket_rows)
    if hot.count() <= BROADCAST_TEXTS:
        hot = F.broadcast(hot)
    buckets = F.coalesce(F.col("buckets"), F.lit(1))
    spread = (
        queries.select("query_id", "stmt")
        .join(hot, "stmt", "left")
        .select("query_id", "stmt", F.pmod(F.xxhash64("query_id"), buckets).cast("int").alias("bucket"))
    )
    copied = facts.join(hot, "stmt", "left").withColumn(
        "bucket", F.explode(F.sequence(F.lit(0), buckets - 1))
    )
    names = [name for name in facts.columns if name != "stmt"]
    return spread.join(copied, ["stmt", "bucket"]).select("query_id", *names)
