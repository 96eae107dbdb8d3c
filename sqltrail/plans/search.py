"""M9 over an index: postings of three-character pieces, for views that are searched often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltrail.plans.reports import search_metadata

PIECE = 3
FOLDERS = 256
# Rows of the view for which one task holds a piece; more are dealt over several.
SHARE_ROWS = 2_000_000


def pieces(cell: Column) -> Column:
    """Distinct pieces of a cell in lower case, empty for null and for shorter cells."""
    found = F.regexp_extract_all(F.lower(cell.cast("string")), F.lit(rf"(?s)(?=(.{{{PIECE}}}))."), F.lit(1))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def folder(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(FOLDERS)).cast("int")


def write_postings(view: DataFrame, path: str, *ignored: str, mode: str = "error") -> None:
    """Index a view with ``stmt``: ``(piece, stmt)`` of all cells but the ignored ones and ``stmt``, in folders by piece.

    Equal cells of a statement are cut into pieces once. A folder is dealt over shares by statement, so a piece that is
    everywhere spans several tasks; ranges would need all pieces twice, first to find where they end. Files are sorted for skipping within them.
    """
    cells = F.array(*[F.lower(F.col(name).cast("string")) for name in view.columns if name not in ("stmt", *ignored)])
    distinct = view.select("stmt", F.explode(cells).alias("cell")).where(F.col("cell").isNotNull()).distinct()
    found = distinct.select("stmt", F.explode(pieces(F.col("cell"))).alias("piece")).distinct()
    shares = -(-view.count() // SHARE_ROWS) or 1
    share = F.pmod(F.xxhash64("stmt"), F.lit(shares))
    placed = found.withColumn("folder", folder(F.col("piece"))).repartition("folder", share)
    placed.sortWithinPartitions("folder", "piece", "stmt").write.mode(mode).partitionBy("folder").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("piece string, stmt binary, folder int").parquet(path)


def search_indexed(view: DataFrame, postings: DataFrame, text: str, *ignored: str) -> DataFrame:
    """M9 with postings of the same view and ignored columns: the rows that ``search_metadata`` gives.

    Only folders of the text's own pieces are read. Statements that hold all pieces are joined with the view, and their rows verified.
    A text of fewer than three characters has no piece and is looked for by the scan, as is none.
    """
    spark = view.sparkSession
    own = pieces(F.lit(text or ""))
    own, folders = spark.range(1).select(own, F.array_distinct(F.transform(own, folder))).first()
    if not own:
        return search_metadata(view, text, "stmt", *ignored)
    found = postings.where(F.col("folder").isin(folders) & F.col("piece").isin(own)).groupBy("stmt").agg(F.count(F.lit(1)).alias("n"))
    found = found.where(F.col("n") == len(own)).select("stmt")
    return search_metadata(view.join(found, "stmt", "left_semi"), text, "stmt", *ignored)
