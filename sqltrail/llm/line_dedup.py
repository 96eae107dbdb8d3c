"""Line dedup: lines found in many documents go.

Lines are exploded with their position, normalised and hashed to 128 bits. Distinct documents are
counted per hash (first by hash and document, then by hash, both combined before the shuffle),
so a line that stands in every document costs one row a task in the second step. The lines of
frequent hashes are found by a semi join on the hash, salted for the few hot ones, and only
their positions travel back to the documents.

Defined cases: a null or empty text is one empty line. A null ``doc_id`` counts as one document
of its own. Rows that share a ``doc_id`` count as one document, and each row is cleaned by its own
text. An empty table gives an empty table. Further columns of the input stay (``clean``) or are
left out (``report``); they may have any name but those starting with ``__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, hot_keys, salted_join, stored, wide_hash


def line_key(line: Column) -> Column:
    """A line without blanks at both ends and with A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(id_column: str, text_column: str) -> list[Column]:
    """Identifies a row by its id and its text; equal rows share their lines."""
    return [F.col(id_column).alias("__doc"), wide_hash(F.coalesce(F.col(text_column), F.lit(""))).alias("__text")]


def dropped_positions(docs: DataFrame, id_column: str, text_column: str, min_docs: int, min_chars: int) -> DataFrame:
    """For each row with such lines, the positions (from 0) of lines found in ``min_docs`` documents."""
    rows = docs.select(*_row_key(id_column, text_column), _lines(F.col(text_column)).alias("__lines"))
    lines = (
        rows.select("__doc", "__text", F.posexplode("__lines").alias("__pos", "__line"))
        .withColumn("__key", line_key(F.col("__line")))
        .where(F.length("__key") >= min_chars)
        .select("__doc", "__text", "__pos", wide_hash(F.col("__key")).alias("__hash"))
    )
    counts = lines.select("__hash", "__doc").distinct().groupBy("__hash").agg(F.count(F.lit(1)).alias("__n"))
    frequent = stored(counts.where(F.col("__n") >= min_docs), "frequent-lines")
    return (
        salted_join(lines, frequent.select("__hash"), ["__hash"], ["__doc", "__pos"], hot_keys(frequent, ["__hash"], "__n"), "left_semi")
        .groupBy("__doc", "__text")
        .agg(F.collect_set("__pos").alias("__dropped"))
    )


def clean(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_docs: int = 10, min_chars: int = 1, length_column: str | None = None
) -> DataFrame:
    """The rows with all lines gone whose key stands in ``min_docs`` documents or more.

    Adds ``__n_lines`` and ``__n_dropped``; the text column holds the kept lines joined by newlines, and
    ``length_column``, if named and there, its code points.
    """
    found = dropped_positions(docs, id_column, text_column, min_docs, min_chars)
    keyed = docs.select("*", *_row_key(id_column, text_column))
    joined = keyed.join(found.withColumnRenamed("__doc", "__id").withColumnRenamed("__text", "__id_text"),
                        F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__id_text")), "left")
    lines = _lines(F.col(text_column))
    # array_except looks positions up in a hash set, so this is linear in the lines
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    text = F.when(F.col("__dropped").isNull(), F.coalesce(F.col(text_column), F.lit(""))).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("__lines"), i)), "\n")
    )
    out = joined.withColumn("__lines", lines).withColumn("__kept", text)
    new = {text_column: F.col("__kept")} | ({length_column: F.length("__kept").cast(docs.schema[length_column].dataType)} if length_column in docs.columns else {})
    named = [new.get(c, F.col(c)).alias(c) for c in docs.columns]
    sizes = [F.size("__lines").cast("long").alias("__n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("__n_dropped")]
    return out.select(*named, *sizes)


def report(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per document: lines before, lines dropped, and the SHA-256 of the text kept."""
    cleaned = clean(docs.select("doc_id", "text"), min_docs=min_docs, min_chars=min_chars)
    return cleaned.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"),
    )


def oracle(documents: str = "documents", min_docs: int = 10, min_chars: int = 1) -> str:
    """DuckDB SQL of the cleaned rows, as common table expressions ending in ``cleaned``."""
    return f"""numbered AS (
  SELECT row_number() OVER () AS r, *, string_split(coalesce(text, ''), chr(10)) AS ls FROM {documents}),
lines AS (SELECT r, doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM numbered),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= {min_chars} GROUP BY k
  HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN 1 END) >= {min_docs}),
cleaned AS (
  SELECT keyed.r, count(*) AS n_lines, count(f.k) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '') AS kept
  FROM keyed LEFT JOIN frequent f ON keyed.k = f.k GROUP BY keyed.r)"""


ORACLE = f"""WITH {oracle()}
SELECT n.doc_id, c.n_lines, c.n_dropped, sha256(c.kept) AS kept_sha256 FROM numbered n JOIN cleaned c USING (r)"""
