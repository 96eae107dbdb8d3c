"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, decontamination, BPE.

Each stage takes the rows that the one before it kept, as written Parquet, and all but the last return the
columns of ``documents``. Documents that the classifier rejects go; lines found in many of the remaining
documents go; of each group of near-duplicates one document stays; documents that overlap with the
benchmark go; what is left is encoded whole.

Stages behave on nulls, empty texts, repeated rows, empty tables and further columns as their
operators say (``sqltrail/llm``). Columns whose names start with ``__`` are not allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sqltrail.llm import bpe, decontaminate, line_dedup, quality, simhash
from sqltrail.llm.common import new_folder, ship, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorisation machine, fitted on the labelled rows of ``docs``, does not reject."""
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that stand in ten documents or more; ``n_chars`` follows the text."""
    return line_dedup.clean(docs, length_column="n_chars").select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates."""
    ship(spark)
    return simhash.deduplicate(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of documents that overlap with no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row its id, the number of its tokens and the digests of its ids and of what they decode to."""
    ship(spark)
    return bpe.digest(docs)


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate_documents),
    ("byte_bpe", encode),
]

#: Fingerprints, trained scores and token ids are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = new_folder(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
