"""Stage tables: intermediate results that many operators read."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
SETTINGS = {
    # HotSpot never compiles a method above 8000 bytes, and the wide token expressions
    # would exceed that in one fused stage; with the limit they run as smaller methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Rows bucketed by statement may be joined on the statement and more without moving
    # again. No statement is larger than one input row, so this cannot skew.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Token rows carry what is settled as one struct through sorts and windows; taken apart, every
    # field is tested and copied by itself in each of them.
    "spark.sql.optimizer.expression.nestedPruning.enabled": "false",
    # A task aggregates the columns of some thousand texts; by default it would sort after 128 of them.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "50000",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for cut lineage; a temporary one in local mode only."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="sqltrail-")
    raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one and ``SETTINGS``, which no other query sees."""
    own = spark.newSession()
    for key, value in {**spark.conf.getAll, **SETTINGS}.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


class Stages:
    """Writes each stage once as Parquet and reads it back.

    A written stage survives lost executors, keeps later plans short, and lets each
    reader fetch only the columns and roles it needs. Stages of statement rows are bucketed by ``stmt``,
    all into the same number of buckets, so joins, groupings and windows on ``stmt`` and anything else read
    what belongs together without moving it. They stand in the session catalog, as only tables there are
    read by bucket, under names of their own until ``delete``. Threads that ask for the same stage
    wait for one write.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._lock = threading.RLock()
        self._written: dict[str, str | None] = {}
        self._name = f"sqltrail_{uuid.uuid4().hex}"
        self.root = f"{shared_folder(spark).rstrip('/')}/{self._name}"

    def write(self, name: str, build: Callable[[], DataFrame], buckets: int | None = None) -> None:
        """Write what ``build`` gives, unless the stage is there; with ``buckets``, one file for each bucket of statements.

        Rows of a bucketed stage have to be partitioned by ``stmt`` into as many partitions, else tasks write to several buckets each.
        """
        with self._lock:
            if name in self._written:
                return
            df, path = build(), f"{self.root}/{name}"
            if buckets:
                table = f"{self.spark.catalog.currentDatabase()}.{self._name}_{name.replace('-', '_')}"
                df.write.mode("overwrite").option("path", path).bucketBy(buckets, "stmt").saveAsTable(table)
                self._written[name] = table
            else:
                df.write.mode("overwrite").parquet(path)
                self._written[name] = None

    def read(self, name: str, session: SparkSession) -> DataFrame:
        """A written stage as a session sees it."""
        table = self._written[name]
        return session.table(table) if table else session.read.parquet(f"{self.root}/{name}")

    def _folder(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def size(self, name: str) -> int:
        """Bytes of a written stage, from file metadata."""
        path, files = self._folder(name)
        return files.getContentSummary(path).getLength()

    def delete(self) -> None:
        for table in filter(None, self._written.values()):
            try:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            except AnalysisException:  # the catalog lost it; the files go below
                continue
        path, files = self._folder()
        files.delete(path, True)


def chain_ends(links: DataFrame, write: Callable[[int, DataFrame], DataFrame]) -> DataFrame:
    """``(stmt, number, parent)`` with every parent replaced by the end of the chain it begins.

    Pointer doubling: each round sends a parent on to its own parent by a join, so a chain is
    halved, and the rounds grow with the logarithm of the longest one. ``write(step, df)`` stores a round.
    """
    step = 0
    now = write(step, links.select("stmt", "number", "parent", F.lit(True).alias("moved")))
    while True:
        step += 1
        further = now.select("stmt", F.col("number").alias("parent"), F.col("parent").alias("next"))
        moved = now.join(further, ["stmt", "parent"], "left")
        now = write(step, moved.select("stmt", "number", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("stmt", "number", "parent")
