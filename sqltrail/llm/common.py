"""Helpers that several operators share: reading tables, stored intermediates, hot keys."""

from __future__ import annotations

import itertools
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_runs = itertools.count()
_shipped: set[str] = set()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as bundle:
            for source in sorted(package.rglob("*.py")):
                bundle.write(source, source.relative_to(package.parent))
        context.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, so that further columns never clash with an operator's own."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors reach.

    Where it is unset (tests on one machine) a temporary folder is set; a cluster must name one.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = path.get() if path.isDefined() else tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of the shared directory that no other run uses."""
    return f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{next(_runs)}-{uuid.uuid4().hex[:8]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once and outlives executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def wide_hash(value: Column) -> Column:
    """128 bits of a value as a struct of two longs, hashed with two seeds."""
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(0x5EED), value).alias("b"))


#: A key is hot if it has more rows than HOT_ROWS and than HOT_SHARE of all; so at most 1 / HOT_SHARE keys are.
HOT_ROWS, HOT_SHARE, SALTS = 1_000, 1 / 10_000, 64


def hot_keys(counts: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """The hot keys of a stored table with one row for each key; 1 / HOT_SHARE rows at most, so they may be broadcast."""
    total = counts.agg(F.coalesce(F.sum(rows), F.lit(0))).scalar()
    return counts.where(F.col(rows) > F.greatest(F.lit(HOT_ROWS), total * F.lit(HOT_SHARE))).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], hot: DataFrame, how: str) -> DataFrame:
    """Join where rows of a hot key on the left are spread by ``spread`` over SALTS keys, and copied to them on the right."""
    hot = F.broadcast(hot.select(*keys, F.lit(SALTS).alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1)).cast("long")
    dealt = left.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), salts)).drop("__salts")
    copied = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("__salts")
    return dealt.join(copied, [*keys, "__salt"], how).drop("__salt")
