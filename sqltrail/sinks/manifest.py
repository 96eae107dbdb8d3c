"""One commit for an output of several datasets.

Spark commits each dataset by itself, so a failure between two of them leaves an output half new. Here every
dataset is written beside the files that are there, and then one manifest, replaced in a single step, names
the writes whose files count. A reader that follows it sees all datasets of one commit or all of the one before. Files
are told apart by the id that Spark puts into the names of a write, so none is moved.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

# Fixed value: Spark's names of the files of a write, and the id in them.
PART_FILE = re.compile(r"part-\d+-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})")
MODES = ("append", "overwrite", "ignore", "error", "errorifexists")

Parts = Mapping[str, tuple[str, Callable[[str], None]]]


def _file_system(spark: SparkSession, path: str):
    """The path in the cluster's file system, and that file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _part_files(spark: SparkSession, folder: str) -> dict[str, list]:
    """Files of each write in the folder of a dataset; no file is opened."""
    path, files = _file_system(spark, folder)
    found: dict[str, list] = {}
    if files.exists(path):
        for status in files.listStatus(path):
            if named := PART_FILE.match(status.getPath().getName()):
                found.setdefault(named[1], []).append(status.getPath())
    return found


def _drop(spark: SparkSession, folder: str, keep: set[str]) -> None:
    """Delete the files of all other writes."""
    _, files = _file_system(spark, folder)
    for write, paths in _part_files(spark, folder).items():
        if write not in keep:
            for path in paths:
                files.delete(path, False)


def read_manifest(spark: SparkSession, manifest: str) -> dict[str, dict]:
    """``{dataset: {"path", "writes"}}`` of the last commit; FileNotFoundError where nothing is committed."""
    path, files = _file_system(spark, manifest)
    if not files.exists(path):
        raise FileNotFoundError(f"nothing is committed at {manifest}")
    text = spark.read.option("wholetext", True).text(manifest).first()
    return json.loads(text.value)


def _replace(spark: SparkSession, manifest: str, entries: dict[str, dict]) -> None:
    """Write the manifest under another name, then rename it over the old one."""
    target, files = _file_system(spark, manifest)
    draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(entries, ensure_ascii=False).encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(draft, target, options)


def _exists(spark: SparkSession, path: str) -> bool:
    found, files = _file_system(spark, path)
    return files.exists(found)


def commit(spark: SparkSession, manifest: str, parts: Parts, mode: str = "error") -> None:
    """Write all datasets, then the manifest that makes them count.

    ``parts`` gives each dataset its folder and a function that appends its rows there. Modes are Spark's. When
    a write fails, its files and those of the datasets before it are deleted, the manifest stays as it was and the error
    reaches the caller; files left by a lost driver count for no reader and go with the next overwrite. One
    writer at a time. A write must give at least one file, as Spark's file writers do also for no rows.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    try:
        before = read_manifest(spark, manifest)
    except FileNotFoundError:
        before = {}
    if before and mode == "ignore":
        return
    if mode in ("error", "errorifexists"):
        taken = [folder for folder in [manifest, *[path for path, _ in parts.values()]] if _exists(spark, folder)]
        if taken:
            raise FileExistsError(f"there is something at {', '.join(taken)}")
    there = {name: set(_part_files(spark, folder)) for name, (folder, _) in parts.items()}
    entries = {}
    try:
        for name, (folder, write) in parts.items():
            write(folder)
            added = sorted(set(_part_files(spark, folder)) - there[name])
            kept = before.get(name, {}).get("writes", []) if mode == "append" else []
            entries[name] = {"path": folder, "writes": kept + added}
        _replace(spark, manifest, entries)
    except BaseException:
        for name, (folder, _) in parts.items():
            _drop(spark, folder, there[name])
        raise
    for name, (folder, _) in parts.items():
        _drop(spark, folder, set(entries[name]["writes"]))


def read_committed(
    spark: SparkSession,
    manifest: str,
    name: str,
    read: Callable[[DataFrameReader, str], DataFrame] = lambda reader, path: reader.parquet(path),
) -> DataFrame:
    """A dataset of the last commit, and no file of any other write."""
    entry = read_manifest(spark, manifest)[name]
    reader = spark.read.option("pathGlobFilter", f"part-*-{{{','.join(entry['writes'])}}}*")
    return read(reader, entry["path"])
