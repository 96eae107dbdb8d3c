"""Scripts split over many tasks, against the same rules on whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from sqltrail.plans.stages import Stages
from sqltrail.sources import scripts
from sqltrail.sources.statements import read_sql_files, read_sql_scripts, split_statements

PIECES = (
    ";", ";", ";", " ", "\n", "--", "/*", "*/", "'", "''", '"', '""', "`", "[", "]", "$$", "$a$", "$b$", "$1", "\\", "\\'",
    "a", "v$x$y", "SELECT 1", "-", "/", "*", "жы", "\r\n",
)
PINNED = (
    "SELECT ';' AS a; SELECT b -- no; end\n FROM t /* ; ; */; SELECT $f$ x; $$ y; $f$ FROM u",
    "CREATE FUNCTION f() AS $body$ BEGIN a; b := $$;$$; END; $body$; SELECT \"e;f\" FROM [g;h]; SELECT `i;j`",
    ";;  ; \n;",
    "",
    "SELECT 'it''s; fine'; SELECT v$s$x; SELECT y$s$ FROM 'open; to the end; of it",
    "/* open; SELECT 1; SELECT 2",
    "SELECT 1;" * 40 + "/*" + "x;" * 50 + "*/ SELECT 2;" + "SELECT 3;" * 30,
)


def _compare(spark, folder, dialect):
    whole = split_statements(read_sql_files(spark, folder, dialect))
    expected = sorted((*r.query_id, r.sql) for r in whole.collect() if r.sql.strip(" ;\t\n\r\x0b\x0c"))
    stages = Stages(spark)
    found = sorted((*r.query_id, r.sql) for r in read_sql_scripts(spark, folder, stages, dialect).collect())
    stages.delete()
    assert found == expected
    return found


@pytest.mark.parametrize("dialect", ["ORACLE", "MYSQL"])
def test_split_over_blocks(spark, tmp_path, monkeypatch, dialect):
    """Blocks of a few bytes cut tokens anywhere, and groups of three give several levels."""
    monkeypatch.setattr(scripts, "FAN", 3)
    draw = random.Random(7)
    texts = [*PINNED, *("".join(draw.choices(PIECES, k=draw.randint(100, 200))) for _ in range(6))]
    for i, text in enumerate(texts):
        (tmp_path / f"s{i:03}.sql").write_bytes(text.encode())
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = {key: spark.conf.get(key) for key in (size, cost)}
    try:
        spark.conf.set(size, "89b")
        spark.conf.set(cost, "1b")
        found = _compare(spark, str(tmp_path), dialect)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(found) > 80


def test_rules_of_a_script(spark, tmp_path):
    """What the pinned texts are to give, by hand."""
    for i, text in enumerate(PINNED):
        (tmp_path / f"s{i}.txt").write_bytes(text.encode())
    counts = {}
    for path, _, _ in _compare(spark, str(tmp_path), "ORACLE"):
        number = int(path[-5])
        counts[number] = counts.get(number, 0) + 1
    assert counts == {0: 3, 1: 3, 4: 3, 5: 1, 6: 71}


def test_backslash_by_dialect(spark):
    rows = [(1, r"SELECT 'a\'; b'; SELECT 2", "mysql"), (2, r"SELECT 'a\'; SELECT 2", "oracle")]
    parts = split_statements(spark.createDataFrame(rows, "query_id int, sql string, dialect string"))
    found = sorted((r.query_id.id, r.sql.strip()) for r in parts.collect())
    assert found == [(1, r"SELECT 'a\'; b'"), (1, "SELECT 2"), (2, r"SELECT 'a\'"), (2, "SELECT 2")]


def test_no_files(spark, tmp_path):
    (tmp_path / "empty.sql").write_bytes(b"")
    stages = Stages(spark)
    assert read_sql_scripts(spark, str(tmp_path), stages).collect() == []
    stages.delete()


def test_a_large_script_is_many_tasks(spark, tmp_path):
    """Tasks follow the blocks of the file, and no plan gathers a file in one row."""
    body = "".join(f"INSERT INTO t VALUES ({i}, 'a;{i}') /* ; */;\n" for i in range(60_000))
    (tmp_path / "big.sql").write_text(body)
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = {key: spark.conf.get(key) for key in (size, cost)}
    try:
        spark.conf.set(size, "100kb")
        stages = Stages(spark)
        rows = read_sql_scripts(spark, str(tmp_path), stages)
        segments = spark.read.parquet(f"{stages.root}/*-segments")
        assert segments.groupBy("block").count().count() > 20
        total = rows.agg(F.count(F.lit(1)), F.max("query_id.part"), F.count_distinct("sql")).first()
        assert tuple(total) == (60_000, 59_999, 60_000)
        stages.delete()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
