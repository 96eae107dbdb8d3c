import json
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sqltrail import Analysis
from sqltrail.functions.text import escape_formula_text, escape_source_text
from sqltrail.operators.tokens import token_pieces
from sqltrail.plans import reports, search
from sqltrail.plans.search import read_postings, search_indexed, write_postings
from sqltrail.sinks import manifest, writers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def analysis(spark):
    return entry._analysis(spark, SF)


def as_text(df):
    return sorted(tuple("" if v is None else str(v) for v in row) for row in df.collect())


@pytest.mark.parametrize(
    "path, name, expected",
    [("a.xlsx", None, "excel"), ("a.XLS", None, "excel"), ("a.json", None, "json"), ("a.csv", "text", "text"),
     ("a.txt", None, "text"), ("a.csv", "other", "csv")],
)
def test_choose_format(path, name, expected):
    assert writers.choose_format(path, name) == expected


def test_unknown_format():
    with pytest.raises(ValueError):
        writers.choose_format("a.pdf")


def test_csv_pair(spark, analysis, tmp_path):
    writers.write_metadata(analysis, str(tmp_path / "out.csv"))
    for suffix, view, headers in (
        ("tables", writers.csv_tables(analysis.tables), writers.TABLE_HEADERS),
        ("columns", writers.csv_columns(analysis.enriched), writers.COLUMN_HEADERS),
    ):
        path = str(tmp_path / f"out_{suffix}.csv")
        back = spark.read.csv(path, header=True, escape='"')
        assert back.columns[1:] == list(headers.values())
        assert as_text(back) == as_text(writers.with_headers(analysis.per_query(view), headers))
        part = next((tmp_path / f"out_{suffix}.csv").glob("part-*.csv"))
        assert part.read_bytes().startswith(b"\xef\xbb\xbfquery_id")


def test_empty_csv_keeps_its_header(spark, tmp_path):
    empty = spark.createDataFrame([(1, "   ", "oracle")], "query_id long, sql string, dialect string")
    writers.write_metadata(Analysis(empty), str(tmp_path / "none.csv"))
    part = next((tmp_path / "none_tables.csv").glob("part-*.csv"))
    assert part.read_text("utf-8-sig").strip() == "query_id," + ",".join(writers.TABLE_HEADERS.values())


def test_json(spark, analysis, tmp_path):
    writers.write_metadata(analysis, str(tmp_path / "out.json"))
    documents = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out.json")).collect()]
    assert len(documents) == 1000
    first = next(d for d in documents if d["query_id"] == 3)
    assert list(first) == ["query_id", "metadata", "tables", "columns", "json_schema"]
    assert first["json_schema"] == writers.JSON_SCHEMA
    assert [t["name"].split("_")[0] for t in first["tables"]] == ["ripe", "harvest", "plots"]
    assert first["metadata"]["statistics"]["table_types"] == {"Таблица": 2, "CTE": 1}
    assert list(first["columns"][0]) == list(writers.JSON_SCHEMA["properties"]["columns"]["items"]["properties"])
    blank = next(d for d in documents if d["query_id"] == 11)
    assert blank["metadata"]["parse_errors"] == ["SQL запрос пустой"] and blank["json_schema"] == {}


def test_text_and_sheets(spark, analysis, tmp_path):
    writers.write_metadata(analysis, str(tmp_path / "out.txt"), report_time="2024-01-01 00:00:00")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out.txt")).collect())
    back = writers.read_text(spark, str(tmp_path / "out.txt"))
    report = analysis.per_query(reports.text_report(analysis.texts, analysis.tables, analysis.columns, "2024-01-01 00:00:00"))
    assert as_text(back) == as_text(report)
    assert text.count(reports.REPORT_TITLE) == 1000 and "Диалект SQL: TSQL" in text
    writers.write_metadata(analysis, str(tmp_path / "out.xlsx"), report_time="2024-01-01 00:00:00")
    sheets = writers.sheets(analysis, "2024-01-01 00:00:00")
    assert list(sheets) == ["columns", "tables", "lineage", "statistics", "text", "source"]
    for name, sheet in sheets.items():
        assert as_text(spark.read.parquet(str(tmp_path / "out.xlsx" / name))) == as_text(sheet)


@pytest.mark.parametrize("name", ["out.json", "out.txt"])
def test_whole_documents_take_little_disk(spark, analysis, tmp_path, name):
    """Frames that every query repeats are not written out for each."""
    path = tmp_path / name
    writers.write_metadata(analysis, str(path), report_time="2024-01-01 00:00:00")
    written = sum(file.stat().st_size for file in path.glob("part-*"))
    assert written * 5 < spark.read.text(str(path)).agg(F.sum(F.octet_length("value"))).first()[0]


def test_tsv(spark, analysis, tmp_path):
    writers.write_tsv_summary(analysis, str(tmp_path / "summary"))
    back = spark.read.csv(str(tmp_path / "summary"), header=True, sep="\t", escape='"')
    assert back.columns == ["query_id", *writers.SUMMARY_HEADERS.values()]
    assert back.count() == analysis.per_query(analysis.columns).count()


def test_write_errors_reach_the_caller(analysis, tmp_path):
    (tmp_path / "out.json").mkdir()
    with pytest.raises(Exception):
        writers.write_metadata(analysis, str(tmp_path / "out.json"))


def write(spark, rows, fail=False):
    df = spark.range(rows).withColumn("v", F.when(F.lit(fail) & (F.col("id") == rows - 1), F.raise_error(F.lit("no room"))).otherwise("x"))
    return lambda folder: df.write.mode("append").parquet(folder)


def test_commit_is_whole_or_nothing(spark, tmp_path):
    target, names = str(tmp_path / "m.json"), ("a", "b", "c")

    def parts(rows, broken=None):
        return {name: (str(tmp_path / name), write(spark, rows, name == broken)) for name in names}

    def counts():
        return [manifest.read_committed(spark, target, name).count() for name in names]

    with pytest.raises(Exception, match="no room"):
        manifest.commit(spark, target, parts(5, "b"))
    with pytest.raises(FileNotFoundError):
        manifest.read_manifest(spark, target)
    assert not list(tmp_path.glob("*/part-*"))
    manifest.commit(spark, target, parts(5), "overwrite")
    assert counts() == [5, 5, 5]
    with pytest.raises(Exception, match="no room"):
        manifest.commit(spark, target, parts(7, "c"), "overwrite")
    assert counts() == [5, 5, 5] and spark.read.parquet(str(tmp_path / "a")).count() == 5
    manifest.commit(spark, target, parts(2), "append")
    assert counts() == [7, 7, 7]
    # What a driver lost between two datasets would leave counts for no reader, and goes with the next commit.
    write(spark, 9)(str(tmp_path / "a"))
    assert counts() == [7, 7, 7]
    manifest.commit(spark, target, parts(0), "overwrite")
    assert counts() == [0, 0, 0] and spark.read.parquet(str(tmp_path / "a")).count() == 0
    manifest.commit(spark, target, parts(3), "ignore")
    assert counts() == [0, 0, 0]
    with pytest.raises(FileExistsError):
        manifest.commit(spark, target, parts(3))


def test_outputs_of_several_datasets_follow_their_manifest(spark, analysis, tmp_path, monkeypatch):
    for name, target in (("set.xlsx", writers.sheet_manifest), ("pair.csv", writers.csv_manifest)):
        path = str(tmp_path / name)
        writers.write_metadata(analysis, path, report_time="2024-01-01 00:00:00")
        first = manifest.read_manifest(spark, target(path))
        broken = "source_view" if name == "set.xlsx" else "csv_columns"
        owner = reports if name == "set.xlsx" else writers
        build = getattr(owner, broken)
        monkeypatch.setattr(owner, broken, lambda df: build(df).withColumn("stmt", F.when(F.raise_error(F.lit("no room")).isNull(), F.col("stmt"))))
        with pytest.raises(Exception, match="no room"):
            writers.write_metadata(analysis, path, report_time="2024-01-01 00:00:00", mode="overwrite")
        monkeypatch.undo()
        assert manifest.read_manifest(spark, target(path)) == first
        for dataset, entry in first.items():
            assert set(manifest._part_files(spark, entry["path"])) == set(entry["writes"])


def test_escapes(spark):
    cells = spark.createDataFrame([("=1",), ("-",), ("+x",), ("@a",), ("a=",), ("",)], "t string")
    assert [r[0] for r in cells.select(escape_formula_text(F.col("t"))).collect()] == ["`=1", "`-", "`+x", "`@a", "a=", ""]
    sources = spark.createDataFrame([("\n\nSELECT",), ("`x",), (" \nS",)], "t string")
    assert [r[0] for r in sources.select(escape_source_text(F.col("t"))).collect()] == ["`SELECT", "`x", "` \nS"]


def test_search_and_sort(analysis):
    view = reports.columns_view(analysis.enriched)
    assert reports.search_metadata(view, "") is view
    found = reports.search_metadata(view, "CRITIC_ID", "stmt").collect()
    assert found and all("critic_id" in " ".join(map(str, row)).lower() for row in found)
    counts = [r.usage_count for r in reports.sort_view(view, "usage_count", descending=True).collect()]
    assert counts == sorted(counts, reverse=True)


def test_search_by_postings(spark, analysis, tmp_path):
    view = reports.columns_view(analysis.enriched)
    write_postings(view, str(tmp_path / "postings"))
    postings = read_postings(spark, str(tmp_path / "postings"))
    for text in ("CRITIC_ID", "ritic", "aaa", "no such text", "o.", "", "Таблица", "h, r", "SUM"):
        scanned = reports.search_metadata(view, text, "stmt")
        assert as_text(search_indexed(view, postings, text)) == as_text(scanned), text
    plan = search_indexed(view, postings, "critic_id")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder#\d+", plan) and re.search(r"PushedFilters: \[[^\]]*In\(piece", plan)


def test_search_by_postings_edges(spark, tmp_path):
    rows = [(b"a", "Abcabc", 5), (b"b", None, None), (b"c", "", 1234), (b"c", "abc", 0), (b"d", "a\nbc", 12)]
    view = spark.createDataFrame(rows, "stmt binary, v string, n int")
    for name, df in (("rows", view), ("none", view.limit(0))):
        write_postings(df, str(tmp_path / name))
        postings = read_postings(spark, str(tmp_path / name))
        for text in ("abc", "BCA", "123", "1234", "bcabcx", "12", "a\nb"):
            assert as_text(search_indexed(df, postings, text)) == as_text(reports.search_metadata(df, text, "stmt")), text


def test_number_sorted(spark):
    view = spark.range(5000).select((F.col("id") % 7).alias("n"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("v"), "id")
    rows = reports.number_sorted(view, "n", lambda df: df.cache(), descending=True).orderBy("row_no").collect()
    assert [r.row_no for r in rows] == list(range(1, 5001))
    assert [tuple(r)[:3] for r in rows] == [tuple(r) for r in reports.sort_view(view, "n", descending=True).collect()]


def test_postings_are_dealt_without_a_pass_for_ranges(spark, tmp_path, monkeypatch):
    """A piece of all statements spans several tasks, and nothing is computed twice to find ranges."""
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", None)
    monkeypatch.setattr(search, "SHARE_ROWS", 50)
    texts = F.concat(F.lit("abc"), F.col("id").cast("string"), F.lit("\U0001f600é"))
    view = spark.range(1000).select(F.col("id").cast("string").cast("binary").alias("stmt"), texts.alias("v"), texts.alias("again"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_postings(view, str(tmp_path / "p"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    postings = read_postings(spark, str(tmp_path / "p"))
    held = postings.where("piece = 'abc'").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in held) == 1000 and len(held) > 3
    for text in ("ABC77", "c9", "9\U0001f600É", "\U0001f600é", "bc1234"):
        assert as_text(search_indexed(view, postings, text)) == as_text(reports.search_metadata(view, text, "stmt")), text


def names_of(df):
    def walk(node):
        children = node.children()
        return [node.nodeName(), *[n for i in range(children.size()) for n in walk(children.apply(i))]]

    return walk(df._jdf.queryExecution().optimizedPlan())


def test_a_text_meets_its_queries_as_one_row(analysis):
    found = writers.sheets(analysis, "2024-01-01 00:00:00")
    for sheet in ("text", "statistics"):
        names = names_of(found[sheet])
        assert "Union" not in names and names.index("Generate") < names.index("Join"), sheet


def test_the_schema_is_added_to_documents_after_they_meet_their_queries(analysis):
    bodies = writers.document_bodies(analysis.texts, analysis.statistics, analysis.tables, analysis.columns)
    assert bodies.where(F.col("body").contains('"required"')).isEmpty()
    expected = analysis.per_query(writers.documents(analysis.texts, analysis.statistics, analysis.tables, analysis.columns))
    assert as_text(writers.whole_documents(analysis.per_query(bodies), "query_id")) == as_text(expected)
    assert writers.COMPRESSED["zlib.compress.level"] == "BEST_SPEED"


def test_query_ids_of_any_type_in_json(spark, tmp_path):
    rows = [("a\"]b\n", "1"), (None, "2")]
    bodies = spark.createDataFrame(rows, "query_id string, body string").withColumn("is_read", F.lit(False))
    writers.write_json(bodies, str(tmp_path / "s"))
    writers.write_json(bodies.select(F.when(F.col("body") == "1", 5).cast("bigint").alias("query_id"), "body", "is_read"), str(tmp_path / "n"))
    lines = [sorted(r[0] for r in spark.read.text(str(tmp_path / name)).collect()) for name in "sn"]
    assert lines == [['{"query_id":"a\\"]b\\n",1{}}', '{"query_id":null,2{}}'], ['{"query_id":5,1{}}', '{"query_id":null,2{}}']]


def test_readable_text_is_made_of_the_expression_only(spark):
    tokens = F.split(F.lit("SELECT|f|(|a|+|1|)|FROM|t"), r"\|")
    piece = spark.range(1).select(token_pieces(tokens, F.lit(1), F.lit(4))).first()[0]
    assert piece == [" F", "(", "a", " +"]
