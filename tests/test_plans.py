"""Copies, skew, layout and the plans behind them."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sqltrail import Analysis
from sqltrail.operators import tokens as tk
from sqltrail.plans import statements as st
from sqltrail.plans.numbering import numbered
from sqltrail.plans.stages import Stages, chain_ends, shared_folder

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(repr(tuple(r)) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().toString()


def log(spark, repeat=1):
    statements = entry._log(spark, SF)
    if repeat == 1:
        return statements
    copies = statements.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    return copies.select((F.col("query_id") + F.col("copy") * 1_000_000).alias("query_id"), "sql", "dialect")


def test_shuffled_and_repeated_log_gives_the_same_facts(spark):
    expected = rows(entry._analysis(spark, SF).per_query(entry._analysis(spark, SF).columns))
    analysis = Analysis(log(spark, 2).repartition(5, F.rand(7)).orderBy(F.rand(3)))
    found = analysis.per_query(analysis.columns)
    first = found.where(F.col("query_id") < 1_000_000)
    second = found.where(F.col("query_id") >= 1_000_000).withColumn("query_id", F.col("query_id") - 1_000_000)
    assert rows(first) == expected and rows(second) == expected
    analysis.release()


def test_hot_text_is_split_and_nothing_is_lost(spark):
    analysis = entry._analysis(spark, SF)
    texts = analysis.texts.select("stmt", "copies")
    hot = st.hot_statements(texts, bucket_rows=2 * st.FACTS)
    most = texts.agg(F.max("copies")).first()[0]
    assert hot.agg(F.max("buckets")).first()[0] == -(-most // 2) > 1
    split = st.per_query(analysis.columns, analysis.queries, texts, bucket_rows=2 * st.FACTS)
    assert rows(split) == rows(analysis.per_query(analysis.columns))


def test_long_hot_list_is_joined_by_shuffle(spark, monkeypatch):
    analysis = entry._analysis(spark, SF)
    texts = analysis.texts.select("stmt", "copies")
    monkeypatch.setattr(st, "BROADCAST_TEXTS", 0)
    split = st.per_query(analysis.columns, analysis.queries, texts, bucket_rows=2 * st.FACTS)
    assert "ResolvedHint" not in plan(split) and rows(split) == rows(analysis.per_query(analysis.columns))


def test_distinct_texts_grow_with_the_log(spark):
    small, large = (st.distinct_statements(entry._log(spark, f"/root/testdata/{sf}")) for sf in ("sf0.001", "sf0.01"))
    assert large.count() > 6 * small.count() > 1800
    assert large.agg(F.max("copies")).first()[0] > 20


def test_released_facts_are_built_anew(spark):
    analysis = Analysis(log(spark).limit(40))
    first = rows(analysis.columns)
    analysis.release()
    assert rows(analysis.columns) == first
    analysis.release()


def test_copies_are_counted_before_the_exchange(spark):
    text = plan(st.distinct_statements(log(spark)))
    assert text.count("partial_count") >= 1


def test_stages_are_co_located(spark, monkeypatch):
    """Every stage moves rows once at most, without broadcasts, and no setting of the session changes."""
    monkeypatch.setattr(Stages, "write", counted_write)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    settings = spark.conf.getAll
    analysis = Analysis(log(spark))
    analysis.enriched
    assert spark.conf.getAll == settings
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plans = analysis.stages.plans
    moved = {name: text.count("Exchange ") for name, text in plans.items()}
    assert {"lexemes", "items", "base_mentions", "outputs", "projections", "mentions", "references", "enriched"} <= {n for n, m in moved.items() if m == 0}
    assert max(moved.values()) == 1 and {n for n, m in moved.items() if m} <= {"distinct", "texts", "columns", "tables"}
    assert not any("BatchEvalPython" in text or "ArrowEvalPython" in text for text in plans.values())
    analysis.release()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(analysis.stages._name)]


def counted_write(self, name, build, buckets=None, write=Stages.write):
    """Keeps the plan of each stage."""
    if name not in self._written:
        df = build()
        vars(self).setdefault("plans", {})[name] = df._jdf.queryExecution().executedPlan().toString()
        write(self, name, lambda: df, buckets)


def test_chains_are_followed_in_few_rounds(spark, tmp_path):
    def write(step, df):
        df.coalesce(1).write.parquet(str(tmp_path / str(step)))
        return spark.read.parquet(str(tmp_path / str(step)))

    links = [("s", i, i - 1) for i in range(1, 1000)] + [("t", 5, 2), ("t", 9, 5), ("u", 1, 0)]
    ends = chain_ends(spark.createDataFrame(links, "stmt string, number int, parent int"), write)
    assert sorted(map(tuple, ends.collect())) == sorted([("s", i, 0) for i in range(1, 1000)] + [("t", 5, 2), ("t", 9, 2), ("u", 1, 0)])
    assert len(list(tmp_path.iterdir())) <= 13


def test_row_numbers_need_no_single_task(spark):
    chance = random.Random(1)
    keyed = [(chance.choice("aab"), chance.randrange(1000), i) for i in range(3000)] + [("c", 7, -1)]
    df = spark.createDataFrame(keyed, "k string, v int, i int").repartition(7)
    whole = numbered(df, [], [F.col("v"), F.col("i")], lambda x: x.cache())
    assert [r.number for r in whole.orderBy("v", "i").collect()] == list(range(3001))
    each = numbered(df, ["k"], [F.col("v").desc(), F.col("i")], lambda x: x.cache())
    for key in "abc":
        mine = sorted((r for r in each.collect() if r.k == key), key=lambda r: (-r.v, r.i))
        assert [r.number for r in mine] == list(range(len(mine)))
    assert numbered(df.limit(0), ["k"], [F.col("v")], lambda x: x).count() == 0


def test_wide_statements_take_little_time(spark):
    """20,000 columns through two CTEs."""
    wide = ", ".join(f"t.c{i}" for i in range(20_000))
    again = ", ".join(f"p.c{i} AS d{i}" for i in range(20_000))
    sql = f"WITH p AS (SELECT {wide} FROM t), q AS (SELECT {again} FROM p) SELECT q.d7 FROM q"
    analysis = Analysis(spark.createDataFrame([(1, sql, "oracle")], "query_id int, sql string, dialect string"))
    analysis.base_mentions, analysis.items
    start = time.perf_counter()
    projections = analysis.projections
    assert time.perf_counter() - start < 20
    assert projections.where("source_table = 't'").count() == 40_000
    analysis.release()


def test_token_tasks_follow_the_text_size():
    assert st.token_partitions(10, 8) == 8
    assert st.token_partitions(10 * st.TEXT_BYTES_PER_TASK + 1, 8) == 11
    assert st.token_partitions(100 << 40, 8) == st.MAX_TASKS


def test_buckets_follow_the_bytes_of_the_texts(spark):
    """Texts that are alike make small files, but as many tokens as any other."""
    alike = F.concat(F.col("id").cast("string"), F.repeat(F.lit(" SELECT t.a FROM t"), 20_000))
    analysis = Analysis(spark.range(40).select(F.col("id").alias("query_id"), alike.alias("sql"), F.lit("oracle").alias("dialect")))
    size = analysis.distinct.agg(F.sum(F.length("sql"))).first()[0]
    assert analysis.buckets == -(-size // st.TEXT_BYTES_PER_TASK) > spark.sparkContext.defaultParallelism
    analysis.release()
    empty = Analysis(spark.createDataFrame([(1, None, "oracle")], "query_id int, sql string, dialect string"))
    assert empty.buckets == spark.sparkContext.defaultParallelism
    empty.release()


def test_mentions_and_edges_agree(spark):
    analysis = entry._analysis(spark, SF)
    mentions = analysis.mentions.where(F.col("key_table").isNotNull()).count()
    bumps = analysis.mentions.where("through_cte").count()
    outputs = analysis.projections.count()
    using = analysis.using.count()
    defined = analysis.items.where(F.col("alias").isNotNull() & F.col("calc").isNotNull()).count()
    total = analysis.columns.agg(F.sum("usage_count")).first()[0]
    assert total == mentions + bumps + outputs + using + defined
    ends = analysis.edges.select("stmt", F.col("depends_on").alias("column_key"))
    assert ends.join(analysis.columns, ["stmt", "column_key"], "left_anti").count() == 0


def test_corpus_counts_match_expanded_rows(spark):
    analysis = entry._analysis(spark, SF)
    expanded = analysis.per_query(analysis.statistics).agg(F.sum("total_column_mentions")).first()[0]
    total = entry.queries()["M1_corpus_statistics"](spark, SF).where(F.col("dialect").isNull()).first()
    assert total.total_column_mentions == expanded and total.queries == 1000


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert folder == configured if configured else folder.startswith("/")


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["table", "column_name", "queries", "mentions"]
    assert result.count() > 1000 and result.where("queries = 0").isEmpty()


def nodes(plan):
    children = plan.children()
    return [plan, *[n for i in range(children.size()) for n in nodes(children.apply(i))]]


def test_token_rows_move_few_columns_and_are_classified_once(spark):
    analysis = entry._analysis(spark, SF)
    optimized = tk.lexemes(analysis._planner.tokenised)._jdf.queryExecution().optimizedPlan()
    windows = [n for n in nodes(optimized) if n.nodeName() == "Window"]
    assert len(windows) <= 9 and max(n.child().output().size() for n in windows) <= 20
    assert optimized.toString().count("CURRENT_DATETIME,") == 1
