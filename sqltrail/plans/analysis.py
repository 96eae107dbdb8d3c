"""All facts of a table of statements, built once and read many times."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltrail.operators import columns as col_ops
from sqltrail.operators import resolve as res
from sqltrail.operators import tables as tab
from sqltrail.operators import tokens as tk
from sqltrail.plans import reports
from sqltrail.plans import statements as st
from sqltrail.plans.stages import Stages, chain_ends, own_session
from sqltrail.sources.scripts import statements_of


class Analysis:
    """Facts for ``statements(query_id, sql, dialect)``.

    Each distinct text is read once, however often it was run; ``per_query`` hands facts
    of a text back to its queries. Fact tables carry ``stmt``. Queries, texts, lexemes,
    references, items, mentions, columns and tables are stages: written on first use and
    then read by every operator that needs them. They are planned in a session of their own, whose
    settings no other query gets, and read in the session of ``statements``. ``release`` deletes the stages.
    """

    def __init__(self, statements: DataFrame, bucket_rows: int = st.BUCKET_ROWS):
        self.statements = statements
        self.bucket_rows = bucket_rows
        self.session = statements.sparkSession
        self.stages = Stages(self.session)
        self._planner = self._twin()

    def _twin(self) -> Analysis:
        """The same facts over the same stages, in a session with the settings for stages."""
        twin = object.__new__(Analysis)
        twin.statements, twin.bucket_rows, twin.stages = self.statements, self.bucket_rows, self.stages
        twin.session, twin._planner = own_session(self.session), twin
        return twin

    def release(self) -> None:
        """Delete the stages; facts asked for later are built anew."""
        self.stages.delete()
        for name, value in list(vars(self).items()):
            if name == "buckets" or (isinstance(value, DataFrame) and name != "statements"):
                del self.__dict__[name]
        self.stages = Stages(self.session)
        self._planner = self._twin()

    def _stage(self, name: str, build: Callable[[Analysis], DataFrame]) -> DataFrame:
        """A stage of statement rows, planned by the twin if it is not written yet."""
        self.stages.write(name, lambda: build(self._planner), self.buckets)
        return self.stages.read(name, self.session)

    def _rounds(self, name: str) -> Callable[[int, DataFrame], DataFrame]:
        """Stores the rounds of an iteration that the twin plans."""
        return lambda step, df: self._planner._stage(f"{name}-{step}", lambda _: df)

    @cached_property
    def queries(self) -> DataFrame:
        """``(query_id, stmt)``, written once so that no output reads the texts again."""
        self.stages.write("queries", lambda: st.query_keys(self.statements))
        return self.stages.read("queries", self.session)

    @cached_property
    def distinct(self) -> DataFrame:
        self.stages.write("distinct", lambda: st.distinct_statements(self.statements))
        return self.stages.read("distinct", self.session)

    @cached_property
    def buckets(self) -> int:
        """Buckets of every stage of statement rows, from the bytes of the distinct texts."""
        return st.token_partitions(st.text_bytes(self.distinct), self.session.sparkContext.defaultParallelism)

    @cached_property
    def texts(self) -> DataFrame:
        """``(stmt, sql, dialect, copies, sql_clean, parse_errors, tokens)``, one row per text."""
        return self._stage("texts", lambda a: st.clean_statements(a.distinct.repartition(a.buckets, "stmt")))

    @property
    def scripts(self) -> DataFrame:
        """``(stmt, statements, unread)`` of texts with several statements: facts are those of the first, the rest are unread."""
        counted = self.texts.select("stmt", F.size(statements_of(F.col("sql"), F.col("dialect"))).alias("statements"))
        return counted.where(F.col("statements") > 1).withColumn("unread", F.col("statements") - 1)

    @cached_property
    def readable(self) -> DataFrame:
        """Texts without parse errors; only these yield facts (P10)."""
        return self.texts.where(F.size("parse_errors") == 0)

    @cached_property
    def tokenised(self) -> DataFrame:
        """``(stmt, dialect, tokens)`` of readable texts."""
        return self.readable.select("stmt", "dialect", "tokens")

    @cached_property
    def lexemes(self) -> DataFrame:
        return self._stage("lexemes", lambda a: tk.lexemes(a.tokenised))

    @cached_property
    def around(self) -> DataFrame:
        return self._stage("around", lambda a: tab.enclosing_scopes(a.lexemes, self._rounds("around")))

    @cached_property
    def ctes(self) -> DataFrame:
        return tab.cte_definitions(self.lexemes)

    @cached_property
    def derived(self) -> DataFrame:
        return tab.derived_tables(self.lexemes)

    @cached_property
    def cte_names(self) -> DataFrame:
        return tab.cte_names(self.lexemes)

    @cached_property
    def outer_marks(self) -> DataFrame:
        return tab.outer_marks(self.readable)

    @cached_property
    def references(self) -> DataFrame:
        def build(a: Analysis) -> DataFrame:
            typed = tab.with_join_types(tab.table_references(a.lexemes), a.around, a.outer_marks)
            return tab.classify_references(typed, a.cte_names)

        return self._stage("references", build)

    @cached_property
    def table_rows(self) -> DataFrame:
        found = tab.found_tables(self.references, self.ctes, self.derived)
        return tab.upsert_tables(found.repartition(self.buckets, "stmt"))

    @cached_property
    def scope_tables(self) -> DataFrame:
        return res.scope_tables(tab.table_references(self.lexemes), self.around)

    @cached_property
    def items(self) -> DataFrame:
        return self._stage("items", lambda a: res.select_items(a.lexemes))

    @cached_property
    def base_mentions(self) -> DataFrame:
        return self._stage("base_mentions", lambda a: res.column_mentions(a.lexemes, a.scope_tables, a.around))

    @cached_property
    def outputs(self) -> DataFrame:
        """Outputs of CTEs and derived tables with the source their own SELECT names, numbered."""

        def build(a: Analysis) -> DataFrame:
            items = res.relation_items(a.items, a.lexemes)
            return res.numbered_outputs(res.relation_sources(a.base_mentions, items))

        return self._stage("outputs", build)

    @cached_property
    def projections(self) -> DataFrame:
        def build(a: Analysis) -> DataFrame:
            ends = chain_ends(res.earlier_outputs(a.outputs), self._rounds("chains"))
            return res.projection_map(a.outputs, ends)

        return self._stage("projections", build)

    @cached_property
    def mentions(self) -> DataFrame:
        return self._stage("mentions", lambda a: res.resolve_mentions(a.base_mentions, a.projections, a.items, a.cte_names))

    @cached_property
    def using(self) -> DataFrame:
        return col_ops.using_mentions(self.lexemes, self.scope_tables)

    @cached_property
    def columns(self) -> DataFrame:
        def build(a: Analysis) -> DataFrame:
            parts = [
                col_ops.mention_contributions(a.mentions),
                col_ops.item_contributions(col_ops.held_mentions(a.mentions, a.items, a.projections)),
                col_ops.definition_contributions(a.items),
                col_ops.output_contributions(a.projections),
                col_ops.using_contributions(a.using),
            ]
            rows = parts[0]
            for part in parts[1:]:
                rows = rows.unionByName(part)
            # a union of different stages does not keep their buckets
            rows = rows.repartition(a.buckets, "stmt")
            closes = a.lexemes.where(F.col("closes_calc").isNotNull()).select("stmt", "closes_calc", "pos")
            return col_ops.merge_columns(rows, closes, a.tokenised.select("stmt", "tokens"))

        return self._stage("columns", build)

    @cached_property
    def tables(self) -> DataFrame:
        return self._stage("tables", lambda a: tab.columns_per_table(a.table_rows, a.columns))

    @cached_property
    def edges(self) -> DataFrame:
        return col_ops.column_edges(self.columns)

    @cached_property
    def enriched(self) -> DataFrame:
        return self._stage("enriched", lambda a: col_ops.enrich_with_tables(a.columns, a.tables))

    @cached_property
    def statistics(self) -> DataFrame:
        return reports.query_statistics(self.texts, self.tables, self.columns)

    def per_query(self, facts: DataFrame) -> DataFrame:
        return st.per_query(facts, self.queries, self.texts.select("stmt", "copies"), self.bucket_rows)
