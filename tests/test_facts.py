"""Golden facts of single statements, read together as one small log."""

import pytest

from sqltrail import Analysis
from sqltrail.sources.statements import split_statements

STATEMENTS = {
    "contexts": "SELECT g.song AS tune, SUM(g.plays) AS total FROM gigs g WHERE g.city = 'X' AND g.song LIKE 'a%' "
    "GROUP BY g.song HAVING MIN(g.plays) > 1 ORDER BY tune",
    "join_kinds": "SELECT 1 FROM a LEFT OUTER JOIN b ON b.k = a.k JOIN a c ON c.k = b.k RIGHT JOIN d USING (k)",
    "merge_insert": "MERGE INTO t USING s ON (t.id = s.id) WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.v + 1)",
    "named_argument": "SELECT v.value FROM t, LATERAL FLATTEN(input => t.js) v WHERE MAKE_DATE(year => t.y, month => 2) > 3",
    "filter_where": "SELECT SUM(t.a) FILTER (WHERE t.b > 1) AS f FROM t",
    "two_commas": "SELECT a,, b FROM t",
    "where_and": "SELECT a FROM t WHERE AND b = 1",
    "alias_same": "SELECT name AS name FROM t",
    "calc_alias_same": "SELECT SUM(x) AS x FROM t",
    "unaliased_sum": "SELECT SUM(x), a || b, (c) FROM t",
    "union_cte": "WITH c AS (SELECT x FROM t1 UNION SELECT y FROM t2) SELECT c.x FROM c",
    "chain_by_alias": "WITH a AS (SELECT t.x FROM t), b AS (SELECT q.x FROM a q) SELECT b.x FROM b",
    "chain_by_name": "WITH a AS (SELECT t.x FROM t), b AS (SELECT a.x AS y FROM a), c AS (SELECT b.y AS z FROM b) SELECT c.z FROM c",
    "unclosed_quote": "SELECT 'abc FROM t",
    "unclosed_bracket": "SELECT f(a FROM t",
    "extra_bracket": "SELECT a) FROM (t",
    "comment_only": "-- nothing",
    "empty": "",
    "null": None,
    "cyrillic": "SELECT к.имя AS псевдоним FROM клиенты к WHERE к.возраст > 18",
    "quoted": 'SELECT "My Col", t."x" FROM "S"."My Table" t',
    "mysql": "SELECT 'it\\'s; x', \"lit\" AS l, `c` FROM `t`",
    "two": "SELECT a FROM t; SELECT b FROM u",
    "semicolon_in_text": "SELECT a FROM t WHERE b = 'x;y' AND c = 1;",
    "distinct_from": "SELECT a FROM t WHERE b IS NOT DISTINCT FROM c",
    "extract": "SELECT EXTRACT(YEAR FROM d) y, TRIM(LEADING '0' FROM code) z, DATEADD(day, 1, ts) w FROM t",
    "literals": "SELECT DATE '2020-01-01' AS d, INTERVAL '1' DAY i, CURRENT_DATE AS today, :p1 AS p, @v, NULL AS n FROM t",
    "cast_types": "SELECT CAST(a AS DECIMAL(10, 2)) AS a2, b::varchar(5) AS b2, c::int + 1 AS c2 FROM t",
    "predicates": "SELECT a > 1 AS gt, b IN (1, 2) AS isin, c IS NULL AS missing, NOT d AS neg, -e AS minus, (f + g) AS wrapped FROM t",
    "nested_case": "SELECT CASE WHEN a = 1 THEN CASE b WHEN 2 THEN c ELSE d END ELSE e END res FROM t",
    "window": "SELECT SUM(x) OVER (PARTITION BY p ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) s, LEFT(n, 2) l FROM t",
    "catalog": "SELECT c.s.t.x, s.t.y FROM c.s.t",
    "joins": "SELECT 1 FROM a NATURAL JOIN b FULL OUTER JOIN c ON 1 = 1 LEFT SEMI JOIN d ON 1 = 1 CROSS JOIN e, f",
    "join_inherited": "SELECT s.x FROM t1 LEFT JOIN (SELECT x FROM t2 JOIN t3 ON t2.k = t3.k WHERE z IN (SELECT k FROM t4)) s ON s.x = t1.x",
    "marks": "SELECT e.a FROM emp e, dept, loc l WHERE e.d = dept.d(+) AND e.l = l.l (+) AND x(+) = 1",
    "marked_outer": "SELECT 1 FROM a RIGHT JOIN b ON a.x = b.x(+)",
    "cte_schema": "WITH users AS (SELECT 1 AS one FROM dual) SELECT s.id FROM prod.users s",
    "cte_columns": "WITH c(p, q) AS (SELECT a, b FROM t), d(r) AS (SELECT c.a FROM c) SELECT d.c FROM d",
    "nested_scope": "SELECT x, y FROM (SELECT x, y FROM t) s",
    "two_tables": "SELECT x FROM a, b",
    "scalar_in_calc": "SELECT (SELECT COUNT(*) FROM e2 WHERE e2.d = e.d) + 1 AS rnk FROM e",
    "order_alias_calc": "SELECT SUM(a) AS s FROM t ORDER BY s DESC, b",
    "literal_alias": "SELECT 1 AS one, a FROM t ORDER BY one",
    "using_three": "SELECT 1 FROM a JOIN b USING (id) JOIN c USING (id)",
    "update": "UPDATE t SET a = 1 WHERE b = 2",
    "insert": "INSERT INTO s.t (a, b) SELECT x, y FROM u",
    "merge": "MERGE INTO t USING s ON (t.id = s.id) WHEN MATCHED THEN UPDATE SET v = 1",
    "top": "SELECT TOP 10 a FROM t WITH (NOLOCK) JOIN u ON t.k = u.k",
    "table_function": "SELECT g.v FROM generate_series(1, 10) g JOIN t ON t.v = g.v",
    "star": "SELECT t.*, * FROM t",
    "filter_agg": "SELECT SUM(a) FILTER (WHERE b > 1) AS s, COUNT(DISTINCT c) n FROM t",
    "exists": "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.k = t.k)",
    "table_parens": "SELECT a.x FROM (a JOIN b ON a.k = b.k) LEFT JOIN c ON c.k = b.k",
    "double_paren": "SELECT s.x FROM ((SELECT x FROM t1) UNION ALL (SELECT x FROM t2)) s",
    "create_view": "CREATE OR REPLACE VIEW s.v (p, q) AS SELECT a, b FROM t",
    "lateral_view": "SELECT t.a, e.item FROM t LATERAL VIEW OUTER explode(t.items) e AS item WHERE t.b = 1",
    "named_window": "SELECT SUM(a) OVER w AS s FROM t WINDOW w AS (PARTITION BY b)",
    "delete_from": "DELETE t FROM t JOIN u ON t.k = u.k WHERE u.v = 1",
    "set_operations": "SELECT a FROM t MINUS SELECT b FROM u EXCEPT (SELECT c FROM v) UNION SELECT minus FROM w",
    "deep": "SELECT " + "(" * 60 + "a" + ")" * 60 + " AS v FROM t",
    "long_mixed": "WITH a AS (SELECT k, MAX(v) m FROM x GROUP BY k) SELECT y.k, a.m * 2 AS twice FROM y JOIN a ON a.k = y.k "
    "WHERE y.k IN (SELECT z.k FROM z WHERE z.d > CURRENT_DATE - :days)",
    "soft_alias": "SELECT a AS offset, b FROM t WHERE c = 1",
    "soft_column": "SELECT offset, a FROM t",
    "soft_middle": "SELECT t.a, view, b FROM t",
    "soft_interval": "SELECT a AS interval, b FROM t",
    "soft_set": "SELECT a AS set, b FROM t",
    "soft_calc": "SELECT window + 1 AS w, MAX(values) AS v FROM t WHERE for = 2 AND limit IN (1) ORDER BY set LIMIT 5 OFFSET 3",
    "soft_clauses": "SELECT a FROM t WHERE b > ANY (SELECT c FROM u) ORDER BY a LIMIT 5 OFFSET 2",
    "distinct_on": "SELECT DISTINCT ON (a) b FROM t ORDER BY a",
    "distinct_on_more": "SELECT DISTINCT ON (t.a, c) b AS x, d + 1 AS y FROM t",
    "for_update": "SELECT a FROM t WHERE b = 1 FOR UPDATE OF t",
    "star_except": "SELECT * EXCEPT (a) FROM t",
    "dollar": "SELECT $$it's; (odd$$ AS x, a, $q$ $$ ' $q$ AS y FROM t WHERE b = $1",
    "two_operators": "SELECT a FROM t WHERE a = = b",
    "empty_where": "SELECT a FROM t WHERE GROUP BY a",
    "empty_from": "SELECT a FROM WHERE b = 1",
    "empty_end": "SELECT a FROM t ORDER BY",
    "wide_chain": f"WITH p AS (SELECT {', '.join(f't.c{i}' for i in range(150))} FROM t), q AS (SELECT "
    f"{', '.join(f'p.c{i} AS d{i}' for i in range(150))} FROM p), r AS (SELECT q.d7 AS e FROM q) SELECT r.e FROM r",
    "names": "SELECT LPAD(a, 2) AS b, DENSE_RANK() AS c, JSON_VALUE(d, '$.x') AS e, MONTHS_BETWEEN(f, g) AS h FROM t",
}
DIALECTS = {"dollar": "postgres", "mysql": "mysql", "top": "tsql", "lateral_view": "hive"}


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(name, sql, DIALECTS.get(name, "oracle")) for name, sql in STATEMENTS.items()]
    analysis = Analysis(spark.createDataFrame(rows, "query_id string, sql string, dialect string"))
    columns = {name: {} for name in STATEMENTS}
    tables = {name: {} for name in STATEMENTS}
    for row in analysis.per_query(analysis.columns).collect():
        columns[row.query_id][row.column_key] = row
    for row in analysis.per_query(analysis.tables).collect():
        tables[row.query_id][(row.schema, row.name, row.table_type)] = row
    errors = {r.query_id: r.parse_errors for r in analysis.per_query(analysis.texts.select("stmt", "parse_errors")).collect()}
    yield columns, tables, errors
    analysis.release()


@pytest.fixture
def columns(facts):
    return facts[0]


@pytest.fixture
def joins(facts):
    return {name: {key[1]: row.join_type for key, row in rows.items()} for name, rows in facts[1].items()}


def test_contexts_and_counts(columns):
    column = columns["contexts"]["gigs.song"]
    assert column.usage_count == 4
    assert column.usage_locations == ["GROUP BY", "ORDER BY", "SELECT", "WHERE"]
    assert column.aliases == ["g.song", "tune"] and column.column_aliases == ["tune"]


def test_nested_clauses(columns):
    assert set(columns["merge_insert"]) == {"t.id", "s.id", "s.v", "UNKNOWN.v"} and not columns["merge_insert"]["UNKNOWN.v"].is_calculation
    assert "t.input" not in columns["named_argument"] and not {k for k in columns["named_argument"] if k.endswith((".input", ".year", ".month"))}
    assert "t.js" in columns["named_argument"] and "t.y" in columns["named_argument"]
    assert columns["filter_where"]["t.b"].usage_locations == ["SELECT", "WHERE"]
    assert columns["filter_where"]["t.a"].usage_locations == ["SELECT", "calculation"]


def test_join_types(joins):
    assert joins["join_kinds"] == {"a": "INNER JOIN", "b": "LEFT OUTER JOIN", "d": "RIGHT JOIN"}
    assert joins["joins"] == {
        "a": None, "b": "INNER JOIN", "c": "FULL OUTER JOIN", "d": "LEFT SEMI JOIN", "e": "CROSS JOIN", "f": "INNER JOIN",
    }
    assert joins["join_inherited"] == {"t1": None, "t2": "LEFT JOIN", "t3": "INNER JOIN", "t4": "LEFT JOIN", "s": None}
    assert joins["marks"] == {"emp": None, "dept": "LEFT JOIN", "loc": "LEFT JOIN"}
    assert joins["marked_outer"] == {"a": None, "b": "RIGHT JOIN"}
    assert joins["table_parens"] == {"a": None, "b": "INNER JOIN", "c": "LEFT JOIN"}


def test_alias_named_like_its_column(columns):
    assert columns["alias_same"]["t.name"].aliases == ["name"]
    assert columns["calc_alias_same"]["CALC.x"].dependencies == ["t.x"]
    assert columns["calc_alias_same"]["t.x"].usage_locations == ["SELECT", "calculation"]


def test_unaliased_expressions(columns):
    places = {key: row.usage_locations for key, row in columns["unaliased_sum"].items()}
    assert places == {"t.x": ["calculation"], "t.a": ["UNKNOWN"], "t.b": ["UNKNOWN"], "t.c": ["UNKNOWN"]}


def test_relations(columns):
    assert set(columns["union_cte"]) == {"t1.x", "t2.y", "c.x"}
    assert columns["union_cte"]["c.x"].dependencies == []
    by_alias = columns["chain_by_alias"]
    assert by_alias["b.x"].dependencies == ["a.x"] and by_alias["a.x"].dependencies == ["t.x"]
    assert by_alias["a.x"].usage_count == 3
    by_name = columns["chain_by_name"]
    assert by_name["c.z"].dependencies == ["t.x"] and by_name["t.x"].usage_count == 4
    assert set(columns["cte_columns"]) == {"t.a", "t.b", "c.a", "c.b", "d.a", "d.c"}


def test_errors(facts):
    columns, tables, errors = facts
    assert errors["empty"] == errors["null"] == ["SQL запрос пустой"]
    broken = {"unclosed_quote", "unclosed_bracket", "extra_bracket", "comment_only", "two_operators", "empty_where", "empty_from", "empty_end", "two_commas", "where_and"}
    for name in broken:
        assert len(errors[name]) == 1 and errors[name][0].startswith("Ошибка парсинга: "), name
    for name, found in errors.items():
        if found:
            assert not columns[name] and not tables[name]
    failed = {name for name, found in errors.items() if found}
    assert failed == {"empty", "null"} | broken


def test_names(facts):
    columns, tables, _ = facts
    assert set(columns["cyrillic"]) == {"клиенты.имя", "клиенты.возраст"}
    assert columns["cyrillic"]["клиенты.имя"].aliases == ["к.имя", "псевдоним"]
    assert set(columns["quoted"]) == {"My Table.My Col", "My Table.x"}
    assert [key[:2] for key in tables["quoted"]] == [("S", "My Table")]
    assert set(columns["mysql"]) == {"t.c"}
    assert set(columns["catalog"]) == {"t.x", "t.y"} and [key[:2] for key in tables["catalog"]] == [("s", "t")]
    assert list(tables["cte_schema"]) and ("prod", "users", "CTE") in tables["cte_schema"]
    assert set(columns["star"]) == {"t.*"} and columns["star"]["t.*"].usage_count == 2


def test_first_statement_only(facts):
    columns, tables, _ = facts
    assert set(columns["two"]) == {"t.a"} and [key[1] for key in tables["two"]] == ["t"]
    assert set(columns["semicolon_in_text"]) == {"t.a", "t.b", "t.c"}


def test_words_that_are_not_columns(columns):
    assert set(columns["distinct_from"]) == {"t.a", "t.b", "t.c"}
    assert set(columns["extract"]) == {"t.d", "t.code", "t.ts", "CALC.y", "CALC.z", "CALC.w"}
    assert set(columns["literals"]) == {"CALC.d", "CALC.today"}
    assert columns["literals"]["CALC.d"].calculation_type == "CAST"
    assert columns["literals"]["CALC.today"].calculation_type == "CURRENTDATE"
    assert set(columns["top"]) == {"UNKNOWN.a", "t.k", "u.k"}
    assert set(columns["table_function"]) == {"g.v", "t.v"}
    assert set(columns["exists"]) == {"t.a", "u.k", "t.k"}


def test_calculations(columns):
    types = {key: row.calculation_type for key, row in columns["cast_types"].items()}
    assert types == {
        "t.a": "CAST", "t.b": "CAST", "t.c": "CAST", "CALC.a2": "CAST", "CALC.b2": "CAST", "CALC.c2": "ARITHMETIC",
    }
    plain = columns["predicates"]
    assert not [key for key in plain if key.startswith("CALC.")]
    assert plain["t.f"].calculation_type == "ARITHMETIC" and plain["t.f"].column_aliases == ["wrapped"]
    assert plain["t.e"].is_calculation is False and plain["t.a"].column_aliases == ["gt"]
    case = columns["nested_case"]
    assert case["CALC.res"].dependencies == ["t.a", "t.b", "t.c", "t.d", "t.e"]
    assert case["t.c"].calculation_expression == "CASE b WHEN 2 THEN c ELSE d END"
    window = columns["window"]
    assert set(window) == {"t.x", "t.p", "t.o", "t.n", "CALC.s", "CALC.l"}
    assert window["CALC.s"].calculation_type == "WINDOW" and window["t.x"].calculation_type == "SUM"
    assert window["t.o"].usage_locations == ["ORDER BY", "SELECT", "calculation"]
    assert columns["deep"]["t.a"].column_aliases == ["v"]
    scalar = columns["scalar_in_calc"]
    assert scalar["CALC.rnk"].dependencies == ["e.d", "e2.d"] and scalar["e2.d"].is_calculation
    assert scalar["e2.d"].usage_locations == ["WHERE"]
    assert set(columns["filter_agg"]) == {"t.a", "t.b", "t.c", "CALC.n"}
    assert columns["filter_agg"]["t.a"].column_aliases == ["s"]


def test_scopes(columns):
    assert set(columns["nested_scope"]) == {"t.x", "t.y", "s.x", "s.y"}
    assert columns["nested_scope"]["t.x"].usage_count == 2
    assert columns["two_tables"]["UNKNOWN.x"].table is None
    assert set(columns["double_paren"]) == {"t1.x", "t2.x", "s.x"}


def test_select_aliases_in_order_by(columns):
    order = columns["order_alias_calc"]
    assert order["CALC.s"].usage_count == 2 and order["CALC.s"].usage_locations == ["ORDER BY", "SELECT"]
    assert order["t.b"].usage_locations == ["ORDER BY"]
    assert set(columns["literal_alias"]) == {"t.a"}


def test_using(columns):
    using = columns["using_three"]
    assert {key: row.usage_count for key, row in using.items()} == {"a.id": 2, "b.id": 2, "c.id": 2}


def test_other_statements(facts):
    columns, tables, _ = facts
    assert [key[:2] for key in tables["update"]] == [(None, "t")] and set(columns["update"]) == {"UNKNOWN.a", "UNKNOWN.b"}
    assert {key[:2] for key in tables["insert"]} == {("s", "t"), (None, "u")} and set(columns["insert"]) == {"u.x", "u.y"}
    assert {key[1] for key in tables["merge"]} == {"t", "s"}
    assert set(columns["merge"]) == {"t.id", "s.id", "UNKNOWN.v"}
    assert set(columns["set_operations"]) == {"t.a", "u.b", "v.c", "w.minus"}


def test_words_around_clauses(facts):
    columns, tables, _ = facts
    assert set(columns["create_view"]) == {"t.a", "t.b"} and {key[:2] for key in tables["create_view"]} == {("s", "v"), (None, "t")}
    assert set(columns["lateral_view"]) == {"t.a", "e.item", "t.items", "t.b"}
    assert {key[1] for key in tables["lateral_view"]} == {"t"} and columns["lateral_view"]["t.items"].is_calculation
    assert set(columns["named_window"]) == {"t.a", "t.b", "CALC.s"}
    assert set(columns["delete_from"]) == {"t.k", "u.k", "u.v"}


def test_long_statements(facts):
    columns, tables, _ = facts
    assert {key[1] for key in tables["long_mixed"]} == {"a", "x", "y", "z"}
    assert columns["long_mixed"]["CALC.twice"].dependencies == ["x.v"]
    assert columns["long_mixed"]["y.k"].usage_locations == ["JOIN", "SELECT", "WHERE"]
    assert not [key for key in columns["long_mixed"] if "CURRENT" in key or "days" in key]


def test_soft_words(facts):
    columns, tables, _ = facts

    def places(name):
        return {key: row.usage_locations for key, row in columns[name].items()}

    assert places("soft_alias") == {"t.a": ["SELECT"], "t.b": ["SELECT"], "t.c": ["WHERE"]}
    assert columns["soft_alias"]["t.a"].column_aliases == ["offset"]
    assert places("soft_column") == {"t.offset": ["SELECT"], "t.a": ["SELECT"]}
    assert places("soft_middle") == {"t.a": ["SELECT"], "t.view": ["SELECT"], "t.b": ["SELECT"]}
    assert places("soft_interval") == {"t.a": ["SELECT"], "t.b": ["SELECT"]} and columns["soft_interval"]["t.a"].column_aliases == ["interval"]
    assert places("soft_set") == {"t.a": ["SELECT"], "t.b": ["SELECT"]} and columns["soft_set"]["t.a"].column_aliases == ["set"]
    assert set(columns["soft_calc"]) == {"t.window", "t.values", "t.for", "t.limit", "t.set", "CALC.w", "CALC.v"}
    assert set(columns["soft_clauses"]) == {"t.a", "t.b", "u.c"} and columns["soft_clauses"]["t.a"].usage_locations == ["ORDER BY", "SELECT"]


def test_words_that_change_a_list(facts):
    columns, tables, errors = facts
    assert {k: r.usage_locations for k, r in columns["distinct_on"].items()} == {"t.a": ["ORDER BY", "UNKNOWN"], "t.b": ["SELECT"]}
    assert not columns["distinct_on"]["t.a"].column_aliases
    more = columns["distinct_on_more"]
    assert set(more) == {"t.a", "t.c", "t.b", "t.d", "CALC.y"} and more["t.b"].column_aliases == ["x"]
    assert [key[1] for key in tables["for_update"]] == ["t"] and set(columns["for_update"]) == {"t.a", "t.b"}
    assert not columns["star_except"]["t.*"].aliases and "t.EXCEPT" not in columns["star_except"]
    assert errors["dollar"] == [] and set(columns["dollar"]) == {"t.a", "t.b"}


def test_wide_chains(columns):
    wide = columns["wide_chain"]
    assert all(wide[f"q.d{i}"].dependencies == [f"t.c{i}"] for i in range(150))
    assert wide["r.e"].dependencies == ["t.c7"] and wide["t.c7"].usage_count == 4


def test_function_names(columns):
    types = {key: row.calculation_type for key, row in columns["names"].items() if key.startswith("CALC.")}
    assert types == {"CALC.b": "PAD", "CALC.c": "DENSERANK", "CALC.e": "JSONVALUE", "CALC.h": "MONTHSBETWEEN"}


def test_scripts_are_split(spark):
    scripts = [
        (1, "SELECT a FROM t; SELECT b FROM u;\n DELETE FROM v;;", "oracle"),
        (2, "SELECT ';' AS x, c FROM w -- no; end\n WHERE d = 1 /* ; */; SELECT \"e;f\" FROM [g;h]", "tsql"),
        (3, "SELECT $$;$$ AS y, k FROM m", "postgres"),
        (4, "  ;", "oracle"),
        (5, None, "oracle"),
    ]
    parts = split_statements(spark.createDataFrame(scripts, "query_id long, sql string, dialect string"))
    assert sorted(tuple(r.query_id) for r in parts.collect()) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0), (4, 0), (5, 0)]
    analysis = Analysis(parts)
    found = {}
    for row in analysis.per_query(analysis.tables).collect():
        found.setdefault(tuple(row.query_id), set()).add(row.name)
    assert found == {(1, 0): {"t"}, (1, 1): {"u"}, (1, 2): {"v"}, (2, 0): {"w"}, (2, 1): {"g;h"}, (3, 0): {"m"}}
    analysis.release()


def test_unsplit_scripts_are_marked(spark):
    """Facts of an unsplit text are those of its first statement, and the text says how many are unread."""
    texts = [
        (1, "SELECT a FROM t; SELECT b FROM u;\n DELETE FROM v;;", "oracle"),
        (2, "SELECT ';' AS x, c FROM w -- no; end\n;", "tsql"),
        (3, r"SELECT 'it\'s; one' FROM m", "mysql"),
        (4, None, "oracle"),
        (5, " ; ", "oracle"),
    ]
    log = spark.createDataFrame(texts, "query_id long, sql string, dialect string")
    analysis = Analysis(log)
    assert [tuple(r) for r in analysis.per_query(analysis.scripts).collect()] == [(1, 3, 2)]
    analysis.release()
    split = Analysis(split_statements(log))
    assert split.scripts.isEmpty()
    split.release()
