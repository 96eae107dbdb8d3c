"""SQL that gives the expected result of each registered query, for DuckDB.

Cleaning is restated with SQL text functions. Facts come from ``expected`` by template,
so no oracle repeats the engine's own steps.
"""

from __future__ import annotations

import json

from oracle import expected as x
from sqltrail.sinks.writers import JSON_SCHEMA
from sqltrail.sources.corpus import DIALECT_NAMES, TEMPLATES
from sqltrail.sources.statements import DIALECTS

N = len(TEMPLATES)
REPORT_TIME = "2024-01-01 00:00:00"
BLANK, SCRIPT, MISPLACED = 11, 20, (22, 23, 24)
UNREADABLE = (BLANK, *MISPLACED)
ERRORS = {BLANK: "SQL запрос пустой", **dict.fromkeys(MISPLACED, "Ошибка парсинга: соседние слова не сочетаются")}
ERROR_OF = "CASE tpl " + " ".join(f"WHEN {tpl} THEN '{message}'" for tpl, message in ERRORS.items()) + " ELSE '' END"


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


EVENTS = (
    "ev AS (SELECT event_id AS query_id, CAST(event_id % {n} AS INTEGER) AS tpl, "
    "CASE WHEN event_id % 3 = 0 THEN coalesce(event_type, 'none') "
    "ELSE CAST(coalesce(user_id, 0) AS VARCHAR) END AS g FROM events)"
).format(n=N)
BODIES = values(
    "bodies",
    "tpl, body, label, dialect",
    [(i, body, DIALECT_NAMES.get(i), DIALECTS.get(DIALECT_NAMES.get(i), "oracle")) for i, body in enumerate(TEMPLATES)],
)
CORPUS = (
    f"{EVENTS}, {BODIES}, corpus AS (SELECT query_id, tpl, g, replace(body, '{{g}}', g) AS sql, label, dialect "
    "FROM ev JOIN bodies USING (tpl))"
)


def per_event(name: str, columns: str, rows, texts: str) -> str:
    """Template rows spread over events, with the suffix filled in the given columns."""
    named = [col.strip() for col in columns.split(",")]
    filled = [col.strip() for col in texts.split(",")]
    picked = ", ".join(f"replace({col}, '{{g}}', g) AS {col}" if col in filled else col for col in named if col != "tpl")
    return (
        values(f"{name}_t", columns, rows)
        + f", {name} AS (SELECT query_id, tpl, {picked} FROM ev JOIN {name}_t USING (tpl))"
    )


TABLES = per_event(
    "tf", "tpl, ord, schema, name, table_type, aliases, join_type, columns", x.TABLES, "name, columns"
)
REFERENCES = per_event("rf", "tpl, schema, name, alias, table_type, written, join_type", x.REFERENCES, "name")
SCOPES = per_event("sf", "tpl, alias, name, selects", x.SCOPE_TABLES, "name")
MENTIONS = per_event(
    "mf", "tpl, qualifier, column_name, key_table, key_column, n, by_alias", x.MENTIONS, "column_name, key_table, key_column"
)
PROJECTIONS = per_event("pf", "tpl, relation, output, source_table, source_column", x.PROJECTIONS, "source_table")
USING = per_event("uf", "tpl, owner, column_name", x.USING, "owner")
RAW_COLUMNS = per_event(
    "cr",
    "tpl, key_table, column_name, table_alias, aliases, column_aliases, usage_locations, usage_count, "
    "calculation_type, calculation_expression, dependencies",
    x.COLUMNS,
    "key_table, column_name, dependencies",
)
COLUMNS = RAW_COLUMNS + (
    ", cf AS (SELECT *, key_table || '.' || column_name AS column_key, "
    "CASE WHEN key_table IN ('CALC', 'UNKNOWN') THEN column_name ELSE key_table || '.' || column_name END AS full_name, "
    "CASE WHEN key_table IN ('CALC', 'UNKNOWN') THEN NULL ELSE key_table END AS owner, "
    "calculation_type IS NOT NULL AS is_calculation FROM cr)"
)
# The first table of the owner's name, in the order found.
ENRICHED = (
    f"{COLUMNS}, {TABLES}, ef AS (SELECT cf.*, coalesce(cf.owner, '') AS table_name, coalesce(tf.schema, '') AS schema, "
    "coalesce(tf.table_type, '') AS object_type FROM cf LEFT JOIN tf ON tf.query_id = cf.query_id AND tf.name = cf.owner)"
)
# In sorted order lower case comes last.
VISIBLE = "regexp_replace(usage_locations, '(, )?calculation$', '')"
STATISTICS = (
    f"{COLUMNS}, {TABLES}, "
    "cs AS (SELECT query_id, count(*) AS total_columns, count(*) FILTER (WHERE is_calculation) AS calculation_columns, "
    "CAST(sum(usage_count) AS BIGINT) AS total_column_mentions FROM cf GROUP BY query_id), "
    "ts AS (SELECT query_id, count(*) AS total_tables FROM tf GROUP BY query_id), "
    "tt AS (SELECT query_id, table_type, count(*) AS n FROM tf GROUP BY query_id, table_type), "
    "st AS (SELECT ev.query_id, coalesce(total_columns, 0) AS total_columns, coalesce(total_tables, 0) AS total_tables, "
    "coalesce(total_tables, 0) AS unique_tables, coalesce(calculation_columns, 0) AS calculation_columns, "
    "coalesce(total_column_mentions, 0) AS total_column_mentions "
    "FROM ev LEFT JOIN cs USING (query_id) LEFT JOIN ts USING (query_id))"
)


def query(*parts: str, select: str) -> str:
    return "WITH " + ", ".join(parts) + " " + select


# What the date of template 8 becomes, and the messages of validation.
READ_DATE, FIXED_DATE = "to_date('05.06.2021','DD.MM.YYYY')", "CAST('2000-01-01' AS DATE)"
ERROR_NO_SELECT = "SQL запрос должен содержать ключевое слово SELECT"
ERROR_NO_FROM = "SQL запрос с WHERE должен содержать FROM"

# RE2 has no possessive groups and needs no flags for ASCII text.
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def chain(text: str, rewrites, flags: str) -> str:
    for pattern, replacement in rewrites:
        text = f"regexp_replace({text}, {literal(pattern)}, {literal(replacement)}, '{flags}')"
    return text


def comments(text: str) -> str:
    text = chain(text, [("(?m)--.*$", ""), (r"(?s)/\*.*?\*/", "")], "g")
    return STRIP.format(text)


def converted(text: str) -> str:
    """Only template 8 converts; its result is known."""
    return f"replace({text}, 'CONVERT(datetime, made)', 'CAST(made AS datetime)')"


def dated(text: str) -> str:
    """Only template 8 reads a date; its result is known."""
    return f"replace({text}, {literal(READ_DATE)}, {literal(FIXED_DATE)})"


def masked(text: str) -> str:
    return chain(text, [(r"@\w+\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)", "''")], "g")


def starred(text: str) -> str:
    text = chain(text, [(r"(\bSELECT\b)(\s+)\*", r"\1 _star_")], "gi")
    text = f"replace({text}, '.*', '._star_')"
    text = chain(text, [(r",\s*\*\s*,", ",_star_,")], "g")
    return chain(text, [(r"\*\s+(\bFROM\b)", r"_star_ \1")], "gi")


def fixed(text: str) -> str:
    text = chain(text, [(r"\s+", " ")], "g")
    text = f"replace(replace({text}, ', ,', ','), ',.', ',')"
    return STRIP.format(f"regexp_replace({text}, '^\"', '')")


def bracketed(dialect: str) -> str:
    """Only template 9 has bracketed names; its text is known."""
    parts = {"tsql": ("[", "]"), "mysql": ("`", "`"), "other": ('"', '"')}
    cases = []
    for name, (a, b) in parts.items():
        text = literal(f"SELECT {a}a b{b}, 'x[1]' FROM {a}s{b}.{a}t_") + f" || g || {literal(b)}"
        cases.append(f"WHEN {dialect} = '{name}' THEN {text}" if name != "other" else f"ELSE {text}")
    return f"CASE WHEN tpl <> 9 THEN sql ELSE CASE {' '.join(cases)} END END"


def cleaned() -> str:
    # Template 9 runs in a dialect that keeps its brackets.
    return fixed(starred(masked(dated(converted(comments("sql"))))))


def on_corpus(select: str) -> str:
    return query(CORPUS, select=f"SELECT {select} FROM corpus")


def sheet_text(column_line: str, table_line: str, prefix: str) -> tuple[str, str]:
    tables = f"(SELECT query_id, {prefix}string_agg(ord || '. ' || {table_line}, chr(10) ORDER BY ord) AS lines FROM tf GROUP BY query_id)"
    columns = (
        f"(SELECT query_id, string_agg(rn || '. ' || {column_line}, chr(10) ORDER BY rn) AS lines FROM "
        "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(owner, ''), column_name, column_key) AS rn FROM cf) "
        "GROUP BY query_id)"
    )
    return tables, columns


TABLE_LINE = (
    "coalesce(schema, '') || '.' || name || CASE WHEN aliases <> '' THEN ' (алиасы: ' || aliases || ')' ELSE '' END "
    "|| ' - ' || table_type || coalesce(' [' || join_type || ']', '')"
)
REPORT_COLUMN = (
    "'Колонка: ' || column_name || chr(10) || '   Таблица: ' || coalesce(owner, '') || ' (Алиас: ' || coalesce(table_alias, '') "
    "|| ')' || chr(10) || '   Полное имя: ' || full_name || chr(10) || '   Вычисление: ' || coalesce(calculation_type, 'нет') "
    f"|| chr(10) || '   Использование: ' || CASE WHEN {VISIBLE} = '' THEN 'нет' ELSE {VISIBLE} END || chr(10) || repeat('-', 40)"
)
LINES_COLUMN = (
    "'Колонка: ' || column_name || chr(10) || '   Таблица: ' || coalesce(owner, '') || ' (Алиас: ' || coalesce(table_alias, '') "
    "|| ')' || chr(10) || '   Полное имя: ' || full_name || chr(10) || '   Алиасы: ' || aliases || chr(10) "
    f"|| '   Использование: ' || {VISIBLE} || chr(10) || '   Упоминаний: ' || usage_count || chr(10)"
)


def report_sql() -> str:
    tables, columns = sheet_text(REPORT_COLUMN, TABLE_LINE, "count(*) AS n, ")
    return query(
        CORPUS, COLUMNS, TABLES,
        select="SELECT corpus.query_id, '=== РЕЗУЛЬТАТЫ ПАРСИНГА SQL ===' || chr(10) || 'Дата анализа: "
        f"{REPORT_TIME}' || chr(10) || 'Диалект SQL: ' || upper(dialect) || chr(10) || chr(10) || "
        "'=== УНИКАЛЬНЫЕ ТАБЛИЦЫ ===' || chr(10) || coalesce(t.lines || chr(10), '') || chr(10) || "
        "'Всего уникальных таблиц: ' || coalesce(t.n, 0) || chr(10) || chr(10) || "
        "'=== ДЕТАЛЬНЫЕ РЕЗУЛЬТАТЫ ===' || chr(10) || chr(10) || coalesce(c.lines || chr(10), '') AS report "
        f"FROM corpus LEFT JOIN {tables} t USING (query_id) LEFT JOIN {columns} c USING (query_id)",
    )


def lines_sql() -> str:
    tables, columns = sheet_text(LINES_COLUMN, TABLE_LINE, "count(*) AS n, ")
    text = (
        f"'=== РЕЗУЛЬТАТЫ ПАРСИНГА SQL ===' || chr(10) || 'Дата анализа: {REPORT_TIME}' || chr(10) || 'Диалект SQL: ' "
        "|| upper(dialect) || chr(10) || chr(10) || '=== УНИКАЛЬНЫЕ ТАБЛИЦЫ ===' || coalesce(chr(10) || t.lines, '') "
        "|| chr(10) || 'Всего уникальных таблиц: ' || coalesce(t.n, 0) || chr(10) || chr(10) "
        "|| '=== ДЕТАЛЬНЫЕ РЕЗУЛЬТАТЫ ===' || coalesce(chr(10) || c.lines, '')"
    )
    return query(
        CORPUS, COLUMNS, TABLES,
        f"tl AS (SELECT corpus.query_id, string_split({text}, chr(10)) AS parts FROM corpus "
        f"LEFT JOIN {tables} t USING (query_id) LEFT JOIN {columns} c USING (query_id))",
        "tn AS (SELECT query_id, unnest(parts) AS part, unnest(range(len(parts))) AS line FROM tl)",
        select="SELECT query_id, CAST(line AS INTEGER) AS line, "
        "CASE WHEN regexp_matches(part, '^[=+@-]') THEN '`' || part ELSE part END AS text FROM tn",
    )


def split_list(column: str) -> str:
    return f"CASE WHEN {column} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({column}, ', ') END"


def documents_sql() -> str:
    table = (
        f"{{'name': name, 'schema': schema, 'aliases': {split_list('aliases')}, 'type': table_type, "
        f"'column_count': len({split_list('columns')}), 'join_type': join_type}}"
    )
    column = (
        f"{{'full_name': full_name, 'table': owner, 'table_alias': table_alias, 'column_name': column_name, "
        f"'aliases': {split_list('aliases')}, 'column_aliases': {split_list('column_aliases')}, "
        f"'usage_locations': {split_list('usage_locations')}, 'usage_count': usage_count, 'is_calculation': is_calculation, "
        f"'calculation_type': calculation_type, 'calculation_expression': calculation_expression, "
        f"'dependencies': {split_list('dependencies')}}}"
    )
    return query(
        CORPUS, STATISTICS,
        f"td AS (SELECT query_id, string_agg(CAST(to_json({table}) AS VARCHAR), ',' ORDER BY ord) AS docs FROM tf GROUP BY query_id)",
        f"cd AS (SELECT query_id, string_agg(CAST(to_json({column}) AS VARCHAR), ',' ORDER BY coalesce(owner, ''), column_name, column_key) AS docs "
        "FROM cf GROUP BY query_id)",
        "types AS (SELECT query_id, string_agg('\"' || table_type || '\":' || n, ',' ORDER BY "
        f"CASE table_type WHEN '{x.TABLE}' THEN 0 WHEN '{x.SUBQUERY}' THEN 1 ELSE 2 END) AS docs FROM tt GROUP BY query_id)",
        select="SELECT corpus.query_id, '{\"metadata\":{\"original_sql\":' || CAST(to_json(sql) AS VARCHAR) || ',\"statistics\":' || "
        "'{\"total_columns\":' || total_columns || ',\"total_tables\":' || total_tables || ',\"unique_tables\":' || unique_tables || "
        "',\"calculation_columns\":' || calculation_columns || ',\"total_column_mentions\":' || total_column_mentions || "
        "',\"table_types\":{' || coalesce(types.docs, '') || '}},\"parse_errors\":' || "
        f"CASE WHEN tpl IN {UNREADABLE} THEN '[\"' || {ERROR_OF} || '\"]' ELSE '[]' END || '}},\"tables\":[' || coalesce(td.docs, '') || "
        "'],\"columns\":[' || coalesce(cd.docs, '') || '],\"json_schema\":' || "
        f"CASE WHEN tpl IN {UNREADABLE} THEN '{{}}' ELSE {literal(json.dumps(JSON_SCHEMA))} END || '}}' AS document "
        "FROM corpus JOIN st USING (query_id) LEFT JOIN td USING (query_id) LEFT JOIN cd USING (query_id) LEFT JOIN types USING (query_id)",
    )


def dialect_sql() -> str:
    spelled = [*DIALECTS.items(), ("no such dialect", "oracle"), (None, "oracle")]
    rows = [(i, name, value) for i, (name, value) in enumerate(spelled)]
    return query(
        values("spelled", "i, name, dialect", rows),
        select=f"SELECT event_id AS query_id, name, dialect FROM events JOIN spelled ON event_id % {len(rows)} = i",
    )


COLUMN_LIST = (
    "query_id, column_key, full_name, owner AS \"table\", table_alias, column_name, aliases, column_aliases, "
    "usage_locations, CAST(usage_count AS BIGINT) AS usage_count, is_calculation, calculation_type, "
    "calculation_expression, dependencies"
)
VIEW_COLUMNS = (
    "query_id, column_name, full_name, schema, table_name AS \"table\", coalesce(table_alias, '') AS table_alias, object_type, "
    f"aliases, {VISIBLE} AS usage, CAST(usage_count AS BIGINT) AS usage_count"
)
COLUMN_COUNT = f"CAST(len({split_list('columns')}) AS INTEGER) AS column_count"
VIEW_TABLES = (
    f"query_id, coalesce(schema, '') AS schema, name AS \"table\", aliases, table_type, {COLUMN_COUNT}, "
    "coalesce(join_type, '') AS join_type"
)


def facts(part: str, select: str) -> str:
    return query(EVENTS, part, select=select)


def all_sql() -> dict[str, str]:
    bracket_dialect = "CASE query_id % 3 WHEN 0 THEN 'tsql' WHEN 1 THEN 'mysql' ELSE 'other' END"
    search = "lower({0}) LIKE '%leaks%'"
    exploded = "unnest(string_split({0}, ', '))"
    members = (
        "SELECT DISTINCT schema, name, table_type, 'alias' AS part, unnest(" + split_list("aliases") + ") AS value FROM tf UNION ALL "
        "SELECT DISTINCT schema, name, table_type, 'column', unnest(" + split_list("columns") + ") FROM tf"
    )
    return {
        "S2_statements_from_table": on_corpus("query_id, sql, dialect"),
        "S3_normalize_dialect": dialect_sql(),
        "P1_remove_comments": on_corpus(f"query_id, {comments('sql')} AS sql_out"),
        "P2_convert_to_cast": on_corpus(f"query_id, {converted('sql')} AS sql_out"),
        "P3_mask_to_date": on_corpus(f"query_id, {dated('sql')} AS sql_out"),
        "P4_mask_variable_functions": on_corpus(f"query_id, {masked('sql')} AS sql_out"),
        "P5_rewrite_star": on_corpus(f"query_id, {starred('sql')} AS sql_out"),
        "P6_requote_brackets": on_corpus(f"query_id, {bracketed(bracket_dialect)} AS sql_out"),
        "P7_fix_common_issues": on_corpus(f"query_id, {fixed('sql')} AS sql_out"),
        "P8_preprocess": on_corpus(f"query_id, {cleaned()} AS sql_clean"),
        "P9_validate_sql": on_corpus(
            "query_id, contains(upper(sql), 'SELECT') AND (contains(upper(sql), 'FROM') OR NOT contains(upper(sql), 'WHERE')) AS is_valid, "
            f"CASE WHEN NOT contains(upper(sql), 'SELECT') THEN {literal(ERROR_NO_SELECT)} "
            f"WHEN NOT contains(upper(sql), 'FROM') AND contains(upper(sql), 'WHERE') THEN {literal(ERROR_NO_FROM)} END AS error"
        ),
        "P10_capture_errors": on_corpus(
            f"query_id, {ERROR_OF} AS parse_errors"
        ),
        "A1_cte_definitions": facts(TABLES, f"SELECT query_id, name FROM tf WHERE table_type = '{x.CTE}'"),
        "A2_table_references": facts(REFERENCES, "SELECT query_id, schema, name, alias FROM rf"),
        "A3_classify_cte_reference": facts(REFERENCES, "SELECT query_id, name, alias, table_type FROM rf"),
        "A4_derived_tables": facts(TABLES, f"SELECT query_id, name FROM tf WHERE table_type = '{x.SUBQUERY}'"),
        "A5_join_type_per_table": facts(REFERENCES, "SELECT query_id, name, alias, written AS join_type FROM rf"),
        "S1_read_sql_scripts": query(
            CORPUS,
            f"split AS (SELECT query_id, CASE WHEN tpl = {SCRIPT} THEN string_split(sql, ';') ELSE [sql] END AS parts FROM corpus)",
            "rows AS (SELECT query_id, generate_subscripts(parts, 1) AS part, unnest(parts) AS sql FROM split)",
            "named AS (SELECT CASE WHEN part = 1 THEN '/*' || query_id || '*/' || sql ELSE regexp_replace(sql, '^\\n', '') END AS sql FROM rows)",
            select="SELECT sql, count(*) AS statements FROM named GROUP BY sql",
        ),
        "S2_split_statements": query(
            CORPUS,
            f"split AS (SELECT query_id, CASE WHEN tpl = {SCRIPT} THEN string_split(sql, ';') ELSE [sql] END AS parts FROM corpus)",
            select="SELECT query_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS part, unnest(parts) AS sql FROM split",
        ),
        "S2_unread_statements": query(
            EVENTS, select=f"SELECT query_id, CAST(3 AS INTEGER) AS statements, CAST(2 AS INTEGER) AS unread FROM ev WHERE tpl = {SCRIPT}"
        ),
        "A6_oracle_outer_marks": query(EVENTS, select="SELECT query_id, 'T' AS qualifier FROM ev WHERE tpl = 6"),
        "A7_apply_oracle_outer_marks": facts(REFERENCES, "SELECT query_id, name, alias, join_type FROM rf"),
        "A8_upsert_tables": facts(TABLES, "SELECT query_id, schema, name, table_type, aliases, join_type FROM tf"),
        "A9_unique_tables": facts(TABLES, "SELECT query_id, schema, name, table_type, aliases, columns FROM tf"),
        "A9_unique_tables_corpus": facts(TABLES, members),
        "A9_table_usage_corpus": facts(
            TABLES, "SELECT schema, name, table_type, count(*) AS queries FROM tf GROUP BY schema, name, table_type"
        ),
        "A10_table_by_name": facts(
            TABLES, "SELECT query_id, schema, name, table_type FROM tf WHERE (name = 't_view' AND schema = 's') OR (name = 'ripe' AND schema IS NULL)"
        ),
        "A11_columns_per_table": facts(TABLES, f"SELECT query_id, schema, name, table_type, columns, {COLUMN_COUNT} FROM tf"),
        "R1_scope_tables": facts(SCOPES, "SELECT query_id, alias, name, CAST(selects AS BIGINT) AS selects FROM sf"),
        "R2_resolve_qualified": facts(
            MENTIONS,
            "SELECT query_id, qualifier, column_name, key_table || '.' || key_column AS column_key, CAST(n AS BIGINT) AS mentions "
            "FROM mf WHERE qualifier IS NOT NULL",
        ),
        "R3_resolve_unqualified": facts(
            MENTIONS,
            "SELECT query_id, column_name, CASE WHEN key_table <> 'UNKNOWN' THEN key_table END AS \"table\", "
            "key_table || '.' || key_column AS column_key, CAST(n AS BIGINT) AS mentions FROM mf WHERE qualifier IS NULL AND NOT by_alias",
        ),
        "R4_resolve_select_alias": facts(
            MENTIONS,
            "SELECT query_id, column_name, key_table || '.' || key_column AS column_key, CAST(n AS BIGINT) AS mentions FROM mf WHERE by_alias",
        ),
        "R5_expand_star": facts(
            MENTIONS,
            "SELECT query_id, key_table || '.' || key_column AS column_key, CAST(n AS BIGINT) AS mentions FROM mf WHERE column_name = '*'",
        ),
        "R6_projection_map": facts(
            PROJECTIONS, "SELECT query_id, relation, output, source_table || '.' || source_column AS source_key FROM pf"
        ),
        "C1_column_mentions": facts(
            MENTIONS,
            "SELECT query_id, key_table || '.' || key_column AS column_key, CAST(sum(n) AS BIGINT) AS mentions FROM mf GROUP BY ALL",
        ),
        "C2_usage_contexts": facts(COLUMNS, "SELECT query_id, column_key, usage_locations FROM cf"),
        "C3_calculation_flag": facts(COLUMNS, "SELECT query_id, column_key, is_calculation FROM cf"),
        "C4_calculation_type": facts(COLUMNS, "SELECT query_id, column_key, calculation_type FROM cf WHERE is_calculation"),
        "C5_calculation_expression": facts(COLUMNS, "SELECT query_id, column_key, calculation_expression FROM cf WHERE is_calculation"),
        "C6_select_aliases": facts(COLUMNS, "SELECT query_id, column_key, column_aliases FROM cf WHERE column_aliases <> ''"),
        "C7_calculated_columns": facts(
            COLUMNS,
            "SELECT query_id, full_name, usage_locations, CAST(usage_count AS BIGINT) AS usage_count, calculation_type, "
            "calculation_expression FROM cf WHERE key_table = 'CALC'",
        ),
        "C8_relation_output_columns": query(
            EVENTS, PROJECTIONS, COLUMNS,
            select="SELECT cf.query_id, column_key, CAST(usage_count AS BIGINT) AS usage_count, is_calculation, calculation_type "
            "FROM cf JOIN pf ON pf.query_id = cf.query_id AND relation = key_table AND output = column_name",
        ),
        "C9_column_dependencies": facts(
            COLUMNS, f"SELECT query_id, column_key, {exploded.format('dependencies')} AS depends_on FROM cf WHERE dependencies <> ''"
        ),
        "C10_using_columns": facts(USING, "SELECT query_id, owner || '.' || column_name AS column_key FROM uf"),
        "C11_qualified_alias_refs": facts(
            COLUMNS,
            f"SELECT * FROM (SELECT query_id, column_key, {exploded.format('aliases')} AS alias_ref FROM cf WHERE aliases <> '') "
            "WHERE contains(alias_ref, '.')",
        ),
        "C12_exposed_alias_hints": query(
            EVENTS, PROJECTIONS, COLUMNS,
            select="SELECT DISTINCT cf.query_id, column_key, aliases FROM cf JOIN pf ON pf.query_id = cf.query_id "
            "AND source_table = key_table AND source_column = column_name",
        ),
        "C13_preferred_table_alias": facts(COLUMNS, "SELECT query_id, column_key, table_alias FROM cf WHERE table_alias IS NOT NULL"),
        "C14_cte_mention_bump": query(
            EVENTS, COLUMNS, TABLES,
            select="SELECT cf.query_id, column_key, CAST(usage_count AS BIGINT) AS usage_count, usage_locations FROM cf JOIN tf "
            f"ON tf.query_id = cf.query_id AND tf.name = cf.key_table AND table_type = '{x.CTE}'",
        ),
        "C15_query_columns": facts(COLUMNS, f"SELECT {COLUMN_LIST} FROM cf"),
        "C16_column_table_enrichment": query(
            EVENTS, ENRICHED, select="SELECT query_id, column_key, schema, table_name, object_type FROM ef"
        ),
        "M1_query_statistics": query(
            EVENTS, STATISTICS,
            "types AS (SELECT query_id, string_agg(table_type || '=' || n, ', ' ORDER BY table_type) AS table_types FROM tt GROUP BY query_id)",
            select="SELECT st.*, coalesce(table_types, '') AS table_types FROM st LEFT JOIN types USING (query_id)",
        ),
        "M1_corpus_statistics": query(
            CORPUS, STATISTICS,
            select="SELECT dialect, count(*) AS queries, CAST(sum(total_columns) AS BIGINT) AS total_columns, "
            "CAST(sum(total_tables) AS BIGINT) AS total_tables, CAST(sum(unique_tables) AS BIGINT) AS unique_tables, "
            "CAST(sum(calculation_columns) AS BIGINT) AS calculation_columns, "
            "CAST(sum(total_column_mentions) AS BIGINT) AS total_column_mentions "
            "FROM corpus JOIN st USING (query_id) GROUP BY ROLLUP (dialect)",
        ),
        "M2_statistics_rows": query(
            EVENTS, STATISTICS,
            select="SELECT query_id, parameter, value FROM (UNPIVOT st ON total_columns, total_tables, unique_tables, "
            "calculation_columns, total_column_mentions INTO NAME parameter VALUE value) UNION ALL "
            "SELECT query_id, 'table_types.' || table_type, n FROM tt",
        ),
        "M3_columns_view": query(EVENTS, ENRICHED, select=f"SELECT {VIEW_COLUMNS} FROM ef"),
        "M4_tables_view": facts(TABLES, f"SELECT {VIEW_TABLES} FROM tf"),
        "M5_lineage_view": facts(
            COLUMNS,
            f"SELECT query_id, column_name, coalesce(owner, '') AS \"table\", full_name AS source, dependencies, {VISIBLE} AS usage FROM cf",
        ),
        "M6_filter_calculation": facts(COLUMNS, f"SELECT query_id, column_key, {VISIBLE} AS usage FROM cf"),
        "M7_columns_sample_text": query(
            EVENTS, COLUMNS,
            "lines AS (SELECT query_id, string_agg(full_name || ' | ' || aliases || ' | ' || coalesce(owner, '') || ' | ' || usage_locations "
            "|| ' | ' || usage_count, chr(10) ORDER BY coalesce(owner, ''), column_name, column_key) AS body FROM cf GROUP BY query_id)",
            select="SELECT query_id, 'Полное имя | Алиасы | Таблица | Где используется | Количество упоминаний' || chr(10) || "
            "repeat('-', 85) || coalesce(chr(10) || body, '') AS sample FROM ev LEFT JOIN lines USING (query_id)",
        ),
        "M8_text_report": report_sql(),
        "M9_search_columns": query(
            EVENTS, ENRICHED,
            f"vf AS (SELECT {VIEW_COLUMNS} FROM ef)",
            select="SELECT * FROM vf WHERE "
            + " OR ".join(
                search.format(f'CAST("{name}" AS VARCHAR)')
                for name in ("column_name", "full_name", "schema", "table", "table_alias", "object_type", "aliases", "usage", "usage_count")
            ),
        ),
        "M9_search_columns_indexed": query(
            EVENTS, ENRICHED,
            f"vf AS (SELECT {VIEW_COLUMNS} FROM ef)",
            select="SELECT * FROM vf WHERE "
            + " OR ".join(
                search.format(f'CAST("{name}" AS VARCHAR)')
                for name in ("column_name", "full_name", "schema", "table", "table_alias", "object_type", "aliases", "usage", "usage_count")
            ),
        ),
        "M9_search_tables": facts(
            f"{TABLES}, vf AS (SELECT {VIEW_TABLES} FROM tf)",
            "SELECT * FROM vf WHERE "
            + " OR ".join(search.format(f'CAST("{name}" AS VARCHAR)') for name in ("schema", "table", "aliases", "table_type", "column_count", "join_type")),
        ),
        "M10_sort_view": query(EVENTS, ENRICHED, select=f"SELECT {VIEW_COLUMNS} FROM ef ORDER BY usage_count DESC"),
        "M10_number_sorted_view": query(
            EVENTS, ENRICHED, f"vf AS (SELECT {VIEW_COLUMNS} FROM ef)",
            select="SELECT *, row_number() OVER (ORDER BY usage_count DESC NULLS LAST, query_id NULLS FIRST, column_name NULLS FIRST, "
            "full_name NULLS FIRST, schema NULLS FIRST, \"table\" NULLS FIRST, table_alias NULLS FIRST, object_type NULLS FIRST, "
            "aliases NULLS FIRST, usage NULLS FIRST) AS row_no FROM vf",
        ),
        "M11_run_summary": query(
            EVENTS, STATISTICS,
            select=f"SELECT query_id, total_columns, unique_tables, CAST(CASE WHEN tpl IN {UNREADABLE} THEN 1 ELSE 0 END AS INTEGER) AS errors "
            "FROM ev JOIN st USING (query_id)",
        ),
        "K1_json_documents": documents_sql(),
        "K2_csv_tables": facts(
            TABLES,
            "SELECT query_id, coalesce(schema, '') AS schema, name AS \"table\", aliases, table_type, coalesce(join_type, '') AS join_type, columns FROM tf",
        ),
        "K3_csv_columns": query(
            EVENTS, ENRICHED,
            select="SELECT query_id, column_name, schema, table_name AS \"table\", coalesce(table_alias, '') AS table_alias, object_type, full_name, "
            "coalesce(calculation_type, '') AS calculation_type, usage_locations AS usage, CAST(usage_count AS BIGINT) AS usage_count FROM ef",
        ),
        "K4_text_output": report_sql(),
        "K8_write_metadata": documents_sql(),
        "K5_sheet_set": query(EVENTS, ENRICHED, select=f"SELECT {VIEW_COLUMNS} FROM ef"),
        "K5_text_sheet": lines_sql(),
        "K6_escape_source_text": on_corpus(
            "query_id, CASE WHEN regexp_replace(sql, '^\\n+', '') LIKE '`%' THEN regexp_replace(sql, '^\\n+', '') "
            "ELSE '`' || regexp_replace(sql, '^\\n+', '') END AS source_sql"
        ),
        "K7_tsv_summary": query(
            EVENTS, ENRICHED,
            select="SELECT query_id, column_name, full_name, schema, table_name AS \"table\", coalesce(table_alias, '') AS table_alias, "
            "object_type, aliases, usage_locations AS usage, CAST(usage_count AS BIGINT) AS usage_count FROM ef",
        ),
    }
