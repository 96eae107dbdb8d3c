"""Statement cleaning and validation as plain column expressions.

Every function maps a string column to a string column, so cleaning runs inside the
scan stage with no shuffle and no Python worker.

Regex notes: ``(?U)`` makes ``\\w``, ``\\s`` and ``\\b`` Unicode-aware and ``(?d)`` keeps
``\\n`` as the only line end. Repetitions over long text are possessive, which the Java
matcher runs as a loop; a greedy group would recurse and overflow on long literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, replacements and messages the results depend on.
WHITESPACE = r"[\s\x1c-\x1f]"
LINE_COMMENT = r"(?md)--.*$"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
CONVERT_REWRITES = (
    (r"\bCONVERT\s*\(\s*datetime\s*,\s*([^,]+)\s*(?:,\s*\d+\s*)?\)", "CAST($1 AS datetime)"),
    (r"\bCONVERT\s*\(\s*date\s*,\s*([^,]+)\s*(?:,\s*\d+\s*)?\)", "CAST($1 AS date)"),
    (r"\bCONVERT\s*\(\s*smalldatetime\s*,\s*([^,]+)\s*(?:,\s*\d+\s*)?\)", "CAST($1 AS smalldatetime)"),
    (r"\bCONVERT\s*\(\s*datetime2\s*,\s*([^,]+)\s*(?:,\s*\d+\s*)?\)", "CAST($1 AS datetime2)"),
    (
        r"\bCONVERT\s*\(\s*(numeric|decimal)\s*\(\s*\d+\s*,\s*\d+\s*\)\s*,\s*([^,]+)\s*(?:,\s*\d+\s*)?\)",
        "CAST($2 AS $1)",
    ),
    (
        r"\bCONVERT\s*\(\s*(var)?char\s*\(\s*\d+\s*\)\s*,\s*([^,]+)\s*(?:,\s*\d+\s*)?\)",
        "CAST($2 AS $1char)",
    ),
    (r"\bCONVERT\s*\(\s*(\w+)\s*,\s*([^,]+)\s*\)", "CAST($2 AS $1)"),
)
TO_DATE_CONSTANT = "CAST('2000-01-01' AS DATE)"
TO_DATE_PATTERNS = (
    r"\bto_date\s*\(\s*@\w+\([^)]*\)\s*,\s*'([^']+)'\s*\)",
    r"\bto_date\s*\(\s*([^,]+)\s*,\s*'([^']+)'\s*\)",
    r"\bto_date\s*\(\s*([^)]+)\s*\)",
)
VARIABLE_FUNCTION = r"@\w+\([^()]*+(?:\((?:[^()]++|\([^()]*+\))*+\)[^()]*+)*+\)"
STAR_REWRITES = (
    (r"(?iU)(\bSELECT\b)(\s+)\*", "$1 _star_"),
    (r"\.\*", "._star_"),
    (r"(?U),\s*\*\s*,", ",_star_,"),
    (r"(?iU)\*\s+(\bFROM\b)", "_star_ $1"),
)
# Text up to and including the next bracketed name, quoted runs skipped whole; an
# unclosed quote runs to the end and an unclosed bracket is ordinary text.
BRACKETED_NAME = (
    r"""\G((?:[^'"\[]++|'[^']*+(?:''[^']*+)*+(?:'|\z)|"[^"]*+(?:""[^"]*+)*+(?:"|\z)"""
    r"""|\[(?![^\]]*+\]))*+)\[([^\]]*+)\]"""
)
ERROR_EMPTY = "SQL запрос не может быть пустым"
ERROR_NO_SELECT = "SQL запрос должен содержать ключевое слово SELECT"
ERROR_NO_FROM = "SQL запрос с WHERE должен содержать FROM"


def strip(text: Column) -> Column:
    """Remove every kind of leading and trailing whitespace, not only spaces."""
    return F.regexp_replace(text, rf"(?U)\A{WHITESPACE}++|{WHITESPACE}++\z", "")


def remove_comments(sql: Column) -> Column:
    """Drop line comments, then block comments, then outer whitespace."""
    sql = F.regexp_replace(sql, LINE_COMMENT, "")
    return strip(F.regexp_replace(sql, BLOCK_COMMENT, ""))


def convert_to_cast(sql: Column) -> Column:
    """``CONVERT(type, expr[, style])`` becomes ``CAST(expr AS type)``."""
    for pattern, replacement in CONVERT_REWRITES:
        sql = F.regexp_replace(sql, "(?iU)" + pattern, replacement)
    return sql


def mask_to_date(sql: Column) -> Column:
    """Any ``to_date(...)`` becomes one constant date."""
    for pattern in TO_DATE_PATTERNS:
        sql = F.regexp_replace(sql, "(?iU)" + pattern, TO_DATE_CONSTANT)
    return sql


def mask_variable_functions(sql: Column) -> Column:
    """``@fn(...)``, arguments nested up to two levels, becomes ``''``."""
    return F.regexp_replace(sql, "(?U)" + VARIABLE_FUNCTION, "''")


def rewrite_star(sql: Column) -> Column:
    """P5: a star that stands for columns becomes the name ``_star_``."""
    for pattern, replacement in STAR_REWRITES:
        sql = F.regexp_replace(sql, pattern, replacement)
    return sql


def requote_brackets(sql: Column, dialect: Column) -> Column:
    """``[name]`` outside quotes takes the quoting of its dialect."""
    quoted = F.when(dialect == "tsql", "$1[$2]").when(dialect == "mysql", "$1`$2`").otherwise('$1"$2"')
    return F.regexp_replace(sql, F.lit(BRACKETED_NAME), quoted)


def fix_common_issues(sql: Column) -> Column:
    """Collapse whitespace, repair doubled commas, drop one leading quote, strip."""
    sql = F.regexp_replace(sql, rf"(?U){WHITESPACE}+", " ")
    sql = F.replace(F.replace(sql, F.lit(", ,"), F.lit(",")), F.lit(",."), F.lit(","))
    return strip(F.regexp_replace(sql, r'\A"', ""))


def preprocess(sql: Column, dialect: Column) -> Column:
    """P1 to P7 in order. Null and empty text pass through."""
    sql = remove_comments(sql)
    sql = convert_to_cast(sql)
    sql = mask_to_date(sql)
    sql = mask_variable_functions(sql)
    sql = rewrite_star(sql)
    sql = requote_brackets(sql, dialect)
    return fix_common_issues(sql)


def validation_error(sql: Column) -> Column:
    """Message of the first failed check, null for a valid statement."""
    upper = F.upper(sql)
    return (
        F.when(sql.isNull() | (sql == ""), ERROR_EMPTY)
        .when(~upper.contains("SELECT"), ERROR_NO_SELECT)
        .when(upper.contains("WHERE") & ~upper.contains("FROM"), ERROR_NO_FROM)
    )


def validate_sql(statements: DataFrame) -> DataFrame:
    """Add ``is_valid`` and ``error`` to a table with an ``sql`` column."""
    return statements.withColumn("error", validation_error(F.col("sql"))).withColumn(
        "is_valid", F.col("error").isNull()
    )
