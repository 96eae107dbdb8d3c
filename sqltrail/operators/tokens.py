"""Statements as a table of tokens that know where they stand.

The table has one row per token and is described by window functions only: running sums
give nesting depths, ``last(..., ignorenulls)`` finds the innermost bracket, query and
clause of a token. Every window is partitioned by the statement first, so the single
exchange on ``stmt`` made before the tokens are exploded serves all of them.

"Bracket" below means ``( ... )`` and ``CASE ... END`` alike. A bracket's own two tokens
stand on the outer level; only what lies between them is one level deeper.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The token pattern. Text is cleaned before, so blanks are single spaces.
QUOTED_NAME = r'"[^"]*+(?:""[^"]*+)*+"|`[^`]*+`|\[[^\]]*+\]'
PLAIN_NAME = r"[\p{L}_#][\w$#]*+"
NAME_PART = f"(?:{QUOTED_NAME}|{PLAIN_NAME})"
DOTTED_NAME = NAME_PART + r"(?: ?\.{1,2} ?" + NAME_PART + ")*+"
LITERAL = r"(?:\b[NEBXRU])?+'[^']*+(?:''[^']*+)*+'"
LITERAL_BACKSLASH = r"(?:\b[NEBXRU])?+'[^'\\]*+(?:(?:''|\\.)[^'\\]*+)*+'"
# A literal between equal dollar tags; what lies in it is no quote, bracket or semicolon.
LITERAL_DOLLAR = r"\$(?<tag>\w*+)\$(?s:.*?)\$\k<tag>\$|" + LITERAL
PHRASES = (
    r"\b(?:IS(?: NOT)? DISTINCT FROM|"
    r"(?:(?:NATURAL|ASOF|GLOBAL|ANY|ALL|POSITIONAL) )*+(?:(?:LEFT|RIGHT|FULL) )?+"
    r"(?:(?:OUTER|INNER|CROSS|SEMI|ANTI) )?+JOIN|"
    r"(?:CROSS|OUTER) APPLY|(?:GROUP|PARTITION|CLUSTER|DISTRIBUTE|SORT) BY|"
    r"ORDER (?:SIBLINGS )?BY|NULLS (?:FIRST|LAST)|(?:IGNORE|RESPECT) NULLS|WITHIN GROUP|GROUPING SETS|AT TIME ZONE|"
    r"(?:UNION|INTERSECT)(?: ALL| DISTINCT)?+|(?:NOT )?+MATCHED(?: BY (?:SOURCE|TARGET))?+|CONNECT BY(?: NOCYCLE)?+|START WITH|"
    r"LATERAL VIEW(?: OUTER)?+|INSERT (?:INTO|OVERWRITE)(?: TABLE)?+|MERGE INTO|IF (?:NOT )?+EXISTS|"
    r"AS (?:NOT )?+MATERIALIZED)\b"
)
# These two are names unless a query follows; the blank after them tells the tokens apart.
EXCEPT_QUERY = r"\b(?:EXCEPT|MINUS)(?: ALL| DISTINCT)?+ (?=(?:\( ?)*+(?:SELECT|WITH|VALUES)\b)"
TOP_N = r"\bTOP (?:\d++|\( ?\d++ ?\))(?: PERCENT\b)?+"
NUMBER = r"0x[0-9a-f]++|\d++(?:\.\d*+)?+(?:e[+-]?\d++)?+|\.\d++"
OPERATORS = r"\( ?\+ ?\)|::|:=|\|\||<=>|<>|!=|<=|>=|==|=>|->>|->|\^="
PLACEHOLDER = r"(?::|@@?|\$)\w++|\?"
TOKEN = "(?iU)" + "|".join((LITERAL, PHRASES, EXCEPT_QUERY, TOP_N, DOTTED_NAME, NUMBER, OPERATORS, PLACEHOLDER, r"\S"))
FIRST_STATEMENT = r"(?i)\A(?:[^;'\"`\[$]++|" + LITERAL + "|" + QUOTED_NAME + r"|['\"`\[$])*+"

# Dialects in which a backslash escapes inside a literal, and in which
# double quotes make a literal.
BACKSLASH_DIALECTS = ("bigquery", "clickhouse", "databricks", "hive", "mysql", "redshift", "snowflake")
DOLLAR_DIALECTS = ("databricks", "postgres", "snowflake")
DOUBLE_QUOTE_LITERAL_DIALECTS = ("bigquery", "databricks", "hive", "mysql")

# Words that are never a column or an alias.
RESERVED = (
    "SELECT FROM WHERE HAVING LIMIT OFFSET FETCH ALL DISTINCT ON USING AS AND OR NOT IN IS LIKE ILIKE "
    "RLIKE REGEXP BETWEEN EXISTS CASE WHEN THEN ELSE END OVER WITH RECURSIVE INTO VALUES UPDATE SET "
    "DELETE MERGE CREATE TABLE VIEW DROP ALTER TRUNCATE ASC DESC ANY SOME QUALIFY WINDOW LATERAL FOR "
    "MATCHED PRIOR PIVOT UNPIVOT TABLESAMPLE RETURNING ESCAPE COLLATE INTERVAL ROLLUP CUBE DIV MOD"
).split()
# Of these, the words that are names where a name can stand and no clause.
SOFT = (
    "LIMIT OFFSET FETCH RECURSIVE VALUES SET MERGE TABLE VIEW TRUNCATE ANY SOME QUALIFY WINDOW LATERAL FOR MATCHED "
    "PRIOR PIVOT UNPIVOT TABLESAMPLE RETURNING ESCAPE COLLATE INTERVAL ROLLUP CUBE DIV MOD"
).split()
CONSTANTS = "NULL TRUE FALSE DEFAULT".split()
# Functions written without brackets, and the type each is reported as.
BARE_FUNCTIONS = {
    "CURRENT_DATE": "CURRENTDATE",
    "CURRENT_DATETIME": "CURRENTDATETIME",
    "CURRENT_TIME": "CURRENTTIME",
    "CURRENT_TIMESTAMP": "CURRENTTIMESTAMP",
    "CURRENT_USER": "CURRENTUSER",
    "LOCALTIME": "LOCALTIME",
    "LOCALTIMESTAMP": "LOCALTIMESTAMP",
    "SESSION_USER": "SESSIONUSER",
    "SYSDATE": "CURRENTTIMESTAMP",
    "SYSTIMESTAMP": "CURRENTTIMESTAMP",
}
# Functions reported under another type than their own name.
FUNCTION_TYPES = {
    "ADD_MONTHS": "ADDMONTHS",
    "ANY_VALUE": "ANYVALUE",
    "ARG_MAX": "ARGMAX",
    "ARG_MIN": "ARGMIN",
    "ARRAY_CONTAINS": "ARRAYCONTAINS",
    "ARRAY_SIZE": "ARRAYSIZE",
    "BOOL_AND": "LOGICALAND",
    "BOOL_OR": "LOGICALOR",
    "CHAR_LENGTH": "LENGTH",
    "DATE_FROM_PARTS": "DATEFROMPARTS",
    "DENSE_RANK": "DENSERANK",
    "JSON_EXTRACT": "JSONEXTRACT",
    "JSON_OBJECT": "JSONOBJECT",
    "JSON_VALUE": "JSONVALUE",
    "LAST_DAY": "LASTDAY",
    "LCASE": "LOWER",
    "LPAD": "PAD",
    "MAX_BY": "ARGMAX",
    "MIN_BY": "ARGMIN",
    "MONTHS_BETWEEN": "MONTHSBETWEEN",
    "NTH_VALUE": "NTHVALUE",
    "PARSE_JSON": "PARSEJSON",
    "PERCENT_RANK": "PERCENTRANK",
    "REGEXP_EXTRACT": "REGEXPEXTRACT",
    "REGEXP_LIKE": "REGEXPLIKE",
    "RPAD": "PAD",
    "SORT_ARRAY": "SORTARRAY",
    "SPLIT_PART": "SPLITPART",
    "STARTS_WITH": "STARTSWITH",
    "STRPOS": "STRPOSITION",
    "TIMESTAMP_TRUNC": "TIMESTAMPTRUNC",
    "TO_TIMESTAMP": "STRTOTIME",
    "UCASE": "UPPER",
    "APPROX_COUNT_DISTINCT": "APPROXDISTINCT",
    "ARRAY_AGG": "ARRAYAGG",
    "CEILING": "CEIL",
    "CHARINDEX": "STRPOSITION",
    "CONCAT_WS": "CONCATWS",
    "COUNT_IF": "COUNTIF",
    "CUME_DIST": "CUMEDIST",
    "DATE_ADD": "DATEADD",
    "DATE_DIFF": "DATEDIFF",
    "DATE_SUB": "DATESUB",
    "DATE_TRUNC": "DATETRUNC",
    "FIRST_VALUE": "FIRSTVALUE",
    "GETDATE": "CURRENTTIMESTAMP",
    "GROUP_CONCAT": "GROUPCONCAT",
    "IFNULL": "COALESCE",
    "IIF": "IF",
    "INSTR": "STRPOSITION",
    "ISNULL": "COALESCE",
    "LAST_VALUE": "LASTVALUE",
    "LEN": "LENGTH",
    "LISTAGG": "GROUPCONCAT",
    "LTRIM": "TRIM",
    "NOW": "CURRENTTIMESTAMP",
    "NVL": "COALESCE",
    "PERCENTILE_CONT": "PERCENTILECONT",
    "PERCENTILE_DISC": "PERCENTILEDISC",
    "POWER": "POW",
    "REGEXP_REPLACE": "REGEXPREPLACE",
    "REGEXP_SUBSTR": "REGEXPEXTRACT",
    "ROW_NUMBER": "ROWNUMBER",
    "RTRIM": "TRIM",
    "SAFE_CAST": "CAST",
    "STDDEV_POP": "STDDEVPOP",
    "STDDEV_SAMP": "STDDEVSAMP",
    "STRING_AGG": "GROUPCONCAT",
    "SUBSTR": "SUBSTRING",
    "TO_CHAR": "TOCHAR",
    "TO_NUMBER": "TONUMBER",
    "TRY_CAST": "CAST",
    "VAR_POP": "VARIANCEPOP",
    "VAR_SAMP": "VARIANCE",
}
# Words with a special reading in one place only.
CAST_FUNCTIONS = "CAST TRY_CAST SAFE_CAST".split()
UNIT_FUNCTIONS = "DATEADD DATEDIFF DATENAME DATEPART EXTRACT TIMESTAMPADD TIMESTAMPDIFF".split()
LITERAL_PREFIXES = "DATE DATETIME TIME TIMESTAMP TIMESTAMPTZ".split()
FRAME_WORDS = "ROWS RANGE GROUPS UNBOUNDED PRECEDING FOLLOWING CURRENT ROW EXCLUDE TIES".split()
TRIM_WORDS = "LEADING TRAILING BOTH".split()

NAMES = ("name", "id")
OPERAND_ENDS = ("name", "id", "str", "num", "var", "const", "call", ")", "END")
OPENING, CLOSING = ("(", "CASE"), (")", "END")
COMPARISONS = ("=", "==", "<", ">", "<=", ">=", "<>", "!=", "<=>", "^=", "~")
PREDICATES = COMPARISONS + tuple(
    "AND OR NOT IN IS LIKE ILIKE RLIKE REGEXP BETWEEN EXISTS ANY SOME".split()
) + ("IS DISTINCT FROM",)
CALC_BRACKETS = ("fn", "cast", "case", "over")
TABLE_CLAUSES = ("FROM", "JOIN")
# Clause that a keyword of the query's own level opens.
CLAUSES = {
    "SELECT": "SELECT",
    "FROM": "FROM",
    "JOIN": "JOIN",
    "APPLY": "JOIN",
    "WHERE": "WHERE",
    "GROUP BY": "GROUP BY",
    "HAVING": "HAVING",
    "ORDER BY": "ORDER BY",
    "LIMIT": "LIMIT",
    "OFFSET": "LIMIT",
    "FETCH": "LIMIT",
    "FOR": "LIMIT",
    "INTO": "INTO",
    "UPDATE": "INTO",
    "TABLE": "INTO",
    "VIEW": "INTO",
    "WITH": "WITH",
    "SETOP": "OTHER",
    "LATERAL VIEW": "OTHER",
    "SET": "OTHER",
    "VALUES": "OTHER",
    "QUALIFY": "OTHER",
    "WINDOW": "OTHER",
    "RETURNING": "OTHER",
    "CONNECT BY": "OTHER",
    "START WITH": "OTHER",
    "DISTRIBUTE BY": "OTHER",
}
NOT_DELIMITERS = ("CASE", "END", "OVER", "INTERVAL", "COLLATE", "PRIOR", "DIV", "MOD")
DELIMITERS = (
    tuple(word for word in RESERVED if word not in NOT_DELIMITERS)
    + COMPARISONS
    + (",", "||", ":=", "=>", "TOP", "JOIN", "APPLY", "SETOP", "IS DISTINCT FROM", "NULLS")
    + ("GROUP BY", "PARTITION BY", "ORDER BY", "DISTRIBUTE BY", "CONNECT BY", "START WITH", "GROUPING SETS")
)

# A soft word is a name between one of the first and one of the second, or the end.
BEFORE_NAMES = (
    "SELECT ALL DISTINCT WHERE HAVING ON AND OR NOT THEN ELSE CASE WHEN LIKE BETWEEN".split()
    + ["GROUP BY", "ORDER BY", "PARTITION BY", "DISTRIBUTE BY", ",", "(", "+", "-", "*", "/", "%", "||", *COMPARISONS]
)
AFTER_NAMES = (
    "FROM AS AND OR IS IN LIKE ILIKE BETWEEN THEN WHEN ELSE END ASC DESC WHERE HAVING LIMIT INTO NOT".split()
    + ["GROUP BY", "ORDER BY", "PARTITION BY", "JOIN", "SETOP", "NULLS", ",", ")", ";", "+", "-", "*", "/", "%", "||", "::", *COMPARISONS]
)
STAR_CHANGES = ("EXCEPT", "EXCLUDE", "REPLACE", "RENAME")

STRAY_QUOTE = -(1 << 30)
ERROR_BLANK = "SQL запрос пустой"
ERROR_PREFIX = "Ошибка парсинга: "
ERROR_NOTHING = ERROR_PREFIX + "нет выражения"
ERROR_BRACKETS = ERROR_PREFIX + "непарные скобки"
ERROR_QUOTES = ERROR_PREFIX + "незакрытая кавычка"
ERROR_PLACE = ERROR_PREFIX + "соседние слова не сочетаются"


def token_array(sql_clean: Column, dialect: Column) -> Column:
    """Tokens of the first statement of the text."""
    escaped = dialect.isin(*BACKSLASH_DIALECTS)

    def split(literal: str) -> Column:
        first = F.when(
            sql_clean.contains(";"), F.regexp_extract(sql_clean, FIRST_STATEMENT.replace(LITERAL, literal), 0)
        ).otherwise(sql_clean)
        return F.regexp_extract_all(first, F.lit(TOKEN.replace(LITERAL, literal)), F.lit(0))

    dollars = dialect.isin(*DOLLAR_DIALECTS) & sql_clean.contains("$")
    return F.when(dollars, split(LITERAL_DOLLAR)).when(escaped, split(LITERAL_BACKSLASH)).otherwise(split(LITERAL))


def bracket_balance(tokens: Column) -> Column:
    """Open brackets left at the end; negative once one closes too many, or STRAY_QUOTE.

    Only brackets and stray quotes of the token array are kept for the fold.
    """
    marks = F.filter(tokens, lambda t: t.isin("(", ")", "'", '"', "`"))

    def step(depth: Column, mark: Column) -> Column:
        return (
            F.when(~mark.isin("(", ")"), STRAY_QUOTE)
            .when(depth < 0, depth)
            .otherwise(depth + F.when(mark == "(", 1).otherwise(-1))
        )

    return F.aggregate(marks, F.lit(0), step)


def structural_errors(sql: Column, sql_clean: Column, balance: Column, misplaced: Column) -> Column:
    """P10: what stops a statement from being read, as an array of messages."""
    message = (
        F.when(sql.isNull() | ~sql.rlike(r"(?U)[^\s\x1c-\x1f]"), ERROR_BLANK)
        .when(~F.coalesce(sql_clean, F.lit("")).rlike(r"\A[^;]"), ERROR_NOTHING)
        .when(balance == STRAY_QUOTE, ERROR_QUOTES)
        .when(balance != 0, ERROR_BRACKETS)
        .when(misplaced, ERROR_PLACE)
    )
    return F.filter(F.array(message), lambda m: m.isNotNull())


def token_pieces(tokens: Column, lo: Column, hi: Column) -> Column:
    """Tokens ``lo`` to ``hi`` as pieces of readable text: each carries the blank before it, if any."""
    keywords = [*RESERVED, *CONSTANTS, *BARE_FUNCTIONS, *LITERAL_PREFIXES]

    def piece(i: Column) -> Column:
        token, before, after = F.get(tokens, i), F.get(tokens, i - 1), F.get(tokens, i + 1)
        upper = F.upper(token)
        word = token.rlike(r"\A[\p{L}_]")
        text = F.when(
            upper.isin(*keywords) | (word & token.contains(" ") & ~token.contains(".")) | ((after == "(") & word),
            upper,
        ).otherwise(token)
        opens_call = (token == "(") & before.rlike(r"\A[\p{L}_#\"`\[]") & ~before.contains(" ") & ~F.upper(before).isin(*RESERVED)
        glued = token.isin(")", ",", "::") | before.isin("(", "::") | opens_call | (i == 0)
        return F.concat(F.when(glued, "").otherwise(" "), F.rtrim(text))

    return F.transform(F.sequence(lo, hi), piece)


def name_parts(token: Column) -> Column:
    """Parts of a dotted name, quotes removed."""
    parts = F.regexp_extract_all(token, F.lit("(?U)" + NAME_PART), F.lit(0))
    return F.transform(
        parts,
        lambda p: F.when(
            p.startswith('"'), F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))
        )
        .when(p.startswith("`") | p.startswith("["), F.substring(p, F.lit(2), F.length(p) - 2))
        .otherwise(p),
    )


def plain_name(token: Column) -> Column:
    """Last part of a name, or the content of a literal, for aliases."""
    return F.when(token.startswith("'"), F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(
        F.try_element_at(name_parts(token), F.lit(-1))
    )


def lookup(entries: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in entries.items() for x in pair]), key)


def symbol(token: Column, double_quote_literal: Column) -> Column:
    """Token class: a reserved word or operator as itself, other tokens as a class name."""
    first = F.substring(token, 1, 1)
    upper = F.upper(token)
    spaced = upper.contains(" ")
    return (
        F.when(token.endswith("'") & (F.length(token) > 1), "str")
        .when((first == "$") & token.endswith("$") & (F.length(token) > 3), "str")
        .when(first == '"', F.when(double_quote_literal, "str").otherwise("id"))
        .when(first.isin("`", "[") & (F.length(token) > 1), "id")
        .when(first.between("0", "9") | ((first == ".") & (F.length(token) > 1)), "num")
        .when((token == "?") | (first.isin(":", "@", "$") & token.rlike(r"(?U)\A\W{1,2}\w")), "var")
        .when(upper.isin(*RESERVED), upper)
        .when(upper.isin(*CONSTANTS), "const")
        .when(upper.isin(*BARE_FUNCTIONS), "call")
        .when(first.isin(*(set(string.punctuation) - set("_#"))), token)
        .when(token.contains("."), "id")
        .when(upper.endswith("JOIN") & (spaced | (upper == "JOIN")), "JOIN")
        .when(spaced & upper.endswith(" APPLY"), "APPLY")
        .when(spaced & upper.endswith("DISTINCT FROM"), "IS DISTINCT FROM")
        .when(spaced & upper.rlike(r"\A(?:ORDER|SORT|CLUSTER) "), "ORDER BY")
        .when(spaced & upper.startswith("CONNECT BY"), "CONNECT BY")
        .when(spaced & upper.startswith("NULLS "), "NULLS")
        .when(spaced & upper.startswith("LATERAL VIEW"), "LATERAL VIEW")
        .when(spaced & upper.startswith("TOP "), "TOP")
        .when(spaced & upper.startswith("AS "), "AS")
        .when(spaced & upper.rlike(r"\A(?:INSERT|MERGE) "), "INTO")
        .when(upper.rlike(r"\A(?:UNION|INTERSECT)(?: |\z)") | (spaced & upper.rlike(r"\A(?:EXCEPT|MINUS) ")), "SETOP")
        .when(spaced, upper)
        .otherwise("name")
    )


def join_type(token: Column) -> Column:
    """A5: side and kind as written; a join without either is an inner join."""
    text = F.regexp_extract(
        F.upper(token), r"(?:(?:LEFT|RIGHT|FULL) )?(?:(?:OUTER|INNER|CROSS|SEMI|ANTI) )?JOIN\z", 0
    )
    return F.when(text.isin("", "JOIN"), "INNER JOIN").otherwise(text)


def explode_tokens(readable: DataFrame) -> DataFrame:
    """``(stmt, pos, tok, w)`` of every readable statement.

    The exchange comes before the explode: it moves each text once, and the windows
    below reuse its partitioning for the many token rows. Every text has a token; the outer
    explode only keeps the optimizer from tokenising a second time to test that.
    """
    tokens = readable.select(
        "stmt",
        F.col("dialect").isin(*DOUBLE_QUOTE_LITERAL_DIALECTS).alias("dq"),
        F.posexplode_outer("tokens").alias("pos", "tok"),
    )
    # Told by the token, as a test of its class would make the optimizer classify every token once more for each mention.
    skipped = F.upper("tok").isin("IF EXISTS", "IF NOT EXISTS") | (F.col("tok").startswith("(") & (F.col("tok") != "("))
    return tokens.where(~skipped).select("stmt", "pos", "tok", symbol(F.col("tok"), F.col("dq")).alias("w"))


def settle_soft_words(tokens: DataFrame) -> DataFrame:
    """Read soft words as names where they stand as one: after AS, or as a whole operand."""
    window = Window.partitionBy("stmt").orderBy("pos")
    before, after = F.lag("w").over(window), F.lead("w").over(window)
    operand = before.isin(*BEFORE_NAMES) & (after.isNull() | after.isin(*AFTER_NAMES))
    operand &= (F.col("w") != "MATCHED") | (before != "WHEN")
    named = F.col("w").isin(*SOFT) & (((before == "AS") & F.coalesce(after != "(", F.lit(True))) | operand)
    return tokens.withColumn("w", F.when(F.coalesce(named, F.lit(False)), "name").otherwise(F.col("w")))


def running(order: str, *partition: str):
    """Running frames over a statement: before the row, and up to it."""
    window = Window.partitionBy("stmt", *partition).orderBy(order)
    return (
        window,
        window.rowsBetween(Window.unboundedPreceding, -1),
        window.rowsBetween(Window.unboundedPreceding, Window.currentRow),
    )


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def level(opens: Column, closes: Column, before, upto) -> Column:
    """How many brackets of a class are open around a token."""
    return (F.coalesce(F.sum(opens).over(before), F.lit(0)) - F.sum(closes).over(upto)).cast("int")


def names_alias(tok: Column, w: Column, p1t: Column, p1w: Column, p2w: Column, n1w: Column) -> Column:
    """Whether a token between its neighbours is an alias."""
    unit = (p2w == "INTERVAL") | ((F.upper(tok) == "FILTER") & (n1w == "("))
    unit |= F.upper(tok).isin(*STAR_CHANGES) & (n1w == "(") & p1t.endswith("_star_")
    named = (w.isin(*NAMES) & ((p1w == "AS") | p1w.isin(*OPERAND_ENDS))) | ((w == "str") & (p1w == "AS"))
    return F.coalesce(~F.coalesce(unit, F.lit(False)) & named, F.lit(False))


def with_neighbours(tokens: DataFrame) -> DataFrame:
    """What the tokens around a token say of it; ``kept`` holds what no step before ``with_roles`` sorts or compares."""
    window, before, upto = running("pos")
    c = F.col
    tokens = tokens.select(
        "*",
        *[F.lag("w", i).over(window).alias(f"p{i}w") for i in (1, 2, 3)],
        *[F.lead("w", i).over(window).alias(f"n{i}w") for i in (1, 2, 3)],
        *[F.lag("tok", i).over(window).alias(f"p{i}t") for i in (1, 2)],
        *[F.lead("tok", i).over(window).alias(f"n{i}t") for i in (1, 2)],
        F.lag("pos").over(window).alias("p1pos"),
        level(flag(c("w").isin(*OPENING)), flag(c("w").isin(*CLOSING)), before, upto).alias("depth"),
    )
    is_alias = names_alias(c("tok"), c("w"), c("p1t"), c("p1w"), c("p2w"), c("n1w"))
    called = F.upper(F.try_element_at(name_parts(c("p1t")), F.lit(-1)))
    p1_alias = names_alias(c("p1t"), c("p1w"), c("p2t"), c("p2w"), c("p3w"), c("w"))
    # What a bracket is, told by the tokens around its opening.
    kind = (
        F.when(c("w") == "CASE", "case")
        .when(c("w") != "(", None)
        .when(c("n1w").isin("SELECT", "WITH"), "query")
        .when((c("p1w") == "ON") & (c("p2w") == "DISTINCT"), "distinct")
        .when(c("p1w") == "OVER", "over")
        .when(c("p1w") == "USING", "using")
        .when(c("p1w").isin("FROM", "JOIN", "APPLY", "LATERAL"), "table")
        .when((c("p1w") == "(") & c("p2w").isin("FROM", "JOIN"), "table")
        .when((F.upper("p1t") == "INSERT") & (c("p2w") == "THEN"), "list")
        .when(p1_alias | (c("p1w") == "WITH") | (c("p1w").isin(*NAMES) & c("p2w").isin("INTO", "TABLE", "VIEW", "WITH", "RECURSIVE")), "list")
        .when(c("p1w").isin(*NAMES) & (called == "FILTER") & (c("n1w") == "WHERE"), "filter")
        .when(c("p1w").isin(*NAMES) & called.isin(*STAR_CHANGES) & c("p2t").endswith("_star_"), "plain")
        .when(c("p1w").isin(*NAMES) & called.isin(*CAST_FUNCTIONS), "cast")
        .when(c("p1w").isin(*NAMES) | (c("p1w") == "MOD"), "fn")
        .otherwise("plain")
    )
    tokens = tokens.withColumn("bkind", kind)
    calc_type = (
        F.when(c("bkind") == "case", "CASE")
        .when(c("bkind") == "over", "WINDOW")
        .when(c("bkind").isin("fn", "cast"), F.coalesce(lookup(FUNCTION_TYPES, called), called))
    )
    # Settled here so that no neighbour text travels through the later sorts.
    follows = F.when((c("n1w") == "AS") & c("n2w").isin(*NAMES), c("n2t")).when(
        c("n1w").isin(*NAMES) & c("w").isin(*OPERAND_ENDS), c("n1t")
    )
    head = c("w").isin(*CLOSING) & (c("n1w") == "AS") & (c("n2w") == "(") & c("n3w").isin("SELECT", "WITH", "(")
    return tokens.select(
        "stmt", "pos", "w", "p1w", "depth", is_alias.alias("is_alias"),
        F.struct(
            "tok", "p2w", "n1w",
            F.when(c("w").isin("name", "id", ")"), follows).alias("follows"),
            F.when((c("w") == "(") & (c("p1w") == "AS") & c("p2w").isin(*NAMES), c("p2t")).alias("cte_name"),
        ).alias("kept"),
        F.coalesce(head, F.lit(False)).alias("head"),
        F.when(
            c("w").isin(*OPENING),
            F.struct(
                c("pos").alias("open"),
                c("bkind").alias("kind"),
                calc_type.alias("type"),
                F.when(c("bkind").isin("fn", "cast"), c("p1pos")).otherwise(c("pos")).alias("lo"),
                c("p1t").alias("before"),
                c("p1w").alias("before_w"),
                c("n1w").alias("after_w"),
            ),
        ).alias("bracket"),
    )


def with_brackets(tokens: DataFrame) -> DataFrame:
    """Innermost bracket ``g``, matching opening ``m`` and operand run ``seg``; from here ``t`` holds all that is settled."""
    c = F.col
    window, _, _ = running("pos")
    closes = c("w").isin(*CLOSING)
    outer = F.lag("bracket").over(window)
    # The bracket a token is the first one of.
    tokens = tokens.withColumn("outer", F.when(c("p1w").isin(*OPENING) & ~closes, outer)).select(
        *tokens.columns,
        F.when(c("outer").isNotNull(), F.struct(*[c(f"outer.{name}").alias(name) for name in ("open", "kind", "type", "before")])).alias("entered"),
    )
    _, _, upto = running("pos", "depth")
    # What follows the list of DISTINCT ON begins the select list; the list itself is no item.
    tokens = tokens.withColumn("m", F.last("bracket", ignorenulls=True).over(upto))
    listed = F.coalesce(c("m.kind") == "distinct", F.lit(False))
    tokens = tokens.withColumn("is_alias", c("is_alias") & ~(listed & (c("p1w") == ")")))
    delimiter = c("w").isin(*DELIMITERS) | c("is_alias") | (listed & c("w").isin("(", ")"))
    arithmetic = c("w").isin("+", "-", "*", "/", "%", "MOD") & c("p1w").isin(*OPERAND_ENDS)
    # Only of a closing token is the opening one read again.
    ends = [F.when(closes, c(f"m.{name}")).alias(f"m_{name}") for name in ("open", "kind", "before", "before_w", "after_w")]
    tokens = tokens.select(
        *[name for name in tokens.columns if name != "m"],
        *ends,
        F.last("entered", ignorenulls=True).over(upto).alias("g"),
        F.coalesce(
            F.last(F.when(c("entered").isNotNull() | delimiter, c("pos")), ignorenulls=True).over(upto), F.lit(-1)
        ).alias("seg"),
        F.coalesce(
            F.last(
                F.when(c("w") == "ORDER BY", F.lit(True)).when(c("entered").isNotNull(), F.lit(False)),
                ignorenulls=True,
            ).over(upto),
            F.lit(False),
        ).alias("ordered"),
        delimiter.alias("delimiter"),
        F.coalesce(arithmetic, F.lit(False)).alias("arithmetic"),
    )
    run = Window.partitionBy("stmt", "seg")
    u = F.upper("kept.tok")
    not_column = (
        ((c("p1w") == "(") & F.upper("g.before").isin(*UNIT_FUNCTIONS) & (c("w") == "name"))
        | ((c("g.type") == "TRIM") & u.isin(*TRIM_WORDS))
        | ((c("g.kind") == "over") & u.isin(*FRAME_WORDS))
    )
    settled = F.struct(
        "kept", "w", "p1w", "is_alias", "bracket", "delimiter", "arithmetic", *[f"m_{name}" for name in ("open", "kind", "before", "before_w", "after_w")],
        c("entered.open").alias("entered_open"),
        (c("entered.kind") == "query").alias("enters_query"),
        (c("ordered") & ~F.coalesce(c("g.kind") == "query", F.lit(True))).alias("in_order"),
        c("g.kind").alias("g_kind"),
        F.coalesce(not_column, F.lit(False)).alias("not_column"),
    )
    return tokens.select(
        "stmt",
        "pos",
        settled.alias("t"),
        F.max("arithmetic").over(run).alias("seg_arith"),
        F.max(F.coalesce(c("w") == "::", F.lit(False))).over(run).alias("seg_cast"),
        F.max("head").over(run).alias("seg_head"),
        F.min(F.when(~c("delimiter"), c("pos"))).over(run).alias("seg_lo"),
        F.max(F.when(~c("delimiter"), c("pos"))).over(run).alias("seg_hi"),
    )


def with_levels(tokens: DataFrame) -> DataFrame:
    """Nesting by class: queries, calculations, ordered brackets, name lists."""
    c = F.col
    window, before, upto = running("pos")
    seg_calc = c("seg_arith") | c("seg_cast")
    kind = F.coalesce("t.bracket.kind", "t.m_kind")
    listed = (kind == "list") | ((kind == "fn") & c("seg_head"))
    calc = (kind.isin(*CALC_BRACKETS) & ~listed) | seg_calc
    opens, closes = c("t.w").isin(*OPENING), c("t.w").isin(*CLOSING)
    typed = F.coalesce(c("t.bracket.type"), F.when(c("seg_arith"), "ARITHMETIC").when(c("seg_cast"), "CAST"))
    own_type = kind.isin(*CALC_BRACKETS)
    tokens = tokens.select(
        "stmt", "pos", "t", "seg_arith", "seg_cast", "seg_lo", "seg_hi",
        F.when(
            opens & calc,
            F.struct(
                c("pos").alias("open"),
                typed.alias("type"),
                F.when(own_type & (kind != "over"), c("t.bracket.lo")).otherwise(c("seg_lo")).alias("lo"),
                F.when(~own_type, c("seg_hi")).alias("hi"),
            ),
        ).alias("calc_bracket"),
        *[
            level(flag(opens & member), flag(closes & member), before, upto).alias(name)
            for name, member in (("sd", kind == "query"), ("cd", calc), ("od", c("t.in_order")), ("ld", listed))
        ],
        F.when((c("t.p1w") == "AS") & (c("t.kept.p2w") == ")"), F.lag("t.m_before", 2).over(window)).alias("listed_name"),
    )
    return tokens.withColumn(
        "calc_entered", F.when(c("t.entered_open").isNotNull(), F.lag("calc_bracket").over(window))
    ).select("stmt", "pos", "sd", "cd", "od", "calc_entered", F.struct("t", "seg_arith", "seg_cast", "seg_lo", "seg_hi", "ld", "listed_name").alias("s"))


def with_scopes(tokens: DataFrame) -> DataFrame:
    """Owning SELECT, clause, list item and join of every token."""
    c = F.col
    _, _, upto = running("pos", "sd")

    def latest(value: Column) -> Column:
        return F.last(value, ignorenulls=True).over(upto)

    w, p1w, n1w = c("s.t.w"), c("s.t.p1w"), c("s.t.kept.n1w")
    own = F.coalesce(c("s.t.g_kind").isin("query", "table"), F.lit(True))
    starts = F.coalesce("s.t.enters_query", F.lit(False))
    # A table hint or table function is no clause of its own.
    hint = w.isin("WITH", "TABLE") & (n1w == "(")
    hint |= (w == "UPDATE") & (p1w == "FOR")
    opens_clause = w.isin(*CLAUSES) & ~F.coalesce(hint, F.lit(False))
    clause = lookup(CLAUSES, w)
    keyword = F.when(
        own & opens_clause,
        F.struct(
            c("pos").alias("pos"),
            clause.alias("clause"),
            F.when(clause == "JOIN", join_type(c("s.t.kept.tok"))).alias("join_type"),
        ),
    ).when(starts, F.struct(c("pos").alias("pos"), F.lit("NONE").alias("clause"), F.lit(None).cast("string").alias("join_type")))
    select = own & (w == "SELECT")
    tokens = tokens.select(
        "stmt", "pos", "sd", "cd", "od", "calc_entered", "s",
        own.alias("own"),
        F.coalesce(latest(F.when(starts, c("s.t.entered_open"))), F.lit(-1)).alias("qid"),
        latest(F.when(select, c("pos")).when(starts, F.lit(-1))).alias("sel"),
        latest(F.when(select & (F.coalesce(p1w, F.lit("")) != "SETOP"), c("pos")).when(starts, F.lit(-1))).alias("first_sel"),
        latest(keyword).alias("kw"),
        latest(F.when(own & ((w == ",") | ((w == ")") & (c("s.t.m_kind") == "distinct"))), c("pos"))).alias("comma"),
        F.coalesce(latest(F.when(own & (w == "SETOP"), True).when(starts, False)), F.lit(False)).alias("in_union"),
        F.coalesce(latest(F.when(starts, c("od"))), F.lit(0)).alias("od_outer"),
    )
    after_comma = F.coalesce(c("comma") > c("kw.pos"), F.lit(False))
    tokens = tokens.select(
        "*",
        F.when((c("kw.clause") == "FROM") & after_comma, "JOIN")
        .otherwise(F.coalesce(c("kw.clause"), F.lit("NONE")))
        .alias("clause"),
        F.when(c("kw.clause").isin(*TABLE_CLAUSES) & after_comma, "INNER JOIN").otherwise(c("kw.join_type")).alias("join_type"),
        F.when(after_comma, c("comma")).otherwise(c("kw.pos")).alias("item"),
    )
    # ORDER BY after a set operation belongs to no single SELECT.
    trailing = c("in_union") & (c("clause") == "ORDER BY")
    tokens = tokens.select(
        "stmt", "pos", "sd", "cd", "calc_entered", "own", "qid", "clause", "item", "join_type",
        "s.seg_arith", "s.seg_cast", "s.seg_lo", "s.seg_hi", "s.ld", "s.listed_name", "s.t.*",
        ((c("od") > c("od_outer")) | c("s.t.in_order")).alias("ordered"),
        F.when(trailing | (c("sel") < 0), None).otherwise(c("sel")).alias("scope"),
        F.when(trailing, c("first_sel")).otherwise(c("sel")).alias("alias_scope"),
    ).select("*", "kept.*")
    # Other tokens have no role, nor do they enter a calculation.
    read = c("w").isin(*NAMES, *OPENING, *CLOSING, "SETOP") | (c("own") & (c("clause") == "SELECT")) | c("calc_entered").isNotNull()
    return tokens.where(read)


def with_roles(tokens: DataFrame) -> DataFrame:
    """What each token is for: table, relation body, column, USING column, list item."""
    c = F.col
    name = c("w").isin(*NAMES)
    in_tables = c("clause").isin(*TABLE_CLAUSES)
    table_position = (
        (c("p1w").isin("FROM", "JOIN", "APPLY", "INTO", "UPDATE", "TABLE", "VIEW") & ~F.coalesce((c("p1w") == "UPDATE") & (c("p2w") == "FOR"), F.lit(False)))
        | ((c("p1w") == ",") & in_tables)
        | ((c("p1w") == "(") & (c("g_kind") == "table"))
        | ((c("p1w") == "USING") & c("scope").isNull())
    )
    not_called = F.coalesce(c("n1w") != "(", F.lit(True)) | c("p1w").isin("INTO", "TABLE", "VIEW")
    table = name & c("own") & table_position & not_called & (c("ld") == 0)
    cte = (c("w") == "(") & (c("p1w") == "AS") & (c("clause") == "WITH") & c("own")
    derived = (
        (c("w") == ")")
        & c("own")
        & (c("m_before_w").isin("FROM", "JOIN") | ((c("m_before_w") == ",") & in_tables))
        & (c("m_kind").isin("query", "table") | (c("m_after_w") == "("))
        & (c("m_after_w") != "VALUES")
    )
    literal_prefix = (c("w") == "name") & (c("n1w") == "str") & F.upper("tok").isin(*LITERAL_PREFIXES)
    skipped = (
        c("not_column")
        | literal_prefix
        | (c("p2w") == "INTERVAL")
        | c("p1w").isin("::", "OVER", "COLLATE", "WINDOW")
        | (c("n1w") == "=>")
        | c("clause").isin("LIMIT", "WITH", "NONE")
    )
    column = (
        name
        & ~c("is_alias")
        & F.coalesce(c("n1w") != "(", F.lit(True))
        & (c("ld") == 0)
        & ~F.coalesce(skipped, F.lit(False))
    )
    role = (
        F.when(table, "table")
        .when(cte, "cte")
        .when(derived, F.when(c("follows").isNotNull(), "derived"))
        .when(name & (c("g_kind") == "using"), "using")
        .when(column, "column")
    )
    own_calc = F.when(
        c("n1w") == "::",
        F.struct(c("pos").alias("open"), F.lit("CAST").alias("type"), c("seg_lo").alias("lo"), c("seg_hi").alias("hi")),
    ).when(
        c("seg_arith") | c("seg_cast"),
        F.struct(
            c("seg_lo").alias("open"),
            F.when(c("seg_arith"), "ARITHMETIC").otherwise("CAST").alias("type"),
            c("seg_lo").alias("lo"),
            c("seg_hi").alias("hi"),
        ),
    )
    places = F.filter(
        F.array(
            F.when(c("clause").isin("WHERE", "JOIN", "GROUP BY", "HAVING", "ORDER BY"), c("clause")),
            F.when(c("ordered"), "ORDER BY"),
            F.when((c("g_kind") == "filter") & (c("clause") != "WHERE"), "WHERE"),
        ),
        lambda p: p.isNotNull(),
    )
    parts = name_parts(c("tok"))
    tokens = tokens.withColumn("role", role)
    settled = F.struct(
        "tok",
        "w",
        "role",
        "own",
        "qid",
        "scope",
        "alias_scope",
        "clause",
        "item",
        "join_type",
        "is_alias",
        "delimiter",
        "arithmetic",
        (c("bracket.kind") == "query").alias("opens_query"),
        c("bracket.type").alias("bracket_type"),
        F.when(c("m_kind").isin(*CALC_BRACKETS), c("m_open")).alias("closes_calc"),
        F.coalesce(literal_prefix, F.lit(False)).alias("typed_literal"),
        "n1w",
        "sd",
        F.when(c("role").isin("table", "column", "using"), parts).alias("parts"),
        F.when(c("is_alias"), plain_name(c("tok"))).alias("alias_name"),
        F.when(c("role").isin("table", "derived"), plain_name(c("follows")))
        .when(c("role") == "cte", plain_name(F.coalesce("cte_name", "listed_name")))
        .alias("alias"),
        # The query bracket that is the body of a CTE or derived table, if it is one.
        F.when((c("role") == "cte") & (c("bracket.kind") == "query"), c("pos"))
        .when((c("role") == "derived") & (c("m_kind") == "query"), c("m_open"))
        .alias("body"),
        F.when(c("role") == "column", own_calc).alias("own_calc"),
        F.when(c("role") == "column", places).alias("places"),
    )
    _, _, upto = running("pos", "cd")
    around = F.when(c("cd") > 0, F.last("calc_entered", ignorenulls=True).over(upto)).alias("around")
    tokens = tokens.select("stmt", "pos", settled.alias("r"), around)
    calc = F.when(c("r.role") == "column", F.coalesce("r.own_calc", "around"))
    calculated = F.when((calc.open > c("r.qid")) & calc.isNotNull(), F.array(F.lit("calculation"))).otherwise(F.array().cast("array<string>"))
    return tokens.select(
        "stmt", "pos", "r.*", calc.alias("calc"), F.concat("r.places", calculated).alias("all_places")
    ).drop("own_calc", "places").withColumnRenamed("all_places", "places")


def lexemes(readable: DataFrame) -> DataFrame:
    """The tokens that later stages read, each with its role and position.

    ``readable`` holds ``stmt``, ``dialect`` and ``tokens`` and is partitioned by ``stmt``.
    """
    tokens = explode_tokens(readable)
    for step in (settle_soft_words, with_neighbours, with_brackets, with_levels, with_scopes, with_roles):
        tokens = step(tokens)
    c = F.col
    return tokens.where(
        c("role").isNotNull()
        | (c("own") & (c("clause") == "SELECT"))
        | c("opens_query")
        | c("closes_calc").isNotNull()
        | (c("own") & (c("w") == "SETOP"))
    )
