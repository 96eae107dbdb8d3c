"""P10: tokens that cannot stand beside each other, told by their classes.

Each token becomes one letter of its class, and the letters of a statement one short text in
which the forbidden neighbours are looked up. This is no grammar: a pattern names a few tokens in a
row, and only such as no dialect allows. Words that stand beside operands in some dialect have no
class (``x``) and are never judged, so an unknown statement rather passes than fails.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqltrail.operators.tokens import BARE_FUNCTIONS, CONSTANTS, RESERVED

# The class of each keyword and sign. Other reserved words and signs are not judged.
CLASSES = {
    "S": ("SELECT",),
    "D": ("DISTINCT", "ALL"),
    "F": ("FROM",),
    "K": ("ON",),
    "W": ("WHERE",),
    "G": ("GROUP BY",),
    "Y": ("HAVING",),
    "B": ("ORDER BY",),
    "L": ("AND", "OR"),
    "T": ("NOT",),
    "I": ("IN", "LIKE", "ILIKE", "RLIKE", "BETWEEN"),
    "A": ("AS",),
    "C": ("CASE",),
    "H": ("WHEN",),
    "M": ("THEN",),
    "E": ("ELSE",),
    "Z": ("END",),
    "Q": ("ASC", "DESC", "NULLS FIRST", "NULLS LAST"),
    "P": ("+", "-", "*", "/", "%", "||"),
    "=": ("=", "==", "<>", "!=", "<=", ">=", "<=>", "^="),
}
# Words that stand beside operands or tables in one dialect or another and are no alias.
UNJUDGED = (
    "ALLOW ANTI ARRAY ASOF AT BEFORE BINARY CHANGES CHARACTER CONNECT_BY_ROOT CONTAINS CROSS CURRENT DAY DAYS DISTINCTROW EQ EQUALS "
    "EXCEPT EXCLUDE FINAL FIRST FORCE FORMAT FULL GE GLOB GO GT HIGH_PRIORITY HOUR HOURS IGNORE INNER INTERSECT ISNULL LAST LE LEFT LT "
    "MATCH MATCH_RECOGNIZE MEMBER MICROSECOND MILLISECOND MINUS MINUTE MINUTES MODEL MONTH MONTHS NATURAL NE NEXT NOLOCK NOTNULL OF ONLY "
    "OPERATOR OPTION OUTER OVERLAPS PARTITION PASTE PERCENT PRECEDES PREWHERE QUARTER RENAME REPLACE RESPECT RIGHT SAMPLE SECOND SECONDS "
    "SEMI SETTINGS SIMILAR SKIP SOUNDS SQL_BIG_RESULT SQL_BUFFER_RESULT SQL_CACHE SQL_CALC_FOUND_ROWS SQL_NO_CACHE SQL_SMALL_RESULT "
    "STRAIGHT_JOIN STRUCT SUBMULTISET SUCCEEDS TIES TO TOP UNION UNIQUE UNNEST USE VALUE VERSION VERSIONS WEEK WEEKS WITHIN XOR YEAR YEARS ZONE"
).split()
# Type names that hold their arguments between < and >, which then compare nothing.
TYPED_ARGUMENTS = r"(?i)\b(?:ARRAY|STRUCT|MAP|ROW|TABLE|RANGE|MULTISET) ?<"

# Operands without a clause of their own, over brackets that hold no more than operands.
OPERANDS = r"(?:[nvdPQL=<,]|\([nvdP,]*+\))*+"
# Forbidden neighbours by class: n is a name, d a number, v another value, J a join, < also >, x is not judged.
FORBIDDEN = (
    r"[S,],",  # nothing before a comma
    r",W",
    r"(?<!A)[WGYBFJ](?=[WGYBFJKL,);]|\z)",  # a clause without content
    r"J(?:n|\([^()]*+\))*+K(?=[WGYBFJKL,);]|\z)",
    r"[WGYB](?:[=<]|I(?!\())",  # nothing before an operator
    r"[=<](?=[WGYBFL,);]|\z)",  # nothing after one
    r"=[=<]",
    r"[IL](?=[WGYBFJL,);=]|\z)",
    r"T(?=[WGYBFJL,);]|\z)",
    r"CZ|H[HM]|M[MHEZ]|EZ",  # an empty branch
    r"A(?=[,);]|\z)",  # AS without a name
    r"[SD]nnn(?=[F,;]|\z)|,nnn(?=F)",  # SELECT a b c
    r"Snd(?=[F,;])",
    r"(?:J|F(?:nn?+,)*+)nnn(?=[WGYBJK=,);]|\z)",  # FROM t u v
    r"Wn[nvd](?=[WGYBL=<;]|\z)",  # WHERE a b
    r"W[nvd][=<][nvd]n(?=[WGYBL;]|\z)",
    r"dd",
    r"[GYB]" + OPERANDS + "[FW]",  # clauses out of order
    r"W" + OPERANDS + "F",
    r"B" + OPERANDS + "[GY]",
)


def token_class(token: Column, typed_arguments: Column) -> Column:
    """One letter for a token."""
    first, upper = F.substring(token, 1, 1), F.upper(token)
    known = F.when(upper.isin(*UNJUDGED), "x")
    for letter, words in CLASSES.items():
        known = known.when(upper.isin(*words), letter)
    return (
        known.when(token.isin(",", "(", ")", ";"), token)
        .when(token.isin("<", ">"), F.when(typed_arguments, "x").otherwise("<"))
        .when(token.endswith("'") & (F.length(token) > 1), "v")
        .when(first.between("0", "9"), "d")
        .when(upper.isin(*CONSTANTS, *BARE_FUNCTIONS), "v")
        .when(upper.isin(*RESERVED), "x")
        .when(upper.endswith("JOIN") & (upper.contains(" ") | (upper == "JOIN")), "J")
        .when(first == '"', "x")  # a literal, a name, or a subscript that cleaning has requoted
        .when(token.contains("[") | ((first != "`") & token.contains(" ") & ~token.contains(".")), "x")
        .when(first.rlike(r"(?U)[\p{L}_#`]"), "n")
        .otherwise("x")
    )


def class_text(tokens: Column) -> Column:
    """The classes of a statement's tokens, a letter each."""
    typed = F.exists(tokens, lambda t: t == "<") & F.array_join(tokens, " ").rlike(TYPED_ARGUMENTS)
    return F.array_join(F.transform(tokens, lambda t: token_class(t, typed)), "")


def misplaced(tokens: Column) -> Column:
    """Whether tokens stand beside each other that cannot; null without tokens."""
    return class_text(tokens).rlike("|".join(FORBIDDEN))
