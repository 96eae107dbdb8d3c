"""URL filter lists by a sort-merge range join, in DataFrame functions only.

A host becomes a canonical key: its labels in reverse, each followed by the same low character.
All hosts under a rule's host then form one interval of keys. Rule intervals give a start and an
end event each; events and urls are sorted together in ranges of the key, and a sweep carries the
stack of rules whose intervals are open. As intervals nest, the stack after an event is known from
the rules alone: the rules of that host and of the hosts above it. Each range first gets the last
event before its own first row (one row a range, so a bounded table), then the urls take the last
event seen. Of the open rules, those whose path is a prefix of the url's path fit.

Urls are moved as slim rows (id and key parts) and ties are spread by an id, so a host that owns a
third of all urls is split over many ranges.

Defined cases: a null url or one without ``://`` has an empty host and path. A url that no rule
fits gets the default verdict. Among fitting rules the longest wins: more of the host, then more of
the path. Host and path are taken as written: a port belongs to the host, and a path may be empty.
Repeated urls and repeated rows are judged each. An empty table gives an empty table. Of two equal
rules, ``allow`` wins. A null rule host is ignored; a null rule path is the empty path.
Very long urls are keys like others. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: (host, path, verdict) of the registered query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_STACK = "array<struct<host_len:int,path_len:int,allow:int,rule:string,path:string,verdict:string>>"


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each ended by U+0001; literal U+0001 and U+0002 are escaped."""
    plain = F.replace(F.replace(host, F.lit("\u0002"), F.lit("\u0002b")), F.lit("\u0001"), F.lit("\u0002a"))
    return F.concat(F.array_join(F.reverse(F.split(plain, r"\.", -1)), "\u0001"), F.lit("\u0001"))


def interval_events(rules: DataFrame) -> DataFrame:
    """Start and end of each rule host's interval, with the stack of rules open from there on."""
    own = rules.where(F.col("host").isNotNull()).select(
        ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    rule = F.struct(
        F.length("host").alias("host_len"),
        F.length("path").alias("path_len"),
        (F.col("verdict") == "allow").cast("int").alias("allow"),
        F.concat("host", "path").alias("rule"),
        "path",
        "verdict",
    )
    own = own.select(host_key(F.col("host")).alias("key"), rule.alias("rule"))
    # every ancestor of a key, itself included: its prefixes that end in U+0001
    labels = F.split(F.col("key"), "\u0001", -1)
    keys = own.select("key").distinct().withColumn("labels", labels).withColumn("depth", F.size("labels") - 1)
    above = keys.select(
        "key", "depth", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("d"), "labels"
    ).select("key", "depth", "d", F.concat(F.array_join(F.slice("labels", F.lit(1), F.col("d")), "\u0001"), F.lit("\u0001")).alias("up"))
    open_rules = above.join(own.withColumnRenamed("key", "up"), "up")
    stacks = open_rules.groupBy("key").agg(
        F.sort_array(F.collect_set("rule"), asc=False).alias("stack"),
        F.sort_array(F.coalesce(F.collect_set(F.when(F.col("d") < F.col("depth"), F.col("rule"))), F.array()), asc=False).alias("outer"),
    )
    # the end of an interval: the key with its last character raised; ends come before starts of the same place
    end = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("\u0002"))
    starts = stacks.select("key", F.length("key").alias("__order"), F.col("stack").cast(_STACK).alias("__stack"))
    ends = stacks.select(end.alias("key"), (-F.length("key")).alias("__order"), F.col("outer").cast(_STACK).alias("__stack"))
    return starts.unionByName(ends)


def judge(urls: DataFrame, rules: DataFrame, id_column: str = "page_id", default: str = "allow", parts: int | None = None) -> DataFrame:
    """Per url its host, path, the rule that won (null if none) and the verdict."""
    parts = parts or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = urls.select(F.col(id_column).alias("__id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host"))).withColumn("__event", F.lit(False))
    events = interval_events(rules).withColumn("__event", F.lit(True))
    both = rows.withColumn("__order", F.lit(1 << 30)).unionByName(events, allowMissingColumns=True)
    # a place in the order: key, then ends before starts before urls, then the id, which splits hot hosts
    ranged = both.repartitionByRange(parts, "key", "__order", F.xxhash64("__id", "path")).withColumn("__range", F.spark_partition_id())
    before = W.partitionBy("__range").orderBy("key", "__order").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = ranged.select(
        "__id", "host", "path", "key", "__order", "__event", "__range", F.last("__stack", ignorenulls=True).over(before).alias("__open")
    )
    # stored, as the ranges must be the same ones in both uses below
    swept = stored(swept, "url-sweep")
    place = F.when(F.col("__event"), F.struct("key", "__order"))
    last = swept.groupBy("__range").agg(F.max_by("__open", place).alias("__last"))
    carried = last.select(
        "__range",
        F.last("__last", ignorenulls=True).over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)).alias("__carried"),
    )
    # one row for each range, so bounded by the number of partitions
    found = swept.where(~F.col("__event")).join(F.broadcast(carried), "__range", "left")
    stack = F.coalesce("__open", "__carried")
    best = F.get(F.filter(stack, lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    return found.withColumn("__best", best).select(
        F.col("__id").alias(id_column),
        "host",
        "path",
        F.col("__best.rule").alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
    )


def oracle(rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> str:
    """DuckDB SQL: every rule against every url, the longest fitting one wins."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""WITH rules(rh, rp, v) AS (VALUES {values}),
u AS (SELECT row_number() OVER () AS r, page_id,
  translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
m AS (SELECT r, max((length(rh), length(rp), v = 'allow', rh || rp, v)) AS best FROM u JOIN rules
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, best[4] AS rule, coalesce(best[5], '{default}') AS verdict FROM u LEFT JOIN m USING (r)"""


ORACLE = oracle()
