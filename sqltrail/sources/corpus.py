"""A statement log derived from the ``events`` table: one statement per event.

``event_id`` picks a template; user or type of the event give the table suffix. So the log has as
many queries as there are events, its distinct texts grow with its users, and some texts are hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATES = (
    "SELECT z.kind, COUNT(*) AS seen, SUM(w.kg) / 1000 AS tons FROM wagons_{g} w CROSS JOIN zones_{g} z "
    "WHERE w.kg BETWEEN z.low AND z.high GROUP BY z.kind ORDER BY tons DESC, z.kind",
    "SELECT t.lot FROM tanks_{g} t WHERE NOT EXISTS (SELECT 1 FROM leaks_{g} k WHERE k.lot = t.lot AND k.litres > 5) ORDER BY t.lot",
    "SELECT SUBSTR(n.title, 1, 3) stub, q.votes FROM novels_{g} n NATURAL JOIN quotes_{g} q "
    "LEFT JOIN critics_{g} USING (critic_id, year) WHERE q.votes IS NOT NULL",
    "WITH ripe AS (SELECT h.plot, AVG(h.brix) sugar FROM harvest_{g} h WHERE h.brix > 18 GROUP BY h.plot) "
    "SELECT plots.owner, r.sugar FROM plots RIGHT OUTER JOIN ripe r ON plots.id = r.plot WHERE r.sugar <> 0",
    "SELECT d.pier, late.ships FROM docks_{g} d INNER JOIN (SELECT a.dock_no, COUNT(DISTINCT a.ship) AS ships FROM arrivals_{g} a "
    "WHERE a.delay > 2 GROUP BY a.dock_no) late ON late.dock_no = d.dock_no",
    "SELECT code FROM ports INTERSECT SELECT old_code FROM closed_ports WHERE closed_on < DATE '2020-01-01'",
    "SELECT v.plate, t.fee FROM vans_{g} v, tolls_{g} t, roads_{g} WHERE t.plate(+) = v.plate AND t.day (+) > 3 ORDER BY t.fee NULLS LAST",
    "SELECT DISTINCT * -- all of them\nFROM logs_{g} /* day\nby day */ WHERE sev >= 3",
    "SELECT j.id, CONVERT(datetime, made) made_at FROM jobs_{g} j WHERE j.due < to_date('05.06.2021','DD.MM.YYYY')",
    "SELECT [a b], 'x[1]' FROM [s].[t_{g}]",
    "SELECT h.name FROM staff_{g} h WHERE h.pay > (SELECT AVG(s.pay) FROM staff_{g} s WHERE s.unit = 7)",
    "   ",
    "SELECT 1 WHERE x_{g} = 1",
    "DELETE FROM t_{g}",
    "SELECT d.region, ROW_NUMBER() OVER (PARTITION BY d.region ORDER BY d.total) AS rn, "
    "d.total * 2 + d.fee AS gross FROM deals_{g} d",
    "WITH a AS (SELECT t.k, t.v FROM src_{g} t), b AS (SELECT a.k AS kk, SUM(a.v) AS s FROM a GROUP BY a.k) "
    "SELECT b.kk, q.s FROM b, b q WHERE b.s > 10",
    "SELECT o.id, CASE WHEN o.qty > 5 THEN 'big' ELSE 'small' END size_class, "
    "(SELECT MAX(p.price) FROM prices_{g} p WHERE p.item = o.item) AS top_price, NVL(o.note, '-') AS note "
    "FROM sales.orders_{g} o CROSS JOIN dual WHERE o.status IN ('A', 'B') "
    "UNION ALL SELECT x.id, x.c1, x.c2, x.c3 FROM arch_{g} x ORDER BY size_class",
    "INSERT INTO mart.t_{g} (a, b) SELECT SUM(z.v), z.n || z.m "
    "FROM (SELECT v, n, m FROM l_{g} UNION SELECT v, n, m FROM r_{g}) z",
    "SELECT e.day::date AS d, EXTRACT(YEAR FROM e.ts) yr, COUNT(*) AS n FROM ev_{g} e "
    "LEFT JOIN us_{g} u USING (uid, org) GROUP BY e.day, yr HAVING COUNT(*) > @low(f(1), 2) ORDER BY n DESC LIMIT 10",
    "SELECT o2.x AS xx FROM (SELECT i.x FROM (SELECT c.x FROM core_{g} c) i) o2 "
    "RIGHT JOIN dim_{g} d ON d.k = (SELECT MIN(m.k) FROM map_{g} m)",
    "SELECT a.x FROM one_{g} a; DELETE FROM two_{g} WHERE y = 1;\nSELECT b.z FROM three_{g} b",
    "SELECT SUM(p.won) FILTER (WHERE p.team = 4) AS wins FROM games_{g} p",
    "SELECT m.ore m.grade pit FROM mines_{g} m",
    "SELECT c.hue FROM paints_{g} c GROUP BY c.hue WHERE c.gloss = 2",
    "SELECT k.id FROM kites_{g} k winds",
)
DIALECT_NAMES = {9: "SQLSERVER", 18: "POSTGRESQL"}


def suffix() -> Column:
    """``{g}`` of an event: a third of the events share one of few, the others have their user's own.

    So distinct texts grow with the users of the log, and some texts are hot.
    """
    own = F.coalesce("user_id", F.lit(0)).cast("string")
    return F.when(F.pmod("event_id", F.lit(3)) == 0, F.coalesce("event_type", F.lit("none"))).otherwise(own)


def log_table(events: DataFrame) -> DataFrame:
    """``(query_id, sql, dialect)`` with dialect names as a user would write them."""
    n = len(TEMPLATES)
    template = F.pmod("event_id", F.lit(n)).cast("int")
    bodies = F.array(*[F.lit(body) for body in TEMPLATES])
    names = F.array(*[F.lit(DIALECT_NAMES.get(i)) for i in range(n)])
    return events.select(
        F.col("event_id").alias("query_id"),
        F.replace(F.get(bodies, template), F.lit("{g}"), suffix()).alias("sql"),
        F.get(names, template).alias("dialect"),
    )
