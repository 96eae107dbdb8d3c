"""Facts of the corpus templates, written down by hand from what each statement says.

Nothing here is produced by the engine. ``{g}`` is the table suffix of a query. Lists are
given in sorted order, joined with a comma and a blank.
"""

from __future__ import annotations

TABLE, SUBQUERY, CTE = "Таблица", "Подзапрос", "CTE"

# template, order found, schema, name, type, aliases, join type, columns
TABLES = [
    (0, 1, None, "wagons_{g}", TABLE, "w", None, "wagons_{g}.kg"),
    (0, 2, None, "zones_{g}", TABLE, "z", "CROSS JOIN", "zones_{g}.high, zones_{g}.kind, zones_{g}.low"),
    (1, 1, None, "tanks_{g}", TABLE, "t", None, "tanks_{g}.lot"),
    (1, 2, None, "leaks_{g}", TABLE, "k", None, "leaks_{g}.litres, leaks_{g}.lot"),
    (2, 1, None, "novels_{g}", TABLE, "n", None, "novels_{g}.critic_id, novels_{g}.title, novels_{g}.year"),
    (2, 2, None, "quotes_{g}", TABLE, "q", "INNER JOIN", "quotes_{g}.critic_id, quotes_{g}.votes, quotes_{g}.year"),
    (2, 3, None, "critics_{g}", TABLE, "", "LEFT JOIN", "critics_{g}.critic_id, critics_{g}.year"),
    (3, 1, None, "ripe", CTE, "r, ripe", "RIGHT OUTER JOIN", "ripe.plot, ripe.sugar"),
    (3, 2, None, "harvest_{g}", TABLE, "h", None, "harvest_{g}.brix, harvest_{g}.plot"),
    (3, 3, None, "plots", TABLE, "", None, "plots.id, plots.owner"),
    (4, 1, None, "docks_{g}", TABLE, "d", None, "docks_{g}.dock_no, docks_{g}.pier"),
    (4, 2, None, "arrivals_{g}", TABLE, "a", "INNER JOIN", "arrivals_{g}.delay, arrivals_{g}.dock_no, arrivals_{g}.ship"),
    (4, 3, None, "late", SUBQUERY, "late", None, "late.dock_no, late.ships"),
    (5, 1, None, "ports", TABLE, "", None, "ports.code"),
    (5, 2, None, "closed_ports", TABLE, "", None, "closed_ports.closed_on, closed_ports.old_code"),
    (6, 1, None, "vans_{g}", TABLE, "v", None, "vans_{g}.plate"),
    (6, 2, None, "tolls_{g}", TABLE, "t", "LEFT JOIN", "tolls_{g}.day, tolls_{g}.fee, tolls_{g}.plate"),
    (6, 3, None, "roads_{g}", TABLE, "", "INNER JOIN", ""),
    (7, 1, None, "logs_{g}", TABLE, "", None, "logs_{g}.*, logs_{g}.sev"),
    (8, 1, None, "jobs_{g}", TABLE, "j", None, "jobs_{g}.due, jobs_{g}.id, jobs_{g}.made"),
    (9, 1, "s", "t_{g}", TABLE, "", None, "t_{g}.a b"),
    (10, 1, None, "staff_{g}", TABLE, "h, s", None, "staff_{g}.name, staff_{g}.pay, staff_{g}.unit"),
    (13, 1, None, "t_{g}", TABLE, "", None, ""),
    (14, 1, None, "deals_{g}", TABLE, "d", None, "deals_{g}.fee, deals_{g}.region, deals_{g}.total"),
    (15, 1, None, "a", CTE, "a", None, "a.k, a.v"),
    (15, 2, None, "b", CTE, "b, q", "INNER JOIN", "b.kk, b.s"),
    (15, 3, None, "src_{g}", TABLE, "t", None, "src_{g}.k, src_{g}.v"),
    (16, 1, None, "prices_{g}", TABLE, "p", None, "prices_{g}.item, prices_{g}.price"),
    (16, 2, "sales", "orders_{g}", TABLE, "o", None, "orders_{g}.id, orders_{g}.note, orders_{g}.qty, orders_{g}.status"),
    (16, 3, None, "dual", TABLE, "", "CROSS JOIN", ""),
    (16, 4, None, "arch_{g}", TABLE, "x", None, "arch_{g}.c1, arch_{g}.c2, arch_{g}.c3, arch_{g}.id"),
    (17, 1, "mart", "t_{g}", TABLE, "", None, ""),
    (17, 2, None, "l_{g}", TABLE, "", None, "l_{g}.m, l_{g}.n, l_{g}.v"),
    (17, 3, None, "r_{g}", TABLE, "", None, "r_{g}.m, r_{g}.n, r_{g}.v"),
    (17, 4, None, "z", SUBQUERY, "z", None, "z.m, z.n, z.v"),
    (18, 1, None, "ev_{g}", TABLE, "e", None, "ev_{g}.day, ev_{g}.org, ev_{g}.ts, ev_{g}.uid"),
    (18, 2, None, "us_{g}", TABLE, "u", "LEFT JOIN", "us_{g}.org, us_{g}.uid"),
    (19, 1, None, "core_{g}", TABLE, "c", None, "core_{g}.x"),
    (19, 2, None, "dim_{g}", TABLE, "d", "RIGHT JOIN", "dim_{g}.k"),
    (19, 3, None, "map_{g}", TABLE, "m", "RIGHT JOIN", "map_{g}.k"),
    (19, 4, None, "i", SUBQUERY, "i", None, "i.x"),
    (19, 5, None, "o2", SUBQUERY, "o2", None, "o2.x"),
    (20, 1, None, "one_{g}", TABLE, "a", None, "one_{g}.x"),
    (21, 1, None, "games_{g}", TABLE, "p", None, "games_{g}.team, games_{g}.won"),
]

# template, schema, name, alias, type, join type as written, join type after outer marks
REFERENCES = [
    (0, None, "wagons_{g}", "w", TABLE, None, None),
    (0, None, "zones_{g}", "z", TABLE, "CROSS JOIN", "CROSS JOIN"),
    (1, None, "tanks_{g}", "t", TABLE, None, None),
    (1, None, "leaks_{g}", "k", TABLE, None, None),
    (2, None, "novels_{g}", "n", TABLE, None, None),
    (2, None, "quotes_{g}", "q", TABLE, "INNER JOIN", "INNER JOIN"),
    (2, None, "critics_{g}", None, TABLE, "LEFT JOIN", "LEFT JOIN"),
    (3, None, "harvest_{g}", "h", TABLE, None, None),
    (3, None, "plots", None, TABLE, None, None),
    (3, None, "ripe", "r", CTE, "RIGHT OUTER JOIN", "RIGHT OUTER JOIN"),
    (4, None, "docks_{g}", "d", TABLE, None, None),
    (4, None, "arrivals_{g}", "a", TABLE, "INNER JOIN", "INNER JOIN"),
    (5, None, "ports", None, TABLE, None, None),
    (5, None, "closed_ports", None, TABLE, None, None),
    (6, None, "vans_{g}", "v", TABLE, None, None),
    (6, None, "tolls_{g}", "t", TABLE, "INNER JOIN", "LEFT JOIN"),
    (6, None, "roads_{g}", None, TABLE, "INNER JOIN", "INNER JOIN"),
    (7, None, "logs_{g}", None, TABLE, None, None),
    (8, None, "jobs_{g}", "j", TABLE, None, None),
    (9, "s", "t_{g}", None, TABLE, None, None),
    (10, None, "staff_{g}", "h", TABLE, None, None),
    (10, None, "staff_{g}", "s", TABLE, None, None),
    (13, None, "t_{g}", None, TABLE, None, None),
    (14, None, "deals_{g}", "d", TABLE, None, None),
    (15, None, "src_{g}", "t", TABLE, None, None),
    (15, None, "a", None, CTE, None, None),
    (15, None, "b", None, CTE, None, None),
    (15, None, "b", "q", CTE, "INNER JOIN", "INNER JOIN"),
    (16, None, "prices_{g}", "p", TABLE, None, None),
    (16, "sales", "orders_{g}", "o", TABLE, None, None),
    (16, None, "dual", None, TABLE, "CROSS JOIN", "CROSS JOIN"),
    (16, None, "arch_{g}", "x", TABLE, None, None),
    (17, "mart", "t_{g}", None, TABLE, None, None),
    (17, None, "l_{g}", None, TABLE, None, None),
    (17, None, "r_{g}", None, TABLE, None, None),
    (18, None, "ev_{g}", "e", TABLE, None, None),
    (18, None, "us_{g}", "u", TABLE, "LEFT JOIN", "LEFT JOIN"),
    (19, None, "core_{g}", "c", TABLE, None, None),
    (19, None, "dim_{g}", "d", TABLE, "RIGHT JOIN", "RIGHT JOIN"),
    (19, None, "map_{g}", "m", TABLE, "RIGHT JOIN", "RIGHT JOIN"),
    (20, None, "one_{g}", "a", TABLE, None, None),
    (21, None, "games_{g}", "p", TABLE, None, None),
]

# template, alias, table, number of SELECTs whose FROM or JOINs reach it
SCOPE_TABLES = [
    (0, "w", "wagons_{g}", 1),
    (0, "z", "zones_{g}", 1),
    (1, "t", "tanks_{g}", 1),
    (1, "k", "leaks_{g}", 1),
    (2, "n", "novels_{g}", 1),
    (2, "q", "quotes_{g}", 1),
    (2, None, "critics_{g}", 1),
    (3, "h", "harvest_{g}", 1),
    (3, None, "plots", 1),
    (3, "r", "ripe", 1),
    (4, "d", "docks_{g}", 1),
    (4, "a", "arrivals_{g}", 2),
    (5, None, "ports", 1),
    (5, None, "closed_ports", 1),
    (6, "v", "vans_{g}", 1),
    (6, "t", "tolls_{g}", 1),
    (6, None, "roads_{g}", 1),
    (7, None, "logs_{g}", 1),
    (8, "j", "jobs_{g}", 1),
    (9, None, "t_{g}", 1),
    (10, "h", "staff_{g}", 1),
    (10, "s", "staff_{g}", 1),
    (14, "d", "deals_{g}", 1),
    (15, "t", "src_{g}", 1),
    (15, None, "a", 1),
    (15, None, "b", 1),
    (15, "q", "b", 1),
    (16, "p", "prices_{g}", 1),
    (16, "o", "orders_{g}", 1),
    (16, None, "dual", 1),
    (16, "x", "arch_{g}", 1),
    (17, None, "l_{g}", 2),
    (17, None, "r_{g}", 2),
    (18, "e", "ev_{g}", 1),
    (18, "u", "us_{g}", 1),
    (19, "c", "core_{g}", 3),
    (19, "d", "dim_{g}", 1),
    (19, "m", "map_{g}", 2),
    (20, "a", "one_{g}", 1),
    (21, "p", "games_{g}", 1),
]

# template, qualifier, column as written, owner and column it means, times, by select alias
MENTIONS = [
    (0, "z", "kind", "zones_{g}", "kind", 3, False),
    (0, "w", "kg", "wagons_{g}", "kg", 2, False),
    (0, "z", "low", "zones_{g}", "low", 1, False),
    (0, "z", "high", "zones_{g}", "high", 1, False),
    (0, None, "tons", "CALC", "tons", 1, True),
    (1, "t", "lot", "tanks_{g}", "lot", 2, False),
    (1, "t", "lot", "t", "lot", 1, False),
    (1, "k", "lot", "leaks_{g}", "lot", 1, False),
    (1, "k", "litres", "leaks_{g}", "litres", 1, False),
    (2, "n", "title", "novels_{g}", "title", 1, False),
    (2, "q", "votes", "quotes_{g}", "votes", 2, False),
    (3, "h", "plot", "harvest_{g}", "plot", 2, False),
    (3, "h", "brix", "harvest_{g}", "brix", 2, False),
    (3, "plots", "owner", "plots", "owner", 1, False),
    (3, "plots", "id", "plots", "id", 1, False),
    (3, "r", "sugar", "ripe", "sugar", 2, False),
    (3, "r", "plot", "ripe", "plot", 1, False),
    (4, "d", "pier", "docks_{g}", "pier", 1, False),
    (4, "d", "dock_no", "docks_{g}", "dock_no", 1, False),
    (4, "late", "ships", "arrivals_{g}", "ship", 1, False),
    (4, "late", "dock_no", "arrivals_{g}", "dock_no", 1, False),
    (4, "a", "dock_no", "arrivals_{g}", "dock_no", 2, False),
    (4, "a", "ship", "arrivals_{g}", "ship", 1, False),
    (4, "a", "delay", "arrivals_{g}", "delay", 1, False),
    (5, None, "code", "ports", "code", 1, False),
    (5, None, "old_code", "closed_ports", "old_code", 1, False),
    (5, None, "closed_on", "closed_ports", "closed_on", 1, False),
    (6, "v", "plate", "vans_{g}", "plate", 2, False),
    (6, "t", "fee", "tolls_{g}", "fee", 2, False),
    (6, "t", "plate", "tolls_{g}", "plate", 1, False),
    (6, "t", "day", "tolls_{g}", "day", 1, False),
    (7, None, "*", "logs_{g}", "*", 1, False),
    (7, None, "sev", "logs_{g}", "sev", 1, False),
    (8, "j", "id", "jobs_{g}", "id", 1, False),
    (8, None, "made", "jobs_{g}", "made", 1, False),
    (8, "j", "due", "jobs_{g}", "due", 1, False),
    (9, None, "a b", "t_{g}", "a b", 1, False),
    (10, "h", "name", "staff_{g}", "name", 1, False),
    (10, "h", "pay", "staff_{g}", "pay", 1, False),
    (10, "s", "pay", "staff_{g}", "pay", 1, False),
    (10, "s", "unit", "staff_{g}", "unit", 1, False),
    (12, None, "x_{g}", "UNKNOWN", "x_{g}", 1, False),
    (14, "d", "region", "deals_{g}", "region", 2, False),
    (14, "d", "total", "deals_{g}", "total", 2, False),
    (14, "d", "fee", "deals_{g}", "fee", 1, False),
    (15, "t", "k", "src_{g}", "k", 1, False),
    (15, "t", "v", "src_{g}", "v", 1, False),
    (15, "a", "k", "src_{g}", "k", 2, False),
    (15, "a", "v", "src_{g}", "v", 1, False),
    (15, "b", "kk", "src_{g}", "k", 1, False),
    (15, "q", "s", "b", "s", 1, False),
    (15, "b", "s", "src_{g}", "v", 1, False),
    (16, "o", "id", "orders_{g}", "id", 1, False),
    (16, "o", "qty", "orders_{g}", "qty", 1, False),
    (16, "p", "price", "prices_{g}", "price", 1, False),
    (16, "p", "item", "prices_{g}", "item", 1, False),
    (16, "o", "item", "o", "item", 1, False),
    (16, "o", "note", "orders_{g}", "note", 1, False),
    (16, "o", "status", "orders_{g}", "status", 1, False),
    (16, "x", "id", "arch_{g}", "id", 1, False),
    (16, "x", "c1", "arch_{g}", "c1", 1, False),
    (16, "x", "c2", "arch_{g}", "c2", 1, False),
    (16, "x", "c3", "arch_{g}", "c3", 1, False),
    (16, None, "size_class", "CALC", "size_class", 1, True),
    (17, "z", "v", "z", "v", 1, False),
    (17, "z", "n", "z", "n", 1, False),
    (17, "z", "m", "z", "m", 1, False),
    (17, None, "v", "l_{g}", "v", 1, False),
    (17, None, "n", "l_{g}", "n", 1, False),
    (17, None, "m", "l_{g}", "m", 1, False),
    (17, None, "v", "r_{g}", "v", 1, False),
    (17, None, "n", "r_{g}", "n", 1, False),
    (17, None, "m", "r_{g}", "m", 1, False),
    (18, "e", "day", "ev_{g}", "day", 2, False),
    (18, "e", "ts", "ev_{g}", "ts", 1, False),
    (18, None, "yr", "CALC", "yr", 1, True),
    (18, None, "n", "CALC", "n", 1, True),
    (19, "o2", "x", "i", "x", 1, False),
    (19, "i", "x", "core_{g}", "x", 1, False),
    (19, "c", "x", "core_{g}", "x", 1, False),
    (19, "d", "k", "dim_{g}", "k", 1, False),
    (19, "m", "k", "map_{g}", "k", 1, False),
    (20, "a", "x", "one_{g}", "x", 1, False),
    (21, "p", "won", "games_{g}", "won", 1, False),
    (21, "p", "team", "games_{g}", "team", 1, False),
]

# template, relation, output, source table, source column
PROJECTIONS = [
    (3, "ripe", "plot", "harvest_{g}", "plot"),
    (3, "ripe", "sugar", "harvest_{g}", "brix"),
    (4, "late", "dock_no", "arrivals_{g}", "dock_no"),
    (4, "late", "ships", "arrivals_{g}", "ship"),
    (15, "a", "k", "src_{g}", "k"),
    (15, "a", "v", "src_{g}", "v"),
    (15, "b", "kk", "src_{g}", "k"),
    (15, "b", "s", "src_{g}", "v"),
    (19, "i", "x", "core_{g}", "x"),
    (19, "o2", "x", "i", "x"),
]

# template, table, column per USING name and table of the SELECT
USING = [
    (2, "novels_{g}", "critic_id"),
    (2, "quotes_{g}", "critic_id"),
    (2, "critics_{g}", "critic_id"),
    (2, "novels_{g}", "year"),
    (2, "quotes_{g}", "year"),
    (2, "critics_{g}", "year"),
    (18, "ev_{g}", "uid"),
    (18, "us_{g}", "uid"),
    (18, "ev_{g}", "org"),
    (18, "us_{g}", "org"),
]

GROSS = "d.total * 2 + d.fee"
RANKED = "ROW_NUMBER() OVER (PARTITION BY d.region ORDER BY d.total)"
SIZED = "CASE WHEN o.qty > 5 THEN 'big' ELSE 'small' END"

# template, owner, column, table alias, aliases, select aliases, usage, count,
# calculation type, calculation expression, dependencies
COLUMNS = [
    (0, "zones_{g}", "kind", "z", "z.kind", "", "GROUP BY, ORDER BY, SELECT", 3, None, None, ""),
    (0, "zones_{g}", "low", "z", "z.low", "", "WHERE", 1, None, None, ""),
    (0, "zones_{g}", "high", "z", "z.high", "", "WHERE", 1, None, None, ""),
    (0, "wagons_{g}", "kg", "w", "w.kg", "", "SELECT, WHERE, calculation", 2, "SUM", "SUM(w.kg)", ""),
    (0, "CALC", "seen", None, "seen", "", "SELECT", 1, "COUNT", "COUNT(*)", ""),
    (0, "CALC", "tons", None, "tons", "", "ORDER BY, SELECT", 2, "ARITHMETIC", "SUM(w.kg) / 1000", "wagons_{g}.kg"),
    (1, "tanks_{g}", "lot", "t", "t.lot", "", "ORDER BY, SELECT", 2, None, None, ""),
    (1, "t", "lot", "t", "t.lot", "", "WHERE", 1, None, None, ""),
    (1, "leaks_{g}", "lot", "k", "k.lot", "", "WHERE", 1, None, None, ""),
    (1, "leaks_{g}", "litres", "k", "k.litres", "", "WHERE", 1, None, None, ""),
    (2, "novels_{g}", "title", "n", "n.title", "", "SELECT, calculation", 1, "SUBSTRING", "SUBSTR(n.title, 1, 3)", ""),
    (2, "CALC", "stub", None, "stub", "", "SELECT", 1, "SUBSTRING", "SUBSTR(n.title, 1, 3)", "novels_{g}.title"),
    (2, "quotes_{g}", "votes", "q", "q.votes", "", "SELECT, WHERE", 2, None, None, ""),
    (2, "novels_{g}", "critic_id", None, "", "", "JOIN", 1, None, None, ""),
    (2, "quotes_{g}", "critic_id", None, "", "", "JOIN", 1, None, None, ""),
    (2, "critics_{g}", "critic_id", None, "", "", "JOIN", 1, None, None, ""),
    (2, "novels_{g}", "year", None, "", "", "JOIN", 1, None, None, ""),
    (2, "quotes_{g}", "year", None, "", "", "JOIN", 1, None, None, ""),
    (2, "critics_{g}", "year", None, "", "", "JOIN", 1, None, None, ""),
    (3, "ripe", "plot", "r", "r.plot, ripe.plot", "", "JOIN, SELECT", 2, None, None, "harvest_{g}.plot"),
    (3, "ripe", "sugar", "r", "r.sugar, ripe.sugar", "", "SELECT, WHERE", 3, "AVG", "AVG(h.brix)", "harvest_{g}.brix"),
    (3, "harvest_{g}", "plot", "h", "h.plot, ripe.plot", "", "GROUP BY, SELECT", 2, None, None, ""),
    (3, "harvest_{g}", "brix", "h", "h.brix, ripe.sugar", "", "SELECT, WHERE, calculation", 2, "AVG", "AVG(h.brix)", ""),
    (3, "CALC", "sugar", None, "sugar", "", "SELECT", 1, "AVG", "AVG(h.brix)", "harvest_{g}.brix"),
    (3, "plots", "owner", "plots", "plots.owner", "", "SELECT", 1, None, None, ""),
    (3, "plots", "id", "plots", "plots.id", "", "JOIN", 1, None, None, ""),
    (4, "docks_{g}", "pier", "d", "d.pier", "", "SELECT", 1, None, None, ""),
    (4, "docks_{g}", "dock_no", "d", "d.dock_no", "", "JOIN", 1, None, None, ""),
    (4, "arrivals_{g}", "dock_no", "a", "a.dock_no, late.dock_no", "", "GROUP BY, JOIN, SELECT", 3, None, None, ""),
    (4, "arrivals_{g}", "ship", "late", "a.ship, late.ship, late.ships", "", "SELECT, calculation", 2, "COUNT", "COUNT(DISTINCT a.ship)", ""),
    (4, "arrivals_{g}", "delay", "a", "a.delay", "", "WHERE", 1, None, None, ""),
    (4, "late", "dock_no", "late", "late.dock_no", "", "SELECT", 1, None, None, "arrivals_{g}.dock_no"),
    (4, "late", "ships", "late", "late.ships", "", "SELECT", 1, "COUNT", "COUNT(DISTINCT a.ship)", "arrivals_{g}.ship"),
    (4, "CALC", "ships", None, "ships", "", "SELECT", 1, "COUNT", "COUNT(DISTINCT a.ship)", "arrivals_{g}.ship"),
    (5, "ports", "code", None, "", "", "SELECT", 1, None, None, ""),
    (5, "closed_ports", "old_code", None, "", "", "SELECT", 1, None, None, ""),
    (5, "closed_ports", "closed_on", None, "", "", "WHERE", 1, None, None, ""),
    (6, "vans_{g}", "plate", "v", "v.plate", "", "SELECT, WHERE", 2, None, None, ""),
    (6, "tolls_{g}", "fee", "t", "t.fee", "", "ORDER BY, SELECT", 2, None, None, ""),
    (6, "tolls_{g}", "plate", "t", "t.plate", "", "WHERE", 1, None, None, ""),
    (6, "tolls_{g}", "day", "t", "t.day", "", "WHERE", 1, None, None, ""),
    (7, "logs_{g}", "*", None, "", "", "SELECT", 1, None, None, ""),
    (7, "logs_{g}", "sev", None, "", "", "WHERE", 1, None, None, ""),
    (8, "jobs_{g}", "id", "j", "j.id", "", "SELECT", 1, None, None, ""),
    (8, "jobs_{g}", "made", None, "", "", "SELECT, calculation", 1, "CAST", "CAST(made AS DATETIME)", ""),
    (8, "jobs_{g}", "due", "j", "j.due", "", "WHERE", 1, None, None, ""),
    (8, "CALC", "made_at", None, "made_at", "", "SELECT", 1, "CAST", "CAST(made AS DATETIME)", "jobs_{g}.made"),
    (9, "t_{g}", "a b", None, "", "", "SELECT", 1, None, None, ""),
    (10, "staff_{g}", "name", "h", "h.name", "", "SELECT", 1, None, None, ""),
    (10, "staff_{g}", "pay", "h", "h.pay, s.pay", "", "WHERE, calculation", 2, "AVG", "AVG(s.pay)", ""),
    (10, "staff_{g}", "unit", "s", "s.unit", "", "WHERE", 1, None, None, ""),
    (12, "UNKNOWN", "x_{g}", None, "", "", "WHERE", 1, None, None, ""),
    (14, "deals_{g}", "region", "d", "d.region", "", "SELECT, calculation", 2, "WINDOW", RANKED, ""),
    (14, "deals_{g}", "total", "d", "d.total", "", "ORDER BY, SELECT, calculation", 2, "ARITHMETIC", GROSS, ""),
    (14, "deals_{g}", "fee", "d", "d.fee", "", "SELECT, calculation", 1, "ARITHMETIC", GROSS, ""),
    (14, "CALC", "rn", None, "rn", "", "SELECT", 1, "WINDOW", RANKED, "deals_{g}.region, deals_{g}.total"),
    (14, "CALC", "gross", None, "gross", "", "SELECT", 1, "ARITHMETIC", GROSS, "deals_{g}.fee, deals_{g}.total"),
    (15, "src_{g}", "k", "t", "a.k, b.k, b.kk, kk, t.k", "kk", "GROUP BY, SELECT", 4, None, None, ""),
    (15, "src_{g}", "v", "t", "a.v, b.s, b.v, t.v", "", "SELECT, WHERE, calculation", 3, "SUM", "SUM(a.v)", ""),
    (15, "a", "k", "a", "a.k", "", "GROUP BY, SELECT", 3, None, None, "src_{g}.k"),
    (15, "a", "v", "a", "a.v", "", "SELECT, calculation", 2, None, None, "src_{g}.v"),
    (15, "b", "kk", "b", "b.kk", "", "SELECT", 2, None, None, "src_{g}.k"),
    (15, "b", "s", "q", "b.s, q.s", "", "SELECT, WHERE", 3, "SUM", "SUM(a.v)", "src_{g}.v"),
    (15, "CALC", "s", None, "s", "", "SELECT", 1, "SUM", "SUM(a.v)", "src_{g}.v"),
    (16, "orders_{g}", "id", "o", "o.id", "", "SELECT", 1, None, None, ""),
    (16, "orders_{g}", "qty", "o", "o.qty", "", "SELECT, calculation", 1, "CASE", SIZED, ""),
    (16, "orders_{g}", "note", "o", "o.note", "", "SELECT, calculation", 1, "COALESCE", "NVL(o.note, '-')", ""),
    (16, "orders_{g}", "status", "o", "o.status", "", "WHERE", 1, None, None, ""),
    (16, "prices_{g}", "price", "p", "p.price, top_price", "top_price", "calculation", 1, "MAX", "MAX(p.price)", ""),
    (16, "prices_{g}", "item", "p", "p.item, top_price", "top_price", "WHERE", 1, None, None, ""),
    (16, "o", "item", "o", "o.item, top_price", "top_price", "WHERE", 1, None, None, ""),
    (16, "arch_{g}", "id", "x", "x.id", "", "SELECT", 1, None, None, ""),
    (16, "arch_{g}", "c1", "x", "x.c1", "", "SELECT", 1, None, None, ""),
    (16, "arch_{g}", "c2", "x", "x.c2", "", "SELECT", 1, None, None, ""),
    (16, "arch_{g}", "c3", "x", "x.c3", "", "SELECT", 1, None, None, ""),
    (16, "CALC", "size_class", None, "size_class", "", "ORDER BY, SELECT", 2, "CASE", SIZED, "orders_{g}.qty"),
    (16, "CALC", "note", None, "note", "", "SELECT", 1, "COALESCE", "NVL(o.note, '-')", "orders_{g}.note"),
    (17, "z", "v", "z", "z.v", "", "calculation", 1, "SUM", "SUM(z.v)", ""),
    (17, "z", "n", "z", "z.n", "", "UNKNOWN", 1, None, None, ""),
    (17, "z", "m", "z", "z.m", "", "UNKNOWN", 1, None, None, ""),
    (17, "l_{g}", "v", None, "", "", "SELECT", 1, None, None, ""),
    (17, "l_{g}", "n", None, "", "", "SELECT", 1, None, None, ""),
    (17, "l_{g}", "m", None, "", "", "SELECT", 1, None, None, ""),
    (17, "r_{g}", "v", None, "", "", "SELECT", 1, None, None, ""),
    (17, "r_{g}", "n", None, "", "", "SELECT", 1, None, None, ""),
    (17, "r_{g}", "m", None, "", "", "SELECT", 1, None, None, ""),
    (18, "ev_{g}", "day", "e", "e.day", "", "GROUP BY, SELECT, calculation", 2, "CAST", "e.day::DATE", ""),
    (18, "ev_{g}", "ts", "e", "e.ts", "", "SELECT, calculation", 1, "EXTRACT", "EXTRACT(YEAR FROM e.ts)", ""),
    (18, "ev_{g}", "uid", None, "", "", "JOIN", 1, None, None, ""),
    (18, "ev_{g}", "org", None, "", "", "JOIN", 1, None, None, ""),
    (18, "us_{g}", "uid", None, "", "", "JOIN", 1, None, None, ""),
    (18, "us_{g}", "org", None, "", "", "JOIN", 1, None, None, ""),
    (18, "CALC", "d", None, "d", "", "SELECT", 1, "CAST", "e.day::DATE", "ev_{g}.day"),
    (18, "CALC", "yr", None, "yr", "", "GROUP BY, SELECT", 2, "EXTRACT", "EXTRACT(YEAR FROM e.ts)", "ev_{g}.ts"),
    (18, "CALC", "n", None, "n", "", "ORDER BY, SELECT", 2, "COUNT", "COUNT(*)", ""),
    (19, "core_{g}", "x", "i", "c.x, i.x", "", "SELECT", 2, None, None, ""),
    (19, "i", "x", "i", "o2.x, xx", "xx", "SELECT", 2, None, None, "core_{g}.x"),
    (19, "o2", "x", "o2", "o2.x", "", "SELECT", 1, None, None, "i.x"),
    (19, "dim_{g}", "k", "d", "d.k", "", "JOIN", 1, None, None, ""),
    (19, "map_{g}", "k", "m", "m.k", "", "calculation", 1, "MIN", "MIN(m.k)", ""),
    (20, "one_{g}", "x", "a", "a.x", "", "SELECT", 1, None, None, ""),
    (21, "games_{g}", "won", "p", "p.won, wins", "wins", "SELECT, calculation", 1, "SUM", "SUM(p.won)", ""),
    (21, "games_{g}", "team", "p", "p.team, wins", "wins", "SELECT, WHERE", 1, None, None, ""),
]
