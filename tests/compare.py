"""Compares every registered query with its oracle, by sorted values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(row[i] for i in order) for row in rows], key=repr)


def difference(df, sf_dir: str, sql: str) -> str | None:
    """None when equal, else a short account of the first differences."""
    got_names, got = normal(df.columns, [tuple(r) for r in df.collect()])
    names, rows = normal(*expected_rows(sf_dir, sql))
    if got_names != names:
        return f"columns {got_names} / {names}"
    if got == rows:
        return None
    extra, missing = set(got) - set(rows), set(rows) - set(got)
    return f"rows {len(got)}/{len(rows)} got {sorted(extra, key=repr)[:3]} expected {sorted(missing, key=repr)[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parent.parent))
    import __spark_entry__ as entry
    from bench import session

    spark = session(8)
    sf_dir = sys.argv[1]
    oracles = entry.oracle_sql()
    for name, build in entry.engine_queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        start = time.time()
        try:
            outcome = difference(build(spark, sf_dir), sf_dir, oracles[name])
        except Exception as error:
            outcome = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name} {time.time() - start:.2f}s {'OK' if outcome is None else 'DIFF ' + outcome}", flush=True)
