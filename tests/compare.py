"""Run a query and its SQL twin and compare them as bags of rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

from hushlake.plans.registry import QUERIES, TWINS


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


def difference(spark, con, name: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    ours = QUERIES[name](spark, sf_dir)
    found = _bag(ours.columns, ours.collect())
    cursor = con.execute(TWINS[name])
    columns = [c[0] for c in cursor.description]
    wanted = _bag(columns, cursor.fetchall())
    if sorted(columns) != sorted(ours.columns):
        return f"columns {sorted(ours.columns)} / {sorted(columns)}"
    if found == wanted:
        return "" if found else "no rows"
    more, less = found - wanted, wanted - found
    return (
        f"{sum(found.values())} / {sum(wanted.values())} rows; ours only {sum(more.values())}: "
        f"{list(more)[:2]}; SQL only {sum(less.values())}: {list(less)[:2]}"
    )
