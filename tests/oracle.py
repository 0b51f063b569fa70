"""Running a registered query and its checking SQL side by side."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _sorted_rows(rows):
    return sorted(([_plain(v) for v in row] for row in rows), key=repr)


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def compare(spark, con, entry, sf_dir) -> tuple[int, list[str]]:
    """Row count and the differences found (types, row count, values)."""
    frame = entry.run(spark, sf_dir)
    names = sorted(frame.columns)
    ours = _sorted_rows([tuple(r[n] for n in names) for r in frame.collect()])
    if entry.sql is None:
        return len(ours), []
    result = con.execute(entry.sql)
    theirs_names = [d[0] for d in result.description]
    if sorted(theirs_names) != names:
        return len(ours), [f"columns {names} against {sorted(theirs_names)}"]
    place = [theirs_names.index(n) for n in names]
    theirs = _sorted_rows([tuple(row[i] for i in place) for row in result.fetchall()])
    problems = []
    types = dict(frame.dtypes)
    for n, i in zip(names, place):
        wanted, found = _KINDS.get(types[n]), str(result.description[i][1])
        if wanted and wanted != found:
            problems.append(f"type of {n}: {types[n]} against {found}")
    if len(ours) != len(theirs):
        problems.append(f"{len(ours)} rows against {len(theirs)}")
    for a, b in zip(ours, theirs):
        if a != b:
            problems.append(f"ours {dict(zip(names, a))}\n   theirs {dict(zip(names, b))}")
            break
    return len(ours), problems
