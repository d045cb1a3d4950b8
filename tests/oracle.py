"""Compare a Spark query with its SQL on DuckDB: names, types, rows and values."""

from __future__ import annotations

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
         "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return names, [str(d[1]) for d in result.description], result.fetchall()


def differences(df, con, sql) -> list[str]:
    names, types, expected = duck_rows(con, sql)
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} <> {sorted(names)}"]
    ours = dict(df.dtypes)
    for name, kind in zip(names, types):
        if TYPES.get(kind, kind) != ours[name]:
            found.append(f"type of {name}: {ours[name]} <> {kind}")
    order = sorted(names)
    place = {n: i for i, n in enumerate(names)}
    want = sorted((tuple(r[place[n]] for n in order) for r in expected), key=repr)
    have = sorted((tuple(r[n] for n in order) for r in df.collect()), key=repr)
    if len(want) != len(have):
        found.append(f"rows {len(have)} <> {len(want)}")
    bad = [(h, w) for h, w in zip(have, want) if h != w]
    if bad:
        found.append(f"{len(bad)} rows differ, first: {order} spark={bad[0][0]} sql={bad[0][1]}"[:1500])
    return found
