"""Spark against DuckDB on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def value(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return (0 if x is None else 1, str(x))
    if isinstance(x, (int, float)) or hasattr(x, "as_tuple"):
        x = float(x)
        return (1, "nan" if math.isnan(x) else f"{x:.9g}")
    return (1, str(x))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in data)


def differences(df, con, sql):
    """None, or what differs."""
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} against {sorted(want_cols)}"
    a, b = rows(got_cols, got), rows(want_cols, want)
    if a == b:
        return None
    only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} rows against {len(b)}; only here {only[0]}; only there {only[1]}"
