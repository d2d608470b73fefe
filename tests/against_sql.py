"""Comparison of queries with SQL run by DuckDB."""

import math
from collections import Counter
from pathlib import Path

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value that compares alike from either engine: doubles to 9 significant digits, times without a zone, lists as tuples."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, name, query, sql, sf_dir=DATA):
    """None if the query's rows are those of the SQL; else a text that says what differs."""
    import duckdb

    con = duckdb.connect(config={"threads": 8})
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_cols, want = bag(names, cur.fetchall())
    df = query(spark, sf_dir)
    got_cols, got = bag(df.columns, [tuple(r) for r in df.collect()])
    if want_cols != got_cols:
        return f"{name}: columns {got_cols}, SQL has {want_cols}"
    if want != got:
        return f"{name}: {sum(got.values())} rows, SQL has {sum(want.values())}; only here {list((got - want).items())[:3]}, only SQL {list((want - got).items())[:3]}"
    return None
