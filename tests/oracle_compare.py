"""Comparison of a Spark result with DuckDB on the same tables: names, number of rows and values in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.5f}".replace("-0.00000", "0.00000")
    return str(value)


def differences(df, con, sql):
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = sorted(names)
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in relation.fetchall())
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    if len(ours) != len(theirs):
        return [f"{len(ours)} and {len(theirs)} rows"]
    return [f"{a} and {b}" for a, b in zip(ours, theirs) if a != b][:3]
