import math

import duckdb

TABLES = "documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def equal_to_sql(df, sql, con):
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    want = canonical(columns, result.fetchall())
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got == want
    return len(want)
