"""A query and its SQL over the same tables."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def rounded(x):
    return round(x, 9) if isinstance(x, float) else x


def both(spark, query, sql, sf=SF):
    """Sorted rows of the query and of its SQL, with columns by name."""
    df = query(spark, sf)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for name in os.listdir(sf):
        at = f"{sf}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf}/{name}") else "")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{at}')")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    assert sorted(names) == cols
    want = [tuple(rounded(r[names.index(c)]) for c in cols) for r in done.fetchall()]
    got = [tuple(rounded(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    return sorted(map(repr, got)), sorted(map(repr, want))
