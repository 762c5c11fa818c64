"""Compares a query with its SQL in DuckDB, as sorted rows."""

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def duck(sql, sf_dir=SF, **tables):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    for name, frame in tables.items():
        con.register("tmp_" + name, frame)
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM tmp_{name}")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=repr)


def same(df, sql, sf_dir=SF, **tables):
    names, want = duck(sql, sf_dir, **tables)
    assert sorted(df.columns) == names
    got = rows(df)
    plain = lambda rs: [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rs]
    assert plain(got) == plain(want), (got[:3], want[:3], len(got), len(want))
