"""Run registered queries beside their DuckDB SQL, as the driver does."""

import math

import duckdb

from trawl.session import TABLES

SF = "/root/testdata/sf0.001"


def duck(sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    if hasattr(v, "item"):
        return canon(v.item())
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in data)


def check(spark, name, f, sql, sf_dir=SF):
    df = f(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    got = duck(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    theirs = rows(names, got.fetchall())
    assert sorted(df.columns) == sorted(names), (name, sorted(df.columns), sorted(names))
    assert len(mine) == len(theirs), (name, len(mine), len(theirs))
    diff = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not diff, (name, len(diff), diff[:3])
