"""Compares registered queries with their SQL on the small tables."""

import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf: str = SF):
    con = duckdb.connect()
    for name in os.listdir(sf):
        table, path = name.removesuffix(".parquet"), f"{sf}/{name}"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    plain = lambda x: None if not hasattr(x, "__len__") and pd.isna(x) else float(x) if isinstance(x, float) else x
    ordered = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(plain(x) for x in r)) for r in ordered.itertuples(index=False))


def same(spark, name: str, queries: dict, oracles: dict, sf: str = SF) -> None:
    found = queries[name](spark, sf).toPandas()
    wanted = connection(sf).sql(oracles[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
