"""Compare a query with its SQL on the supplied tables, without regard to order."""

from __future__ import annotations

import os

import duckdb
import pytest

FOLDER = os.environ.get("STEMMA_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the supplied tables are not here")


def plain(value):
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def agree(spark, run, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted(tuple(plain(row[k]) for k in order) for row in found.fetchall())
    df = run(spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(plain(row[names[k]]) for k in order) for row in df.collect()) == want
