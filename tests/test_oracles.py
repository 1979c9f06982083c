"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb
import pytest

from barloom.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(v) + 0.0)
    if isinstance(v, Decimal):
        return f"d{v}"
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, duck, name):
    frame = QUERIES[name](spark, sf_dir)
    names = sorted(frame.columns)
    result = duck.execute(ORACLES[name])
    got = [c[0] for c in result.description]
    assert sorted(got) == names
    order = [got.index(c) for c in names]
    theirs = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    ours = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    assert ours == theirs


def test_all_registered():
    assert set(ORACLES) <= set(QUERIES)
