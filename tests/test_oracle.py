"""Every registered query against its SQL oracle on DuckDB at sf0.01 (the correctness gate)."""

import math

import duckdb
import pandas as pd
import pytest

from trellis.plans import registry
from trellis.session import apply_conf
from trellis.sources.tables import TABLES

from conftest import SF01

QUERIES = registry.all_queries()
ORACLE = registry.all_oracles()


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v == int(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    if hasattr(v, "item"):
        return v.item()
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con


#: Queries that SQL cannot express; other tests hold them against brute force.
NO_SQL = {"bpe_tokens"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) - NO_SQL == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    apply_conf(spark)
    got = QUERIES[name](spark, SF01).toPandas()
    want = duck.execute(ORACLE[name]).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr
