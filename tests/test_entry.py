import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from pitchside.plans import standin_queries as sq

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, int):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if math.isinf(v) else round(v, 9) + 0.0
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["own_position", "own_name", "own_team"]
    assert df.count() >= 0


def test_every_query_has_an_oracle():
    assert set(sq.QUERIES) == set(sq.ORACLE)
    assert set(sq.QUERIES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(sq.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = duck.execute(E.oracle_sql()[name]).df()
    assert _rows(got) == _rows(want)
