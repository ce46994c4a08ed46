"""Every query of the catalogue against its SQL twin."""

import duckdb
import pytest

from quillspark.plans import catalogue

TABLES = "documents embeddings pages benchmark labels conversations events".split()


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
        df[c] = df[c].astype(object).where(df[c].notna(), None).map(lambda x: float(x) if hasattr(x, "__float__") and not isinstance(x, (str, bool)) else str(x))
    return df.sort_values(list(df.columns), key=lambda s: s.map(str)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf)
    if name not in catalogue.ORACLE_SQL:
        assert got.count() > 0
        return
    want = con.execute(catalogue.ORACLE_SQL[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for c in a.columns:
        wrong = [(x, y) for x, y in zip(a[c], b[c]) if x != y]
        assert not wrong, (c, len(wrong), wrong[:3])
