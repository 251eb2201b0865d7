"""Every registered query of the engine against its SQL."""

import os

import duckdb
import pandas as pd
import pytest

from clademark.plans import registry as catalog

DIR = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return list(tuple(None if pd.isna(v) else round(float(v), 5) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v) for v in r) for r in df.itertuples(index=False, name=None))


def norm(x):
    return sorted((tuple("null" if v is None else f"={v}" for v in r) for r in x))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    if name not in catalog.ORACLE:  # checked by its steps
        assert len(got)
        return
    want = duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # whole numbers compare as such
        for df in (got, want):
            if df[c].dtype.kind in "iuf":
                df[c] = df[c].astype(float)
    assert len(got) == len(want)
    assert norm(rows(got)) == norm(rows(want))
