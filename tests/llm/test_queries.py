"""Registered queries of the subpackage against their SQL, on the smallest given tables."""

import duckdb
import pandas as pd
import pytest

from clademark.llm import queries

DIR = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    text = lambda v: "" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name]).df()
    got = queries.queries()[name](spark, DIR).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
