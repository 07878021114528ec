"""Rows of a query and of its SQL, in comparable form."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    plain = lambda x: "~" if pd.isna(x) else round(float(x), 6) if isinstance(x, float) else str(x)
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark, query, sql) -> None:
    got, want = query(spark, SF).toPandas(), connection().execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
