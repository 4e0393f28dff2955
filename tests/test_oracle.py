"""Every query with SQL gives the SQL's rows."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from siftwright.jobs.queries import ORACLE, QUERIES

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def rows(frame):
    cell = lambda x: None if pd.isna(x) is True else round(float(x), 6) + 0.0 if isinstance(x, float) else str(x)
    return sorted((tuple(map(str, map(cell, r))) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    ours, theirs = QUERIES[name](spark, str(SF)).toPandas(), con.execute(ORACLE[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    for c in ours.columns:
        if pd.api.types.is_float_dtype(ours[c]) or pd.api.types.is_float_dtype(theirs[c]):
            ours[c], theirs[c] = ours[c].astype(float), theirs[c].astype(float)
    assert rows(ours) == rows(theirs)
