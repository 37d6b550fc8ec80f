"""Queries of the training-data operators against their SQL."""

import duckdb
import pandas as pd
import pytest

from clauseloom.llm import queries
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("folder", ["sf0.001"])
def test_same_rows(spark, name, folder):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from '{DATA}/{folder}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, f"{DATA}/{folder}").toPandas(), duck.sql(queries.ORACLES[name]).df()
    columns = sorted(ours.columns)
    whole = [c for c in columns if not ours[c].hasnans]  # integers with nulls have a type of their own in each library
    assert columns == sorted(theirs.columns) and dict(ours.dtypes[whole]) == dict(theirs.dtypes[whole])
    plain = lambda c, v: None if pd.isna(v) else int(v) if c not in whole and not isinstance(v, str) else v
    rows = [sorted((tuple(map(plain, columns, r)) for r in d[columns].itertuples(index=False)), key=str) for d in (ours, theirs)]
    assert rows[0] == rows[1] and rows[0]
