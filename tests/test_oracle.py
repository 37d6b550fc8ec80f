"""Each query against its SQL on the smallest tables."""

import duckdb
import pytest

from clauseloom.plans.oracle import ORACLES
from clauseloom.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf_dir, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = [sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False))) for d in (ours, theirs)]
    assert rows[0] == rows[1] and rows[0]


def test_json_leaves_out_absent_parents(spark, sf_dir):
    rows = QUERIES["segments_json"](spark, sf_dir).collect()
    assert any('"parent_clause"' in r.json for r in rows)
    assert all(r.output_name.endswith("_output.json") and '"parent_clause":null' not in r.json for r in rows)
