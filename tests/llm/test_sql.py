"""Training-data queries against SQL in DuckDB, on the small tables."""

import duckdb
import pytest

from siltstone.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found, wanted = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    names = sorted(found.columns)
    assert names == sorted(wanted.columns)
    rows = [sorted(tuple(map(str, r)) for r in f[names].astype(object).values.tolist()) for f in (found, wanted)]
    assert rows[0] == rows[1]
