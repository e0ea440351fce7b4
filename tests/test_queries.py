"""Every query of the library against SQL in DuckDB, on the small tables."""

import duckdb
import pytest

from siltstone.plans import scenarios  # noqa: F401 (registers the commands' queries)
from siltstone.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split() + "embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple("" if v is None or v != v else str(v) for v in row) for row in frame.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLE_SQL:
        assert canonical(found) == canonical(duck.sql(ORACLE_SQL[name]).df())
    else:
        assert len(found)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cat_json_gives_every_row(spark):
    rows = QUERIES["cat_json"](spark, FOLDER)
    assert rows.count() == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
