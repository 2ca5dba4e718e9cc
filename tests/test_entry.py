import os

import duckdb
import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings campaigns outlets contributors imports articles incoming_articles import_rows syndication_lines eval_items review_labels").split()


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = contract.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    relation = duck.sql(contract.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    expected = sorted((tuple(plain(r[relation.columns.index(c)]) for c in columns) for r in relation.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == expected


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_other_queries_run(spark, name):
    contract.queries()[name](spark, DATA).write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert contract.entry(spark).count() > 0
