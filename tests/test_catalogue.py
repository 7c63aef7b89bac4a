import re

import duckdb
import pytest

import __spark_entry__ as driver
import check

SF = "/root/testdata/sf0.001"
SLOW = {"logit_side_by_side", "silhouette_by_k", "elbow_by_k", "kmeans4_profile", "forest_cv", "forest_importance", "forest_predictions"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_contract(spark):
    names = driver.queries()
    assert set(driver.oracle_sql()) <= set(names)
    df = driver.entry(spark)
    assert df.columns == ["Income_Group_5", "mean"] and df.count() == 5


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    df = driver.queries()[name](spark, SF)
    rel = con.execute(driver.oracle_sql()[name])
    columns, want = check.rows_of([c[0] for c in rel.description], rel.fetchall())
    mine, got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert mine == columns
    assert sorted(got, key=check.key) == sorted(want, key=check.key)


OWN_TESTS = re.compile(r"op\d+_|pipeline$")  # queries with tests of their own


@pytest.mark.parametrize("name", sorted(n for n in set(driver.queries()) - set(driver.oracle_sql()) - SLOW if not OWN_TESTS.match(n)))
def test_model_query_gives_rows(spark, name):
    assert driver.queries()[name](spark, SF).count() > 0
