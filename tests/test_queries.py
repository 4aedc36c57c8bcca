"""Every registered query against its SQL on the smallest tables."""

import pytest

from factloom.plans.catalog import QUERIES, SQL

from .compare import duck, plain


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    want = duck(sf_dir).sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)
