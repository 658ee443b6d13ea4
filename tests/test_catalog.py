"""Every query with SQL gives the rows that another engine gives; the others give rows."""

import oracle
import pytest

from tideway import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, sf_dir):
    if name in SQL:
        assert oracle.compare(spark, con, sf_dir, QUERIES[name], SQL[name]) == ""
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_names_are_unique():
    with pytest.raises(ValueError):
        catalog.register("recommend", lambda spark, d: None)
