"""Every registered query with SQL gives the same columns, types and rows."""

import pytest
from compare import FOLDER, database, difference

from starloom.suite import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    assert difference(spark, con, FOLDER, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", ["gbt_importance", "l1_filter", "pca", "stage_reuse"])
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
