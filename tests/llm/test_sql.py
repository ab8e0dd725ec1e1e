"""Every operator with SQL gives the same columns, types and rows."""

import pytest
from compare import FOLDER, database, difference

from starloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert difference(spark, database(FOLDER), FOLDER, QUERIES[name], ORACLES[name]) is None


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
