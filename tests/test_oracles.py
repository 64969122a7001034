"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare_oracles import connect, differences

from tidemark.plans import registry

registry.load_all()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_sql(spark, tiny, name):
    problem, rows = differences(spark, connect(tiny), tiny, name)
    assert problem in ("", "rows only")
    assert rows >= 0


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
