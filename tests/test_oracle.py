"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from daytrace.plans import catalog
from helpers import same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    same(catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs_without_sql(spark, sf, name):
    rows = catalog.QUERIES[name](spark, sf).collect()
    assert rows and len({tuple(r.asDict()) for r in rows}) == 1
