"""Every query with SQL gives the same rows in both engines; the others run."""

import pytest
from helpers import DATA, same_rows

from loomwork.queries import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, str(DATA)), duck, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    assert df.count() > 0
    if "recall_at_k" in df.columns:
        row = df.first()
        assert 0 <= row.recall_at_k <= 1 and row.recall_at_1 >= 0.9
