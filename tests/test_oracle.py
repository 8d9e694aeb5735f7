"""Every query with SQL gives the SQL's rows; the others run and give rows."""

import pytest

import compare
from lodemark.registry import all_queries, all_sql

#: Minutes each; their operators are tested on small data in test_models.py, test_estimators.py and test_boosting.py.
SLOW = {"m12_m14_m27_ladder", "v02_ladder_frame", "m21_boosted_trees", "m16_l1_errors"}


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_same_rows_as_sql(spark, sf, con, name):
    assert compare.differences(all_queries()[name](spark, sf), con, all_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql()) - SLOW))
def test_runs(spark, sf, name):
    rows = all_queries()[name](spark, sf).collect()
    assert rows and any(v is not None for v in rows[0])
