"""Every query against its SQL, over the smallest folder."""

import pytest

from lexmill import plans
from oracle import compare

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert compare(spark, DIR, plans.QUERIES[name], plans.ORACLE_SQL[name]) > 0


def test_each_query_has_sql():
    # near_dups: see test_near_dups
    assert set(plans.QUERIES) - set(plans.ORACLE_SQL) == {"near_dups"}
