"""Every registered query of the library's own operators, against its SQL, on the smallest tables."""

import pytest
from oracle import duck, same

from concordia import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, con, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in plans.ORACLES:
        assert same(got, con.sql(plans.ORACLES[name]).df()) == ""
