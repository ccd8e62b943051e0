"""Every query of the report and terrain catalogue against its SQL, or at least runs."""

import pytest
from oracle import compare

from orestrata.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, name):
    q = catalog.queries()[name]
    if name in SQL:
        assert compare(spark, q, SQL[name], sf_dir) == ""
    else:
        assert q(spark, sf_dir).count() > 0
