"""Queries of the subpackage against their SQL, or that they give rows."""

import oracle
import pytest

from mundspark.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    if name in catalogue.SQL:
        oracle.compare(spark, name)
    else:
        import __spark_entry__ as entry

        assert entry.queries()[name](spark, oracle.SF).count() > 0
