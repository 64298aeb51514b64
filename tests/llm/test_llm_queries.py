"""The queries with SQL against it, over whole tables."""

import pytest
from compare import connect, difference

from hitloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == ""
