import pytest

import __spark_entry__
from codewhiff.llm import queries
from compare import both


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 11))
    assert queries.queries().keys() <= __spark_entry__.queries().keys() and queries.oracle_sql().items() <= __spark_entry__.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    got, want = both(spark, queries.queries()[name], queries.oracle_sql()[name])
    assert got == want and (got or name == "op6_license_scan")
