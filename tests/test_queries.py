import pytest

import __spark_entry__
from codewhiff import queries
from compare import both


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["rule", "severity", "findings", "files"] and out.count() == 35  # every rule has findings in the corpus


def test_every_query_has_sql():
    assert queries.queries().keys() == queries.oracle_sql().keys()
    assert queries.queries().keys() <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("name", ["findings_all", "findings_pages", "rule_no_god_function", "severity_override", "ignore_globs", "diff_parse", "diff_scan", "diff_reroot", "changed_files_only", "size_nul_filter", "findings_sorted", "findings_by_file", "pretty_total", "json_rows", "rule_catalogue"])
def test_against_sql(spark, name):
    got, want = both(spark, queries.queries()[name], queries.oracle_sql()[name])
    assert got == want
