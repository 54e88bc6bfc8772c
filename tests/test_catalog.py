"""The driver's queries against their SQL."""

import os

import pytest
from oracle import against_sql

from arborql import catalog

SF = "/root/testdata/sf0.001"
#: One of each family; the driver runs all of them.
SOME = ["json_pair_capture", "where_any_group", "where_count_le", "rel_inside_capture", "rel_not_directly_follows", "seq_variadic", "branch_where", "query_match", "html_inside_nav", "xml_attribute", "css_id_selector", "suppress_lines", "path_glob", "fix_apply", "rule_tests"]


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    got, want = against_sql(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF)
    spark.catalog.clearCache()
    assert got == want


def test_entry_needs_no_session_to_be_read():
    import subprocess
    import sys
    from pathlib import Path

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 80)"], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    assert out.stdout.strip().endswith("True"), out.stderr[-500:]
