import pytest

import __spark_entry__ as entry
from check_oracles import compare

SF = "/root/testdata/sf0.001"
CORE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CORE)
def test_query(spark, name):
    assert compare(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name]) == ""
