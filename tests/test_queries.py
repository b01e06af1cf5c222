"""Every query against its SQL on the smallest tables."""

import pytest

from tests.compare import differences
from veinstone.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert differences(frame, ORACLES[name], SF) == ""
    else:
        assert frame.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
