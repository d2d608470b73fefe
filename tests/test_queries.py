"""Every query of the reference's operators against its SQL."""

import pytest

import __spark_entry__
from against_sql import DATA, differences
from tidemark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert differences(spark, name, registry.QUERIES[name], registry.ORACLE_SQL[name]) is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["event_id", "user_id", "c_name", "run_id", "value"]


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and DATA
