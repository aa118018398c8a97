import importlib.util

import pytest

import __spark_entry__
from marlstone.plans import registry

SF = "/root/testdata/sf0.001"


def test_names_and_statements():
    names = set(__spark_entry__.queries())
    assert set(registry.queries()) <= names
    assert set(__spark_entry__.oracle_sql()) <= names
    if importlib.util.find_spec("marlstone.llm") is None:
        assert not any(n.startswith("op") for n in names)


@pytest.mark.parametrize("name", ["scope_map", "leaderboard", "traced_paths"])
def test_queries_run(spark, name):
    spark.read.parquet(f"{SF}/orders.parquet")
    assert registry.queries()[name](spark, SF).count() > 0
