"""The projection of the benchmark tables keeps all their rows."""

import pytest

from lattica.plans.fixtures import cte, frame

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name, source",
    [("call_relations", "orders"), ("include_relations", "events"), ("reference_relations", "orders"), ("raw_calls", "orders"), ("raw_references", "orders"), ("places", "orders")],
)
def test_relation_tables_hold_every_row(spark, name, source):
    assert frame(spark, SF, name).count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
    assert cte(name).endswith(f"FROM {source} WHERE true)")
