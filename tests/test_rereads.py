"""What a query reads more than once is worked out once."""

from chronolith.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_label_changes_are_found_once(spark):
    got = plan(registry.QUERIES["b6_label_changes"](spark, SF))
    assert "MapInArrow" not in got and got.count("events.parquet") == 1


def test_samples_of_all_scopes_are_read_once(spark):
    assert plan(registry.QUERIES["f11_profile_scopes"](spark, SF)).count("events.parquet") == 1
