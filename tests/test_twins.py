import pytest

from crumbline import plans

from .twins import DATA, assert_twin


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_twin(spark, plans.QUERIES[name], plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert {r.policy for r in __spark_entry__.entry(spark).collect()} == {"operator_actual", "same_weekday_mean", "same_weekday_quantile", "roll_chance"}
