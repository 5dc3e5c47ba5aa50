"""A card of JSON is parsed once for a row."""

from lodestone.plans.catalog import QUERIES


def test_a_card_is_parsed_once(spark, sf):
    plan = QUERIES["str_func_card_text"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1
