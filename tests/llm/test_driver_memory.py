"""What the quality classifier's plans take of the driver: pipeline was stopped beyond 1500 MB there."""

from grafwerk.llm import common, perplexity


def test_the_model_is_trained_by_small_plans(spark):
    """Each order's counts, contexts and probabilities are computed once; the last plan had 58 aggregates."""
    texts = spark.createDataFrame([("en", "one text and another text"), ("de", "noch ein text"), ("", "x")], "lang string, text string")
    plan = perplexity.train(texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") <= 12 and plan.count("Exchange") <= 20


def test_each_table_written_trims_the_driver(spark, monkeypatch):
    said = []
    trim = common.trim_driver
    monkeypatch.setattr(common, "trim_driver", lambda s: said.append(trim(s)))
    rows = spark.range(5)
    assert sorted(r.id for r in common.written(rows, "trimmed").collect()) == list(range(5))
    assert len(said) == 1 and (said[0] is None or "Trim native heap" in said[0])
