"""What stays out of the driver."""

import pytest

from touchline.llm import toxicity


def test_toxicity_is_fitted_outside_the_driver(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = toxicity.fit(toxicity.sample(docs, labels, "doc_id", "text"))

    def refused(rows):
        raise AssertionError("fitted in the driver")

    with monkeypatch.context() as m:
        m.setattr(toxicity, "fit", refused)
        assert toxicity.trained(spark, sf) == want and want["weights"]
    assert toxicity.fit_in_task(spark.createDataFrame([], "text string, y int").coalesce(1)) == toxicity.fit([])
    one = toxicity.fit_in_task(spark.createDataFrame([("a b", 1), ("c", 1)], "text string, y int").coalesce(1))
    assert one["constant"] == pytest.approx(1.0) and not one["weights"]
