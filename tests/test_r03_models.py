"""The training rows of the drive models: written once, and the same as the labels joined to the features."""

from watchfold.operators import drives as D
from watchfold.plans import bindings as B, models
from watchfold.plans.drives import labelled


def test_a_fit_reads_training_rows_that_are_written(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(models.ml, "fit_and_store", lambda pipeline, train: seen.update(train=train))
    _, rows = models.fitted(spark, "/root/testdata/sf0.001", None)
    assert "Exchange" not in seen["train"]._jdf.queryExecution().executedPlan().toString()
    days = B.entity_days(spark, "/root/testdata/sf0.001")
    joined = D.temporal_features(days, ["value"], "value", ["value"]).join(
        labelled(spark, "/root/testdata/sf0.001").select("serial_number", "date", "target"), ["serial_number", "date"]).where("target IS NOT NULL").select(*rows.columns)
    assert rows.exceptAll(joined).isEmpty() and joined.exceptAll(rows).isEmpty()
    sampled = D.downsample_negatives(joined.where("period < '1999H1'"), 10).select(*seen["train"].columns)
    assert sampled.exceptAll(seen["train"]).isEmpty() and seen["train"].exceptAll(sampled).isEmpty()
