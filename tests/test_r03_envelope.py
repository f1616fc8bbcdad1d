"""Cost of the envelope checks."""

from pyspark.sql import functions as F

from watchfold.operators import envelope as E


def test_envelope_is_parsed_once(spark):
    plan = spark.createDataFrame([("{}",)], "t string").select(E.envelope_errors(F.col("t")).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") <= 2
