"""Drive-days in tasks of bounded size, and percentiles that sort only the ranges they need."""

import random
import statistics

from pyspark.sql import functions as F

from watchfold.operators import ranks
from watchfold.plans import bindings as B
from watchfold.plans.drives import labelled

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_drive_days_are_hashed_in_partitions_that_grow_with_the_orders(spark, monkeypatch):
    monkeypatch.setattr(B, "DAYS_A_TASK", 500, raising=False)
    text = plan(labelled(spark, SF).select("label_state", "value", "failure"))
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert "SortAggregate" not in text
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("o_custkey" in line and f", {-(-orders // 500)})" in line for line in exchanges)


def test_percentiles_are_exact_with_hot_values_and_few_rows(spark):
    random.seed(3)
    data = {1: [5.0] * 900 + [random.random() * 9 for _ in range(300)], 2: [7.0], 3: [float(v) for v in range(1000)]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in [*vs, None, float("nan")]], "g int, v double")
    for ranges in (2, 3, 64, 100):
        got = {r.g: r for r in ranks.percentiles(df, ["g"], "v", {"mid": .5, "low": 0.0, "top": 1.0}, ranges).collect()}
        for g, vs in data.items():
            assert (got[g].n, got[g].mid, got[g].low, got[g].top) == (len(vs), statistics.median(vs), min(vs), max(vs))
    assert ranks.percentiles(df, [], "v", {"mid": .5}).first().n == sum(map(len, data.values()))
    assert ranks.percentiles(df.where("g = 9"), ["g"], "v", {"mid": .5}).count() == 0


def test_only_wanted_ranges_are_sorted(spark):
    df = spark.range(64_000).select(F.lit(1).alias("g"), (F.col("id") * 1.0).alias("v"))
    out = ranks.percentiles(df, ["g"], "v", {"mid": .5})
    out.collect()
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" in text.split("Window")[-1] and "wanted" in text
