"""Joins and resampling whose memory does not grow with the tables."""

from pyspark.sql import functions as F

from watchfold.operators import metrics as M, pairs as P
from watchfold.sources import topology as G


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_deals_draws_and_keeps_no_picks(spark):
    cells = spark.range(7).select(F.concat(F.lit("u"), "id").alias("unit"), (F.col("id") * 3).alias("a"))
    out = M.cluster_bootstrap(cells, "unit", 50, 11, ["a"])
    index = [r["a"] for r in M.unit_index(cells, "unit").orderBy("idx").collect()]
    picks = spark.range(50).select("id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("s")).select("id", (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("11"), "id", "s")), 1, 15), 16, 10).cast("long") % 7).alias("p"))
    want = {}
    for r in picks.collect():
        want[r["id"]] = want.get(r["id"], 0) + index[r["p"]]
    assert {r["draw"]: r["a"] for r in out.collect()} == want
    assert "Generate" not in plan(out) and "HashAggregate(keys=[draw" in plan(out)


def test_hash_candidates_are_not_broadcast(spark):
    h = spark.range(20).select("id", (F.col("id") * 37).alias("phash"))
    assert "BroadcastHashJoin" not in plan(P.hash_candidates(h, h)) and "SortMergeJoin" in plan(P.hash_candidates(h, h))


def test_contexts_are_not_broadcast_and_null_references_spread(spark):
    events = spark.createDataFrame([("e1", "S1", None, None, None, None), ("e2", None, "A1", None, None, None), ("e3", None, None, "N1", None, None), ("e4", None, None, None, "Q1", None), ("e5", None, None, None, None, "C1"), ("e6", *[None] * 5)],
                                   "event_id string, server_id string, asset_id string, sensor_id string, equipment_id string, camera_id string")
    servers = spark.createDataFrame([("S1", "R1", "Z1"), ("S2", "R2", "Z2")], "server_id string, rack_id string, zone_id string")
    hosted = spark.createDataFrame([("A1", "S2")], "asset_id string, server_id string")
    dim = lambda key, value, zone: spark.createDataFrame([(value, zone)], f"{key} string, zone_id string")
    out = G.resolve_contexts(events, servers, hosted, dim("sensor_id", "N1", "Z3"), dim("equipment_id", "Q1", "Z4"), dim("camera_id", "C1", "Z5"))
    assert sorted((r.event_id, r.resolved_zone, r.origin) for r in out.collect()) == [
        ("e1", "Z1", "DIRECT_SERVER"), ("e2", "Z2", "HOSTED_ASSET"), ("e3", "Z3", "SENSOR"), ("e4", "Z4", "EQUIPMENT"), ("e5", "Z5", "CAMERA")]
    assert "Broadcast" not in plan(out)
