"""The group queries read the events once, and look up only what their result needs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from watchfold.operators import graph, pairs as P
from watchfold.operators.bandjoin import band_join, side
from watchfold.plans import bindings as B, groups as G

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_verdicts_take_one_pass_and_parse_props_outside_filters(spark):
    text = plan(B.verdicts(spark, SF))
    assert text.count("FileScan parquet") == 1
    assert not [line for line in text.splitlines() if "Filter" in line.split("(")[0] and "get_json_object" in line]


def test_a_band_join_shuffles_a_side_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = spark.range(2000).select((F.col("id") % 5).alias("zone_id"), "id", (F.col("id") * 1000).alias("us"))
        joined = band_join(side(rows, "left", ["zone_id"]), side(rows, "right", ["zone_id"]), ["zone_id"], "left_us", "right_us", 50_000, max_cell_rows=3)
        assert plan(joined).count("__salt") and sum("Exchange hashpartitioning" in line and "__salt" not in line for line in plan(joined).splitlines()) == 2
        want = sum(abs(a - b) <= 50 for a in range(2000) for b in range(a % 5, 2000, 5))
        assert joined.count() == joined.distinct().count() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def counted(monkeypatch):
    calls, nodes = [], B.nodes
    monkeypatch.setattr(B, "nodes", lambda *a, **k: calls.append(1) or nodes(*a, **k))
    return calls


def test_members_with_review_builds_the_nodes_once(spark, monkeypatch):
    calls = counted(monkeypatch)
    G.members_with_review(spark, SF)
    assert len(calls) == 1


def test_annotated_groups_builds_the_nodes_once(spark, monkeypatch):
    calls = counted(monkeypatch)
    G.annotated_groups(spark, SF)
    assert len(calls) == 1


def test_review_reasons_need_no_generic_pairs(spark, monkeypatch):
    calls = counted(monkeypatch)
    monkeypatch.setattr(P, "generic_pairs", lambda *a, **k: 1 / 0)
    G.group_review_reasons(spark, SF)
    assert len(calls) == 1


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("chunk", [100_000, 7])
def test_local_components_are_whole_whatever_a_chunk_sees(spark, monkeypatch, chunk):
    rounds, connect = [], graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda *a, **k: rounds.append(1) or connect(*a, **k))
    rng = random.Random(chunk)
    edges = [(z, a, b) for z in range(4) for a, b in [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(40)]]
    key = lambda z, n: (f"z{z}", None if n == 5 else f"n{n}é" if n % 2 else f"n{n}")
    df = spark.createDataFrame([(key(z, a), key(z, b), f"z{z}") for z, a, b in edges], "src struct<z: string, n: string>, dst struct<z: string, n: string>, zone_id string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunk)
    try:
        rows = graph.local_components(df.repartition(3), ["zone_id"], chunk_edges=chunk).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = lambda v: tuple((x is not None, x) for x in v)
    want = union_find([(order(key(z, a)), order(key(z, b))) for z, a, b in edges if a != b])
    assert len(rows) == len(want) and {order(r.node): order(r.component) for r in rows} == want
    assert bool(rounds) == (chunk == 7)


def test_groups_build_no_pairs_of_faces_and_logs_and_contract_before_the_rounds(spark, monkeypatch):
    """Components need links only, and the rounds over the cluster see what is left between chunks."""
    rounds, connect = [], graph.connected_components
    monkeypatch.setattr(P, "face_ssh_candidates", lambda *a, **k: 1 / 0)
    monkeypatch.setattr(graph, "connected_components", lambda *a, **k: rounds.append(1) or connect(*a, **k))
    assert G.annotated_groups(spark, "/root/testdata/sf0.01").count() == 74 and not rounds


def test_face_log_links_have_the_components_of_all_pairs_and_grow_with_the_rows(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    at = lambda: start + timedelta(seconds=rng.randrange(0, 200_000) if rng.random() < 0.3 else 86_400 + rng.randrange(-300, 300))  # dense at the edge of a block
    faces = spark.createDataFrame([(f"z{i % 2}", f"f{i}", at()) for i in range(150)], "zone_id string, id string, ts timestamp")
    logs = spark.createDataFrame([(f"z{i % 2}", f"l{i}", "ANOMALOUS" if i % 5 else "NO_ANOMALY_EVIDENCE", at(), at() if i % 7 == 0 else None, i % 11 == 0) for i in range(150)],
                                 "zone_id string, id string, state string, log_ts timestamp, declared_ts timestamp, timestamp_uncertain boolean")
    pairs = P.face_ssh_candidates(faces, logs).collect()
    links = P.face_ssh_links(faces, logs).distinct().collect()
    ends = lambda r: ((r.zone_id, r.left_kind, r.left_id), (r.zone_id, r.right_kind, r.right_id))
    assert union_find(map(ends, links)) == union_find([((r.zone_id, "face", r.left_id), (r.zone_id, "ssh", r.right_id)) for r in pairs])
    assert len(pairs) > 2000 and len(links) <= 600
