"""Spatial association, isolation forest, linear encoder and stateful streams."""

import itertools
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from watchfold.operators import ml, vision as V
from watchfold.streaming import stateful

BOX = "image_id long, detection_id long, class_name string, x1 double, y1 double, x2 double, y2 double"


def test_association_rules_by_hand(spark):
    rows = [(1, 1, "person", 0, 0, 100, 100), (1, 2, "person", 50, 0, 150, 100), (1, 3, "helmet", 60, 10, 80, 30), (1, 4, "helmet", 90, 90, 110, 110), (1, 5, "helmet", 140, 10, 160, 30), (1, 6, "ladder", 10, 10, 20, 20),
            (1, 7, "helmet", 10, 10, 10, 20), (1, 8, "helmet", 200, 200, 210, 210), (2, 1, "helmet", 0, 0, 5, 5)]
    df = spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], BOX)
    got = {(r.image_id, r.detection_id): (r.person_index, r.unassigned_reason) for r in V.associate_items(df, ["helmet"]).collect()}
    assert got[(1, 3)] == (0, None)  # inside both people: the lower index wins the tie
    assert got[(1, 4)] == (1, None)  # half inside the second person, a quarter inside the first
    assert got[(1, 5)] == (1, None)  # containment exactly one half
    assert got[(1, 6)] == (None, "CLASS_NOT_ASSOCIABLE")
    assert got[(1, 7)] == (None, "NO_PERSON_MATCH")  # no area
    assert got[(1, 8)] == (None, "NO_PERSON_MATCH") and got[(2, 1)] == (None, "NO_PERSON_MATCH")
    people = V.person_compliance(df, V.associate_items(df, ["helmet"]))
    assert {r.status for r in people.collect()} == {"NON_COMPLIANT"}
    assert {r.image_id: r.overall_status for r in V.image_compliance(df, people).collect()} == {1: "NON_COMPLIANT", 2: "NO_PERSON"}


@pytest.mark.parametrize("cell", [7.0, 64.0, 1000.0])
def test_grid_join_equals_all_touching_pairs(spark, cell):
    rng = np.random.default_rng(3)
    box = lambda i, kind, size: (1, i, kind, *(lambda x, y: (x, y, x + size * rng.random(), y + size * rng.random()))(float(rng.integers(0, 200)), float(rng.integers(0, 200))))
    rows = [box(i, "person", 80) for i in range(25)] + [box(100 + i, "helmet", 15) for i in range(40)]
    df = spark.createDataFrame([tuple(float(v) if k > 2 else v for k, v in enumerate(r)) for r in rows], BOX)
    people = V.index_people(df)
    items = df.where("class_name = 'helmet'").select("image_id", "detection_id", "x1", "y1", "x2", "y2")
    got = sorted((r.detection_id, r.person_index) for r in V.overlapping(items, people, cell).collect())
    order = sorted((r for r in rows if r[2] == "person"), key=lambda r: (r[3], r[4]))
    want = sorted((i[1], n) for i, (n, p) in itertools.product([r for r in rows if r[2] == "helmet"], enumerate(order)) if i[3] <= p[5] and p[3] <= i[5] and i[4] <= p[6] and p[4] <= i[6])
    assert got == want


def test_isolation_forest_ranks_outliers_first(spark):
    rng = np.random.default_rng(0)
    data = [(i, *map(float, rng.normal(size=2))) for i in range(300)] + [(1000 + i, 12.0 + i, -12.0) for i in range(3)]
    df = spark.createDataFrame(data, "id long, a double, b double")
    run = lambda d: ml.isolation_score(d, ml.fit_isolation_forest(d, ["id"], ["a", "b"], trees=40, sample=64), ["a", "b"], 64).orderBy(F.desc("anomaly_score"), "id").select("id", "anomaly_score").collect()
    first, second = run(df), run(df.repartition(5))
    assert {r.id for r in first[:3]} == {1000, 1001, 1002} and first == second
    flags = ml.flag_by_contamination(ml.isolation_score(df, ml.fit_isolation_forest(df, ["id"], ["a", "b"], 40, 64), ["a", "b"], 64), 0.15)
    assert abs(flags.where("if_prediction = 'ANOMALOUS'").count() - 45) <= 1


def test_reconstruction_error_of_a_plane(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y), float(x + y)) for i, (x, y) in enumerate(rng.normal(size=(80, 2)))] + [(99, 1.0, 1.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    model = ml.fit_linear_encoder(df.where("id < 80"), ["a", "b", "c"], 2)
    err = {r.id: r.reconstruction_error for r in ml.reconstruction_error(model, df, ["a", "b", "c"]).collect()}
    assert max(v for k, v in err.items() if k < 80) < 1e-12 and err[99] > 1


def stream_of(spark, tmp_path, frames, schema):
    """One file per frame, read one file per trigger, so that state crosses micro-batches."""
    for i, f in enumerate(frames):
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def collect(spark, stream, tmp_path):
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_temporal_state_crosses_batches(spark, tmp_path):
    schema = "serial_number long, date string, value double"
    rows = [(1, f"2024-01-{d:02d}", float(d * d)) for d in range(1, 21)]
    got = {r.date: r for r in collect(spark, stateful.temporal_stream(stream_of(spark, tmp_path, [rows[:6], rows[6:7], rows[7:]], schema)), tmp_path)}
    p = pd.Series([v for *_, v in rows])
    assert len(got) == 20
    for i, (_, d, v) in enumerate(rows):
        r = got[d]
        if i == 0:
            assert r.value_delta_1 is None or np.isnan(r.value_delta_1)
        else:
            assert r.value_delta_1 == v - p[i - 1] and abs(r.value_7obs_mean - p[max(0, i - 6):i + 1].mean()) < 1e-9
        if i >= 7:
            assert r.value_delta_7 == v - p[i - 7]


def test_lifecycle_machine(spark, tmp_path):
    schema = "subject_id long, position long, action string, actor string, is_admin boolean, resolution string, rationale string, acknowledged boolean"
    long = "a rationale that is long enough"
    rows = [(1, 0, "RESOLVE", "ann", False, "NO_FINDING", long, True), (1, 1, "START_REVIEW", "ann", False, None, "", False), (1, 2, "RESOLVE", "bob", False, "NO_FINDING", long, True),
            (1, 3, "RESOLVE", "ann", False, "NO_FINDING", "short", True), (1, 4, "RESOLVE", "bob", True, "NO_FINDING", long, True), (1, 5, "REOPEN", "bob", False, None, "short", False), (1, 6, "REOPEN", "bob", False, None, long, False), (1, 7, "START_REVIEW", "bob", False, None, "", False)]
    got = sorted(collect(spark, stateful.lifecycle_stream(stream_of(spark, tmp_path, [rows[:3], rows[3:5], rows[5:]], schema)), tmp_path), key=lambda r: r.position)
    assert [(r.accepted, r.to_state, r.reason) for r in got] == [
        (False, "OPEN", "NOT_ALLOWED_FROM_STATE"), (True, "IN_REVIEW", None), (False, "IN_REVIEW", "NOT_ASSIGNED_REVIEWER"), (False, "IN_REVIEW", "INCOMPLETE_RESOLUTION"),
        (True, "RESOLVED", None), (False, "RESOLVED", "RATIONALE_TOO_SHORT"), (True, "REOPENED", None), (True, "IN_REVIEW", None)]


def test_unknown_action_is_refused_and_the_stream_goes_on(spark, tmp_path):
    schema = "subject_id long, position long, action string, actor string, is_admin boolean, resolution string, rationale string, acknowledged boolean"
    rows = [(1, 0, "DELETE", "ann", False, None, "", False), (1, 1, None, "ann", False, None, "", False), (1, 2, "START_REVIEW", "ann", False, None, "", False)]
    got = sorted(collect(spark, stateful.lifecycle_stream(stream_of(spark, tmp_path, [rows], schema)), tmp_path), key=lambda r: r.position)
    assert [(r.accepted, r.to_state, r.reason) for r in got] == [(False, "OPEN", "UNKNOWN_ACTION"), (False, "OPEN", "UNKNOWN_ACTION"), (True, "IN_REVIEW", None)]


def test_late_rows_come_out_marked(spark, tmp_path):
    schema = "serial_number long, date string, value double"
    got = collect(spark, stateful.temporal_stream(stream_of(spark, tmp_path, [[(1, "2024-01-02", 1.0)], [(1, "2024-01-01", 9.0), (1, "2024-01-03", 4.0)]], schema)), tmp_path)
    assert {(r.date, r.late) for r in got} == {("2024-01-02", False), ("2024-01-01", True), ("2024-01-03", False)}
    assert [r.value_delta_1 for r in got if r.date == "2024-01-03"] == [3.0]


def test_idle_drives_leave_the_state_with_a_row(spark, tmp_path):
    schema = "serial_number long, date string, value double"
    rows = [[(1, "2024-01-01", 1.0), (1, "2024-01-03", 2.0), (2, "2024-01-01", 5.0)], [(2, "2024-02-20", 6.0)], [(2, "2024-05-01", 7.0)], [(1, "2024-06-01", 4.0), (2, "2024-06-01", 9.0)]]
    stream = stateful.temporal_stream(stream_of(spark, tmp_path, rows, schema), idle_days=60, watermark="10 days")
    got = collect(spark, stream, tmp_path)
    gone = {(r.serial_number, r.date) for r in got if r.expired}
    # drive 1 pauses for five months and starts anew; drive 2 pauses for 50 and 70 days: the second pause is only known to be over when its next row is there
    assert (1, "2024-01-03") in gone
    deltas = {(r.serial_number, r.date): r.value_delta_1 for r in got if not r.expired}
    assert pd.isna(deltas[1, "2024-06-01"]) and deltas[2, "2024-02-20"] == 1.0 and deltas[1, "2024-01-03"] == 1.0
    assert all(pd.isna(r.value) for r in got if r.expired) and not any(r.late for r in got)


REQUEST = "subject_id long, position long, action string, actor string, is_admin boolean, resolution string, rationale string, acknowledged boolean"


def test_idle_subjects_leave_the_state(spark, tmp_path):
    long, day = "a rationale that is long enough", lambda m, d: datetime(2024, m, d)
    rows = [[(1, 0, "START_REVIEW", "ann", False, None, "", False, day(1, 1)), (2, 0, "START_REVIEW", "bob", False, None, "", False, day(1, 1)), (3, 0, "REOPEN", "eve", False, None, "", False, day(1, 1))],
            [(2, 1, "RESOLVE", "eve", False, None, "", False, day(2, 20))], [(2, 2, "RESOLVE", "bob", False, "NO_FINDING", long, True, day(3, 30))],
            [(1, 1, "RESOLVE", "ann", False, "NO_FINDING", long, True, day(4, 1))]]
    stream = stateful.lifecycle_stream(stream_of(spark, tmp_path, rows, REQUEST + ", requested_at timestamp"), idle_days=60)
    got = [(r.subject_id, r.action, r.from_state, r.to_state, r.accepted) for r in collect(spark, stream, tmp_path)]
    assert (1, "EXPIRED", "IN_REVIEW", "OPEN", True) in got and (1, "RESOLVE", "OPEN", "OPEN", False) in got
    # a refused request, too, puts off the end of subject 2; subject 3 never had a state
    assert (2, "RESOLVE", "IN_REVIEW", "RESOLVED", True) in got and not any(g[1] == "EXPIRED" and g[0] > 1 for g in got)


def test_a_new_stream_starts_from_known_states(spark, tmp_path):
    known = spark.createDataFrame([(1, "IN_REVIEW", "ann"), (2, "RESOLVED", None)], "subject_id long, state string, assignee string")
    long = "a rationale that is long enough"
    rows = [(1, 0, "RESOLVE", "ann", False, "NO_FINDING", long, True), (2, 0, "REOPEN", "bob", False, None, long, False), (3, 0, "REOPEN", "bob", False, None, long, False)]
    got = collect(spark, stateful.lifecycle_stream(stream_of(spark, tmp_path, [rows], REQUEST), known=known), tmp_path)
    assert {r.subject_id: (r.from_state, r.accepted) for r in got} == {1: ("IN_REVIEW", True), 2: ("RESOLVED", True), 3: ("OPEN", False)}


def test_ingestion_retries_failures_and_never_reads_large_files(spark, tmp_path):
    from watchfold.streaming import ingest

    inbox, ledger = tmp_path / "in", str(tmp_path / "ledger")
    inbox.mkdir()
    for name, text in [("a.txt", "fine"), ("b.txt", "bad"), ("c.txt", "left out"), ("d.txt", "x" * 500)]:
        (inbox / name).write_text(text)
    mended = []

    def handle(files):
        ok = F.col("content").cast("string") != ("nothing" if mended else "bad")
        if mended == ["raise"]:
            raise ValueError("broken handler")
        return files.where("path NOT LIKE '%c.txt'").select("path", "content_sha256", F.when(ok, "COMPLETE").otherwise("FAILED").alias("status"))

    run = lambda: ingest.ingest_stream(spark, str(inbox), "*.txt", "k", ledger, str(tmp_path / "cp"), handle, 100, min_age_seconds=0).awaitTermination()
    last = lambda: {r.path[-5:]: r.s for r in ingest._ledger(spark, ledger, "k").groupBy("path").agg(F.max_by("status", "recorded_at").alias("s")).collect()}
    run()
    assert last() == {"a.txt": "COMPLETE", "b.txt": "FAILED", "c.txt": "FAILED", "d.txt": "TOO_LARGE"}
    mended.append("raise")
    run()
    assert last()["b.txt"] == "FAILED"
    mended[:] = ["mended"]
    run()
    assert last() == {"a.txt": "COMPLETE", "b.txt": "COMPLETE", "c.txt": "FAILED", "d.txt": "TOO_LARGE"}
    assert ingest._ledger(spark, ledger, "k").where("path LIKE '%a.txt'").count() == 1
    (inbox / "e.txt").write_text("young")
    ingest.scan_once(spark, str(inbox), "e.txt", "k", ledger, handle, 100, 3600)
    assert last()["e.txt"] == "PENDING"
    ingest.scan_once(spark, str(inbox), "e.txt", "k", ledger, handle, 100, 0)
    assert last()["e.txt"] == "COMPLETE"


def test_every_query_with_sql_is_registered():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 200


def test_registration_needs_no_session():
    import subprocess
    import sys
    code = "import __spark_entry__ as e; assert len(e.queries()) > 200 and len(e.oracle_sql()) > 200"
    root = __file__.rsplit("/tests/", 1)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
