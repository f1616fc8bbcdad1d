"""Table streams and the lifecycle query on folders of files."""

from watchfold.streaming import windows as SW


def test_table_stream_reads_a_folder_of_files_and_a_single_file(spark, tmp_path):
    rows = spark.range(20).withColumnRenamed("id", "event_id")
    rows.repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    rows.coalesce(1).toPandas().to_parquet(tmp_path / "single.parquet")
    for name in ("many", "single"):
        out = SW.run_to_table(SW.read_table_stream(spark, str(tmp_path), name), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state"))
        assert sorted(r["event_id"] for r in out.collect()) == list(range(20))


def test_lifecycle_refuses_other_roles(spark, tmp_path):
    from watchfold.plans.streams import streaming_lifecycle
    spark.createDataFrame([(1, 0, "user", "x" * 20), (1, 1, "tool", "x" * 20)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((r["position"], r["action"], r["reason"]) for r in streaming_lifecycle(spark, str(tmp_path)).collect())
    assert got == [(0, "START_REVIEW", None), (1, None, "UNKNOWN_ACTION")]


def test_drives_that_share_a_key_keep_their_own_history(spark, tmp_path):
    """Numbers of one key, of the next, below zero and missing; one drive pauses, one row is late."""
    from watchfold.streaming import stateful
    schema, drives = "serial_number long, date string, value double", [0, 1, 63, 64, -1, None]
    frames = [[(d, f"2024-01-{1 + 2 * i:02d}", float(i * i + 100 * (d or 7))) for i in range(9) for d in drives],
              [(d, "2024-01-25", 5.0) for d in drives[1:]] + [(1, "2024-01-02", 9.0), (63, "2024-01-26", None), (63, "2024-01-27", 8.0)],
              [(1, "2024-06-01", 1.0)], [(64, "2024-06-02", 2.0)]]
    for f in frames:
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = SW.run_to_table(stateful.temporal_stream(stream, 60, "10 days"), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    # drive 1 comes back before its pause is known to be over
    assert sorted((str(r["serial_number"]), r["date"]) for r in got if r["expired"]) == [("-1", "2024-01-25"), ("0", "2024-01-17"), ("63", "2024-01-27"), ("64", "2024-01-25"), ("None", "2024-01-25")]
    assert [(r["serial_number"], r["date"], r["value"]) for r in got if r["late"]] == [(1, "2024-01-02", 9.0)]
    at = {(r["serial_number"], r["date"]): r for r in got if not r["late"] and not r["expired"]}
    assert len(at) == sum(map(len, frames)) - 1
    for d in drives:
        values = [v for f in frames[:2] for n, day, v in sorted(f, key=lambda r: r[1]) if n == d and (n, day) != (1, "2024-01-02")]
        days = [day for f in frames[:2] for n, day, _ in sorted(f, key=lambda r: r[1]) if n == d and (n, day) != (1, "2024-01-02")]
        for i, day in enumerate(days):
            delta = lambda back: values[i] - values[i - back] if i >= back and None not in (values[i], values[i - back]) else None
            seen = [v for v in values[max(0, i - 6):i + 1] if v is not None]
            assert (at[d, day]["value_delta_1"], at[d, day]["value_delta_7"]) == (delta(1), delta(7))
            assert at[d, day]["value_7obs_mean"] == (None if len(seen) < 2 else sum(seen) / len(seen)) or abs(at[d, day]["value_7obs_mean"] - sum(seen) / len(seen)) < 1e-9
    assert at[1, "2024-06-01"]["value_delta_1"] == -4.0 and at[64, "2024-06-02"]["value_delta_1"] is None


def test_a_subject_without_later_rows_leaves_the_state(spark, tmp_path):
    from watchfold.streaming import stateful
    schema = "subject_id long, position long, action string, actor string, is_admin boolean, resolution string, rationale string, acknowledged boolean, requested_at timestamp"
    for subject, day in ((1, "2024-01-01"), (2, "2024-06-01"), (2, "2024-06-09")):
        spark.createDataFrame([(subject, int(day[-2:]), "START_REVIEW", "ann", False, None, "", False)], schema.rsplit(",", 1)[0]).selectExpr("*", f"timestamp'{day}' AS requested_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = SW.run_to_table(stateful.lifecycle_stream(stream, idle_days=30), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert [(r["subject_id"], r["from_state"]) for r in got if r["action"] == "EXPIRED"] == [(1, "IN_REVIEW")]


def test_interval_join_meets_by_time_cell(spark, tmp_path):
    """All pairs within the interval, each once, also over the ends of cells."""
    from datetime import datetime, timedelta, timezone
    seconds = 10
    width = SW.CELL_SPANS * seconds
    start = datetime.fromtimestamp(20_000_000 * width, timezone.utc)
    rows = [(zone, kind, f"{kind}{t}", start + timedelta(seconds=t)) for zone in ("a", "b") for kind, step in (("maintenance", 7), ("ssh", 5)) for t in range(-width - 21, 2 * width + 21, step)]
    spark.createDataFrame(rows, "zone_id string, kind string, id string, ts timestamp").write.parquet(str(tmp_path / "nodes.parquet"))
    view = lambda: SW.read_table_stream(spark, str(tmp_path), "nodes")
    joined = SW.interval_join(view(), view(), seconds)
    assert "left_cell" in joined._jdf.queryExecution().analyzed().toString()
    got = [(r["left_zone_id"], r["left_id"], r["right_id"]) for r in SW.run_to_table(joined, str(tmp_path / "out"), str(tmp_path / "state")).collect()]
    want = [(a[0], a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and (a[1], b[1]) == ("maintenance", "ssh") and abs((a[3] - b[3]).total_seconds()) <= seconds]
    assert sorted(got) == sorted(want)
