"""Log parsing, windows and detectors on hand-made rows."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from watchfold.functions import sshlog
from watchfold.operators import assess, windows
from watchfold.sources import logs

HEAD = "Dec 10 06:55:48 LabSZ sshd[24200]: "
CASES = [  # message, event type, user, address, count
    ("message repeated 5 times: [ Failed password for root from 5.36.59.76 port 42393 ssh2]", "failed_login", "root", "5.36.59.76", 5),
    ("message repeated 2 times: [ Failed password for invalid user a b from 1.2.3.4 port 1 ssh2]", "failed_login", "a b", "1.2.3.4", 2),
    ("message repeated 3 times: [ hello ]", "repeated_message", None, None, 3),
    ("Failed password for invalid user oracle db from 1.2.3.4 port 22 ssh2", "failed_login", "oracle db", "1.2.3.4", 1),
    ("Failed password for root from 1.2.3.4 port 22 ssh2", "failed_login", "root", "1.2.3.4", 1),
    ("Accepted publickey for ann from 1.2.3.4 port 22 ssh2", "successful_login", "ann", "1.2.3.4", 1),
    ("Invalid user web master from 1.2.3.4", "invalid_user", "web master", "1.2.3.4", 1),
    ("pam_unix(sshd:auth): authentication failure; rhost=9.9.9.9  user=root", "auth_failure", "root", "9.9.9.9", 1),
    ("pam_unix(sshd:auth): authentication failure; ruser= rhost=host.example", "auth_failure", None, None, 1),
    ("reverse mapping for x [7.7.7.7] failed - POSSIBLE BREAK-IN ATTEMPT!", "breakin_warning", None, "7.7.7.7", 1),
    # The earlier "authentication failure" rule also covers the next two, as first match wins.
    ("Disconnecting: Too many authentication failures for root [preauth]", "auth_failure", None, None, 1),
    ("PAM 4 more authentication failures; rhost=8.8.8.8  user=root", "auth_failure", "root", "8.8.8.8", 1),
    ("Connection closed by 1.1.1.1 [preauth]", "connection_closed", None, "1.1.1.1", 1),
    ("Received disconnect from 1.1.1.1: 11: Bye", "disconnect", None, "1.1.1.1", 1),
    ("Did not receive identification string from 1.1.1.1", "no_identification", None, "1.1.1.1", 1),
    ("PAM service(sshd) ignoring max retries; 6 > 3", "max_retries_exceeded", None, None, 1),
    ("Server listening on :: port 22.", "other", None, None, 1),
]


def test_first_matching_pattern_wins(spark):
    df = spark.createDataFrame([(i, HEAD + m) for i, (m, *_) in enumerate(CASES)] + [(99, "kernel: nothing")], "line_number long, value string")
    got = {r.line_number: r for r in sshlog.parse_lines(df).collect()}
    assert 99 not in got and len(got) == len(CASES)
    for i, (_, kind, user, ip, count) in enumerate(CASES):
        r = got[i]
        assert (r.event_type, r.username, r.source_ip, r.event_count) == (kind, user, ip, count), r
    assert got[0].timestamp == datetime(2000, 12, 10, 6, 55, 48)
    rep = sshlog.parse_report(df).first()
    assert (rep.total_lines, rep.parsed_lines, rep.unparsed_lines) == (len(CASES) + 1, len(CASES), 1)


def test_log_files_keep_line_numbers_and_replace_bad_bytes(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\ntw\xff\n\nfour\n")
    (tmp_path / "b.log").write_bytes(b"only")
    rows = {(r.file[-5:], r.line_number): r.value for r in logs.read_log_files(spark, str(tmp_path)).collect()}
    assert rows == {("a.log", 1): "one", ("a.log", 2): "tw�", ("a.log", 3): "", ("a.log", 4): "four", ("b.log", 1): "only"}


def test_log_files_cut_into_blocks_number_like_a_sequential_read(spark, tmp_path):
    rnd, wanted = random.Random(1), {}
    for folder in ("a", "b/c"):
        (tmp_path / folder).mkdir(parents=True)
        for name in ("x.log", "y.log", "empty.log"):
            lines = [b"" if rnd.random() < .1 else bytes(rnd.choices(b"abc \r\xff", k=rnd.randint(1, 60))) for _ in range(0 if name == "empty.log" else 400)]
            (tmp_path / folder / name).write_bytes(b"\n".join(lines) + (b"\n" if name == "x.log" else b""))
            lines = lines[:-1] if lines and not lines[-1] and name == "y.log" else lines
            wanted |= {(f"{folder}/{name}", k + 1): line.removesuffix(b"\r").decode(errors="replace") for k, line in enumerate(lines)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = logs.read_log_files(spark, [f"{tmp_path}/a", f"{tmp_path}/b/c"])
        assert df.rdd.getNumPartitions() > 40
        found = [(r.file.split(f"{tmp_path.name}/")[-1], r.line_number, r.value) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(found) == len(wanted) and {(f, n): v for f, n, v in found} == wanted


def test_log_files_cut_otherwise_fail(spark, tmp_path):
    (tmp_path / "x.log").write_text("line\n" * 2000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lines = logs.read_log_files(spark, str(tmp_path))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        with pytest.raises(Exception, match="cut into other blocks"):
            lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sketched_users_are_within_the_stated_error(spark):
    users = {"a": 15, "b": 150, "c": 20_000, "d": 0}
    rows = spark.createDataFrame(list(users.items()), "source_ip string, n int").select("source_ip", F.explode(F.sequence(F.lit(0), F.col("n") * 2)).alias("k"), "n")
    events = rows.select("source_ip", F.lit(datetime(2024, 1, 1)).alias("timestamp"), F.when(F.col("k") < F.col("n") * 2, "failed_login").otherwise("disconnect").alias("event_type"),
                         F.concat(F.lit("u"), F.col("k") % F.greatest(F.col("n"), F.lit(1))).alias("username"), F.lit(1).cast("long").alias("event_count"))
    found = {r.source_ip: r.unique_users for r in windows.entity_window_features(events, exact_distinct=False).collect()}
    assert (found["a"], found["b"], found["d"]) == (15, 150, 0)
    assert abs(found["c"] - 20_000) <= 3 * 1.04 / 2 ** (windows.SKETCH_BITS / 2) * 20_000


def test_window_features_edges(spark):
    t = lambda s: datetime(2024, 1, 1, 9, *s)
    rows = [(t((10, 0)), "1.1.1.1", "failed_login", "ROOT", 3), (t((10, 0)), "1.1.1.1", "successful_login", "root", 1), (t((14, 59)), "1.1.1.1", "successful_login", "root", 4),
            (t((15, 0)), "1.1.1.1", "successful_login", "ann", 1), (t((10, 1)), None, "failed_login", "x", 9), (t((10, 0)), "2.2.2.2", "disconnect", None, 2)]
    df = spark.createDataFrame(rows, "timestamp timestamp, source_ip string, event_type string, username string, event_count long")
    got = {(r.source_ip, r.window_start.minute): r for r in windows.entity_window_features(df).collect()}
    assert set(got) == {("1.1.1.1", 10), ("1.1.1.1", 15), ("2.2.2.2", 10)}
    a = got[("1.1.1.1", 10)]
    assert (a.failed_login_count, a.successful_login_count, a.unique_users, a.root_attempt_count) == (3, 5, 2, 8)
    assert a.root_attempt_ratio == 8 / 3 and a.success_after_failures == 1 and a.attempt_rate == 8 / 5
    assert got[("1.1.1.1", 15)].success_after_failures == 0
    b = got[("2.2.2.2", 10)]
    assert (b.failure_ratio, b.root_attempt_ratio, b.disconnect_count) == (0.0, 0.0, 2)


def test_success_at_the_same_time_as_the_failure_does_not_count(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "a", "failed_login", "u", 1), (t, "a", "successful_login", "u", 1)], "timestamp timestamp, source_ip string, event_type string, username string, event_count long")
    assert windows.entity_window_features(df).first().success_after_failures == 0


def feature_row(spark, **kw):
    base = dict(failed_login_count=0, unique_users=0, root_attempt_ratio=0.0, breakin_warning_count=0) | kw
    return spark.createDataFrame([tuple(base.values())], "failed_login_count long, unique_users long, root_attempt_ratio double, breakin_warning_count long")


def test_rule_limits(spark):
    run = lambda **kw: assess.detect_rules(feature_row(spark, **kw)).first()
    assert run(failed_login_count=10).triggered_rules == "REPEATED_FAILURES" and run(failed_login_count=9).prediction == "NORMAL"
    assert run(unique_users=5).triggered_rules == "USERNAME_ENUMERATION"
    assert run(failed_login_count=5, root_attempt_ratio=0.8).triggered_rules == "ROOT_TARGETING"
    assert run(failed_login_count=4, root_attempt_ratio=1.0).prediction == "NORMAL"
    s = run(breakin_warning_count=1)
    assert (s.prediction, s.rule_score, s.evidence) == ("SUSPICIOUS", 0, "1 OpenSSH break-in warning(s)")
    assert run(failed_login_count=8, root_attempt_ratio=0.825).evidence == "82% of failed attempts targeted root"


def test_votes(spark):
    rows = [("ANOMALOUS", "ANOMALOUS", "ANOMALOUS", 0), ("SUSPICIOUS", "NORMAL", "NORMAL", 1), ("NORMAL", "ANOMALOUS", "NORMAL", 0), ("NORMAL", "NORMAL", "NORMAL", 0), ("ANOMALOUS", "NORMAL", "ANOMALOUS", 1)]
    df = spark.createDataFrame(rows, "rule_prediction string, if_prediction string, ae_prediction string, breakin_warning_count int")
    got = [(r.votes, r.confidence, r.combination, r.evidence_state) for r in assess.fuse_votes(df).collect()]
    assert got == [(3, "HIGH", "RULE+IF+AE", "HIGH_CONFIDENCE_ANOMALY"), (0, "EXPLICIT_SECURITY_SIGNAL", "NONE", "EXPLICIT_SECURITY_EVENT"),
                   (1, "LOW", "IF", "ANOMALY_CANDIDATE"), (0, "NONE", "NONE", "NO_ANOMALY_EVIDENCE"), (2, "MEDIUM", "RULE+AE", "EXPLICIT_SECURITY_EVENT")]


def test_environment_limits(spark):
    df = spark.createDataFrame([(35.0, 80.0), (35.01, 80.01), (None, 19.99), (None, 20.0), (None, None), (10.0, 101.0)], "temperature_c double, humidity_pct double")
    got = [(r.assessment, list(r.conditions)) for r in assess.assess_environment(df).collect()]
    assert got == [("NORMAL", []), ("HIGH_TEMPERATURE", ["HIGH_TEMPERATURE", "HIGH_HUMIDITY"]), ("LOW_HUMIDITY", ["LOW_HUMIDITY"]), ("NORMAL", []), ("INVALID", []), ("INVALID", [])]
    m = spark.createDataFrame([("1.5",), ("nan",), ("-Infinity",), ("x",)], "v string").select(assess.finite_measurement(F.col("v")).alias("m")).collect()
    assert [r.m for r in m] == [1.5, None, None, None]


def test_honeypot_username(spark):
    df = spark.createDataFrame([("USERNAME:  ROOT , password: x",), ("Username: , password: x",), (None,)], "m string")
    assert [r.u for r in df.select(sshlog.honeypot_username(F.col("m")).alias("u")).collect()] == ["ROOT", None, None]
