"""Authentication log queries: parsing, windows, detectors, honeypot summaries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from watchfold.functions import sshlog
from watchfold.operators import assess, ranks, windows
from watchfold.plans import bindings as B
from watchfold.plans.registry import query
from watchfold.session import scratch_path
from watchfold.sources import logs
from watchfold.sources.tables import load

DAY = dict(duration="1 day", minutes=1440.0)


def features(spark, sf):
    return windows.entity_window_features(B.auth_events(spark, sf), **DAY)


def ruled(spark, sf):
    return assess.detect_rules(features(spark, sf), "1 day")


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def secs(name):
    return F.unix_seconds(name).alias(f"{name}_s")


FEATURE_OUT = """source_ip, window_start_s, failed_login_count, successful_login_count, invalid_user_count, unique_users,
 round(failure_ratio,6) AS failure_ratio, round(attempt_rate,6) AS attempt_rate, root_attempt_count, breakin_warning_count, disconnect_count,
 no_identification_count, success_after_failures, round(root_attempt_ratio,6) AS root_attempt_ratio"""

PRED_SQL = """CASE WHEN failed_login_count >= {t} OR unique_users >= 5 OR (failed_login_count >= 5 AND root_attempt_ratio >= 0.8) THEN 'ANOMALOUS'
 WHEN breakin_warning_count >= 1 THEN 'SUSPICIOUS' ELSE 'NORMAL' END"""
RULED_SQL = "WITH " + B.AUTH_FEATURES_SQL + """, ruled AS (SELECT *,
 concat_ws('; ', CASE WHEN failed_login_count >= 10 THEN 'REPEATED_FAILURES' END, CASE WHEN unique_users >= 5 THEN 'USERNAME_ENUMERATION' END,
  CASE WHEN failed_login_count >= 5 AND root_attempt_ratio >= 0.8 THEN 'ROOT_TARGETING' END) AS triggered_rules,
 (failed_login_count >= 10)::INT + (unique_users >= 5)::INT + (failed_login_count >= 5 AND root_attempt_ratio >= 0.8)::INT AS rule_score,
 """ + PRED_SQL.format(t=10) + """ AS prediction,
 concat_ws('; ', CASE WHEN failed_login_count >= 10 THEN failed_login_count || ' failed logins in 1 day' END,
  CASE WHEN unique_users >= 5 THEN unique_users || ' unique usernames attempted' END,
  CASE WHEN failed_login_count >= 5 AND root_attempt_ratio >= 0.8 THEN CAST(round_even(root_attempt_ratio * 100, 0) AS INT) || '% of failed attempts targeted root' END,
  CASE WHEN breakin_warning_count >= 1 THEN breakin_warning_count || ' OpenSSH break-in warning(s)' END) AS evidence
 FROM feat)"""

PARSE_SQL = "WITH " + B.AUTH_LOG_SQL + r""", base AS (SELECT line_number, trim(line) AS l FROM log WHERE regexp_matches(trim(line), '^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+sshd\[(\d+)\]:\s+(.*)$')),
 m AS (SELECT line_number, regexp_extract(l, '^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+sshd\[(\d+)\]:\s+(.*)$', ['mon','day','time','host','pid','message']) AS p FROM base),
 n AS (SELECT line_number, strptime('2000 ' || p.mon || ' ' || p.day || ' ' || p.time, '%Y %b %d %H:%M:%S') AS ts, p.host AS hostname, CAST(p.pid AS INT) AS pid, p.message AS message,
   nullif(regexp_extract(p.message, 'message repeated (\d+) times:\s*\[\s*(.*)\s*\]', 1), '') AS rep,
   CASE WHEN regexp_matches(p.message, 'message repeated (\d+) times:\s*\[\s*(.*)\s*\]') THEN regexp_extract(p.message, 'message repeated (\d+) times:\s*\[\s*(.*)\s*\]', 2) ELSE p.message END AS body FROM m),
 t AS (SELECT *, CASE WHEN regexp_matches(body, 'Failed password for invalid user (.+?) from (\d{1,3}(?:\.\d{1,3}){3}) port (\d+)') THEN 'fi'
   WHEN regexp_matches(body, 'Failed password for (\S+) from (\d{1,3}(?:\.\d{1,3}){3}) port (\d+)') THEN 'f'
   WHEN rep IS NOT NULL THEN 'repeated_message'
   WHEN regexp_matches(body, 'Accepted \S+ for (\S+) from (\d{1,3}(?:\.\d{1,3}){3}) port (\d+)') THEN 'successful_login'
   WHEN regexp_matches(body, 'Invalid user (.+?) from (\d{1,3}(?:\.\d{1,3}){3})') THEN 'invalid_user'
   WHEN contains(lower(body), 'authentication failure') THEN 'auth_failure'
   WHEN contains(body, 'POSSIBLE BREAK-IN ATTEMPT') THEN 'breakin_warning'
   WHEN contains(body, 'Too many authentication failures') THEN 'too_many_auth_failures'
   WHEN regexp_matches(body, 'PAM (\d+) more authentication failures') THEN 'pam_more_failures'
   WHEN contains(body, 'Connection closed by') THEN 'connection_closed' WHEN contains(body, 'Received disconnect from') THEN 'disconnect'
   WHEN contains(body, 'Did not receive identification string from') THEN 'no_identification'
   WHEN contains(body, 'PAM service(sshd) ignoring max retries') THEN 'max_retries_exceeded' ELSE 'other' END AS kind,
   nullif(regexp_extract(message, '(\d{1,3}(?:\.\d{1,3}){3})', 1), '') AS any_ip,
   nullif(regexp_extract(regexp_extract(message, '\brhost=(\S+)', 1), '(\d{1,3}(?:\.\d{1,3}){3})', 1), '') AS rhost_ip FROM n),
 parsed AS (SELECT line_number, ts, hostname, pid, message, CASE WHEN kind IN ('fi','f') THEN 'failed_login' ELSE kind END AS event_type,
   CASE kind WHEN 'fi' THEN regexp_extract(body, 'Failed password for invalid user (.+?) from (\d{1,3}(?:\.\d{1,3}){3}) port (\d+)', 1)
    WHEN 'f' THEN regexp_extract(body, 'Failed password for (\S+) from (\d{1,3}(?:\.\d{1,3}){3}) port (\d+)', 1)
    WHEN 'successful_login' THEN regexp_extract(body, 'Accepted \S+ for (\S+) from', 1) WHEN 'invalid_user' THEN regexp_extract(body, 'Invalid user (.+?) from (\d{1,3}(?:\.\d{1,3}){3})', 1)
    WHEN 'auth_failure' THEN nullif(regexp_extract(message, '\buser=(\S+)', 1), '') WHEN 'pam_more_failures' THEN nullif(regexp_extract(message, '\buser=(\S+)', 1), '')
    WHEN 'too_many_auth_failures' THEN nullif(regexp_extract(message, 'failures for (\S+)', 1), '') END AS username,
   CASE WHEN kind IN ('fi','f','successful_login','invalid_user') THEN regexp_extract(body, ' from (\d{1,3}(?:\.\d{1,3}){3})', 1)
    WHEN kind = 'auth_failure' THEN coalesce(rhost_ip, any_ip)
    WHEN kind IN ('breakin_warning','too_many_auth_failures','pam_more_failures','connection_closed','disconnect','no_identification') THEN any_ip END AS source_ip,
   CASE WHEN kind IN ('fi','f','successful_login') THEN CAST(regexp_extract(body, ' port (\d+)', 1) AS INT) END AS source_port,
   kind IN ('fi','invalid_user') AS invalid_user, kind = 'successful_login' AS success,
   coalesce(CAST(rep AS INT), CASE WHEN kind='pam_more_failures' THEN CAST(regexp_extract(message, 'PAM (\d+) more', 1) AS INT) END, 1) AS event_count FROM t)"""


def parsed_log(spark, sf):
    return sshlog.parse_lines(B.auth_log(spark, sf))


@query("parse_auth_log", PARSE_SQL + " SELECT line_number, CAST(epoch(ts) AS BIGINT) AS timestamp_s, hostname, pid, event_type, username, source_ip, source_port, invalid_user, success, event_count FROM parsed")
def parse_auth_log(spark, sf):
    return parsed_log(spark, sf).select("line_number", secs("timestamp"), "hostname", "pid", "event_type", "username", "source_ip",
                                        "source_port", "invalid_user", "success", "event_count")


@query("parse_report", "WITH " + B.AUTH_LOG_SQL + r""" SELECT count(*) AS total_lines,
 count(*) FILTER (regexp_matches(trim(line), '^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+sshd\[(\d+)\]:\s+(.*)$')) AS parsed_lines,
 count(*) FILTER (NOT regexp_matches(trim(line), '^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+sshd\[(\d+)\]:\s+(.*)$')) AS unparsed_lines FROM log""")
def parse_report(spark, sf):
    return sshlog.parse_report(B.auth_log(spark, sf))


@query("parsed_event_types", PARSE_SQL + " SELECT event_type, count(*) AS rows, CAST(sum(event_count) AS BIGINT) AS occurrences FROM parsed GROUP BY 1")
def parsed_event_types(spark, sf):
    return windows.event_distribution(parsed_log(spark, sf))


@query("first_ip_and_rhost", "WITH " + B.AUTH_LOG_SQL + r""" SELECT line_number, nullif(regexp_extract(line, '(\d{1,3}(?:\.\d{1,3}){3})', 1), '') AS ip, nullif(regexp_extract(line, '\brhost=(\S+)', 1), '') AS rhost FROM log""")
def first_ip_and_rhost(spark, sf):
    return B.auth_log(spark, sf).select("line_number", sshlog.first_ipv4(F.col("value")).alias("ip"), sshlog.rhost(F.col("value")).alias("rhost"))


@query("log_text_lines", r"""SELECT doc_id, i AS line_number, string_split(t, chr(10))[i] AS value FROM
 (SELECT doc_id, regexp_replace(text, '\r?\n\z', '') AS t FROM documents), range(1, 100000) r(i) WHERE i <= len(string_split(t, chr(10)))""")
def log_text_lines(spark, sf):
    return logs.explode_lines(load(spark, sf, "documents"), "text", ["doc_id"])


FILES_SQL = "WITH " + B.AUTH_LOG_SQL + ", filed AS (SELECT line, line_number // 4000 AS part, row_number() OVER (PARTITION BY line_number // 4000 ORDER BY line_number) AS place FROM log)"


def log_folders(spark, sf):
    """The raw log as text files, 4,000 line numbers to a folder, read back with the numbers of each file."""
    path = scratch_path(spark, "logs")
    raw = B.auth_log(spark, sf).withColumn("part", F.expr("line_number div 4000"))
    raw.repartition("part").sortWithinPartitions("part", "line_number").select("part", "value").write.partitionBy("part").text(path)
    lines = logs.read_log_files(spark, path)
    return lines.withColumn("part", F.regexp_extract("file", "part=([0-9]+)/", 1).cast("long"))


@query("log_files_numbered", FILES_SQL + " SELECT part, place AS line_number, md5(line) AS line_md5 FROM filed")
def log_files_numbered(spark, sf):
    return log_folders(spark, sf).select("part", "line_number", F.md5("value").alias("line_md5"))


@query("log_file_report", FILES_SQL + r""" SELECT part, count(*) AS total_lines,
 count(*) FILTER (regexp_matches(trim(line), '^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+sshd\[(\d+)\]:\s+(.*)$')) AS parsed_lines,
 count(*) FILTER (NOT regexp_matches(trim(line), '^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+sshd\[(\d+)\]:\s+(.*)$')) AS unparsed_lines FROM filed GROUP BY part""")
def log_file_report(spark, sf):
    return sshlog.parse_report(log_folders(spark, sf), by=["part"])


@query("windowed_events", "WITH " + B.AUTH_SQL + """ SELECT line_number, source_ip, CAST(floor(epoch("timestamp") / 300) * 300 AS BIGINT) AS window_start_s FROM auth WHERE source_ip IS NOT NULL""")
def windowed_events(spark, sf):
    return windows.assign_windows(B.auth_events(spark, sf)).select("line_number", "source_ip",
                                                                   F.unix_seconds("window.start").alias("window_start_s"))


@query("entity_window_features", "WITH " + B.AUTH_FEATURES_SQL + f" SELECT {FEATURE_OUT} FROM feat")
def entity_window_features(spark, sf):
    ints = [c for c in windows.FEATURES if c not in ("failure_ratio", "attempt_rate", "root_attempt_ratio")]
    return features(spark, sf).select("source_ip", secs("window_start"), *ints, *r6("failure_ratio", "attempt_rate", "root_attempt_ratio"))


@query("parsed_log_features", PARSE_SQL + """ SELECT source_ip, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start_s,
 coalesce(sum(event_count) FILTER (event_type='failed_login'),0)::BIGINT AS failed_login_count,
 count(DISTINCT CASE WHEN event_type IN ('failed_login','successful_login') THEN username END) AS unique_users,
 coalesce(sum(event_count) FILTER (event_type='disconnect'),0)::BIGINT AS disconnect_count
 FROM parsed WHERE source_ip IS NOT NULL GROUP BY 1, 2""")
def parsed_log_features(spark, sf):
    return (windows.entity_window_features(parsed_log(spark, sf), **DAY)
            .select("source_ip", secs("window_start"), "failed_login_count", "unique_users", "disconnect_count"))


@query("rule_detector", RULED_SQL + " SELECT source_ip, window_start_s, prediction, rule_score, triggered_rules, evidence FROM ruled")
def rule_detector(spark, sf):
    return ruled(spark, sf).select("source_ip", secs("window_start"), "prediction", "rule_score", "triggered_rules", "evidence")


@query("explicit_security_signals", "WITH " + B.AUTH_FEATURES_SQL + """ SELECT source_ip, window_start_s, breakin_warning_count > 0 AS detected,
 CASE WHEN breakin_warning_count > 0 THEN 'OPENSSH_BREAKIN_WARNING' END AS signal FROM feat""")
def explicit_security_signals(spark, sf):
    return features(spark, sf).select("source_ip", secs("window_start"), assess.explicit_signal().alias("detected"),
                                      F.when(assess.explicit_signal(), "OPENSSH_BREAKIN_WARNING").alias("signal"))


def voted(spark, sf):
    """Rule result plus two derived detector flags standing for the two model outputs."""
    base = ruled(spark, sf).withColumn("log_failed", F.log1p("failed_login_count"))
    cut = ranks.percentiles(base, [], "log_failed", {"cut": 0.85}).select("cut")
    flag = lambda c: F.when(c, "ANOMALOUS").otherwise("NORMAL")
    return (base.crossJoin(F.broadcast(cut))
            .withColumnRenamed("prediction", "rule_prediction")
            .withColumn("if_prediction", flag(F.col("unique_users") >= 8))
            .withColumn("ae_prediction", flag(F.col("log_failed") > F.col("cut"))))


VOTED_SQL = RULED_SQL + """, cut AS (SELECT quantile_cont(ln(1 + failed_login_count), 0.85) AS c FROM ruled),
 voted AS (SELECT source_ip, window_start_s, failed_login_count, unique_users, rule_score, breakin_warning_count, prediction AS rule_prediction,
  CASE WHEN unique_users >= 8 THEN 'ANOMALOUS' ELSE 'NORMAL' END AS if_prediction,
  CASE WHEN ln(1 + failed_login_count) > c + 1e-12 THEN 'ANOMALOUS' ELSE 'NORMAL' END AS ae_prediction FROM ruled, cut),
 fused AS (SELECT *, (rule_prediction='ANOMALOUS')::INT + (if_prediction='ANOMALOUS')::INT + (ae_prediction='ANOMALOUS')::INT AS votes,
  breakin_warning_count > 0 AS sig FROM voted),
 assessed AS (SELECT *, CASE WHEN votes=3 THEN 'HIGH' WHEN votes=2 THEN 'MEDIUM' WHEN votes=1 THEN 'LOW' WHEN sig THEN 'EXPLICIT_SECURITY_SIGNAL' ELSE 'NONE' END AS confidence,
  CASE WHEN votes=0 THEN 'NONE' ELSE concat_ws('+', CASE WHEN rule_prediction='ANOMALOUS' THEN 'RULE' END, CASE WHEN if_prediction='ANOMALOUS' THEN 'IF' END, CASE WHEN ae_prediction='ANOMALOUS' THEN 'AE' END) END AS combination,
  CASE WHEN sig THEN 'EXPLICIT_SECURITY_EVENT' WHEN votes>=2 THEN 'HIGH_CONFIDENCE_ANOMALY' WHEN votes=1 THEN 'ANOMALY_CANDIDATE' ELSE 'NO_ANOMALY_EVIDENCE' END AS evidence_state FROM fused)"""


@query("vote_fusion", VOTED_SQL + " SELECT source_ip, window_start_s, votes, confidence, combination, evidence_state FROM assessed")
def vote_fusion(spark, sf):
    return assess.fuse_votes(voted(spark, sf)).select("source_ip", secs("window_start"), "votes", "confidence", "combination", "evidence_state")


@query("security_relevant", VOTED_SQL + " SELECT source_ip, window_start_s, evidence_state FROM assessed WHERE evidence_state <> 'NO_ANOMALY_EVIDENCE'")
def security_relevant(spark, sf):
    return assess.security_relevant(assess.fuse_votes(voted(spark, sf))).select("source_ip", secs("window_start"), "evidence_state")


@query("high_priority", VOTED_SQL + " SELECT source_ip, window_start_s, evidence_state FROM assessed WHERE evidence_state IN ('EXPLICIT_SECURITY_EVENT','HIGH_CONFIDENCE_ANOMALY')")
def high_priority(spark, sf):
    return assess.high_priority(assess.fuse_votes(voted(spark, sf))).select("source_ip", secs("window_start"), "evidence_state")


AGREE_SQL = """CASE WHEN rule_prediction='ANOMALOUS' AND if_prediction='ANOMALOUS' THEN 'BOTH_ANOMALOUS' WHEN rule_prediction='ANOMALOUS' THEN 'RULE_ONLY'
 WHEN rule_prediction='SUSPICIOUS' AND if_prediction='ANOMALOUS' THEN 'SUSPICIOUS_AND_IF_ANOMALOUS' WHEN rule_prediction='SUSPICIOUS' THEN 'RULE_SUSPICIOUS_ONLY'
 WHEN if_prediction='ANOMALOUS' THEN 'IF_ONLY' ELSE 'BOTH_NORMAL' END"""


@query("detector_agreement", VOTED_SQL + f" SELECT source_ip, window_start_s, {AGREE_SQL} AS agreement FROM voted")
def detector_agreement(spark, sf):
    return voted(spark, sf).select("source_ip", secs("window_start"),
                                   assess.agreement(F.col("rule_prediction"), F.col("if_prediction")).alias("agreement"))


@query("disagreement_rows", VOTED_SQL + f" SELECT source_ip, window_start_s, {AGREE_SQL} AS agreement, failed_login_count FROM voted WHERE {AGREE_SQL} IN ('RULE_ONLY','IF_ONLY','SUSPICIOUS_AND_IF_ANOMALOUS')")
def disagreement_rows(spark, sf):
    a = assess.agreement(F.col("rule_prediction"), F.col("if_prediction"))
    return (voted(spark, sf).withColumn("agreement", a)
            .where(F.col("agreement").isin("RULE_ONLY", "IF_ONLY", "SUSPICIOUS_AND_IF_ANOMALOUS"))
            .orderBy("agreement", F.desc("failed_login_count"), "source_ip", "window_start")
            .select("source_ip", secs("window_start"), "agreement", "failed_login_count"))


@query("single_detector_rows", VOTED_SQL + """, own AS (SELECT source_ip, window_start_s, combination, (CASE combination WHEN 'RULE' THEN rule_score WHEN 'IF' THEN unique_users ELSE failed_login_count END)::DOUBLE AS score
 FROM assessed WHERE combination IN ('RULE', 'IF', 'AE')) SELECT *, rank() OVER (PARTITION BY combination ORDER BY score DESC) AS place FROM own""")
def single_detector_rows(spark, sf):
    """Rows that only one detector flags, each placed by that detector's own score, the strongest first."""
    fused = assess.fuse_votes(voted(spark, sf)).where(F.col("combination").isin("RULE", "IF", "AE"))
    score = F.when(F.col("combination") == "RULE", F.col("rule_score")).when(F.col("combination") == "IF", F.col("unique_users")).otherwise(F.col("failed_login_count"))
    own = fused.select("source_ip", secs("window_start"), "combination", score.cast("double").alias("score"))
    return assess.placed_by_score(own, "combination", "score").orderBy("combination", "place", "source_ip", "window_start_s")


@query("prediction_crosstab", VOTED_SQL + """ SELECT coalesce(rule_prediction, 'All') AS rule_prediction, coalesce(if_prediction, 'All') AS if_prediction, count(*) AS n
 FROM voted GROUP BY CUBE (rule_prediction, if_prediction)""")
def prediction_crosstab(spark, sf):
    return (voted(spark, sf).cube("rule_prediction", "if_prediction").agg(F.count(F.lit(1)).alias("n"))
            .na.fill("All", ["rule_prediction", "if_prediction"]))


@query("votes_value_counts", VOTED_SQL + " SELECT v AS votes, count(assessed.votes) AS n FROM range(0, 4) r(v) LEFT JOIN assessed ON assessed.votes = v GROUP BY 1")
def votes_value_counts(spark, sf):
    counted = assess.fuse_votes(voted(spark, sf)).groupBy(F.col("votes").cast("long").alias("votes")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(4).withColumnRenamed("id", "votes").join(counted, "votes", "left").na.fill(0, ["n"])


@query("top_anomalous_windows", RULED_SQL + " SELECT source_ip, window_start_s, prediction, rule_score, failed_login_count, triggered_rules FROM ruled WHERE prediction='ANOMALOUS' ORDER BY rule_score DESC, failed_login_count DESC, source_ip, window_start_s LIMIT 25")
def top_anomalous_windows(spark, sf):
    return (ruled(spark, sf).where("prediction = 'ANOMALOUS'")
            .orderBy(F.desc("rule_score"), F.desc("failed_login_count"), "source_ip", "window_start").limit(25)
            .select("source_ip", secs("window_start"), "prediction", "rule_score", "failed_login_count", "triggered_rules"))


@query("feature_extremes", "WITH " + B.AUTH_FEATURES_SQL + """ (SELECT 'top' AS side, source_ip, window_start_s, failed_login_count FROM feat ORDER BY failed_login_count DESC, source_ip, window_start_s LIMIT 5)
 UNION ALL (SELECT 'bottom', source_ip, window_start_s, failed_login_count FROM feat ORDER BY failed_login_count, source_ip, window_start_s LIMIT 5)""")
def feature_extremes(spark, sf):
    f = features(spark, sf).select("source_ip", secs("window_start"), "failed_login_count")
    side = lambda name, order: f.orderBy(order, "source_ip", "window_start_s").limit(5).select(F.lit(name).alias("side"), "*")
    return side("top", F.desc("failed_login_count")).unionByName(side("bottom", F.asc("failed_login_count")))


@query("top_windows_by_feature", "WITH " + B.AUTH_FEATURES_SQL + ", long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS v, source_ip, window_start_s FROM feat" for c in windows.FEATURES) +
       """), n AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY v DESC, source_ip, window_start_s)::INT AS place FROM long) SELECT feature, place, source_ip, window_start_s, round(v, 6) AS value FROM n WHERE place <= 20""")
def top_windows_by_feature(spark, sf):
    """The twenty windows with the highest value of each feature; ranks are cut per task before the shuffle."""
    long = features(spark, sf).select("source_ip", "window_start", *windows.FEATURES).unpivot(
        ["source_ip", "window_start"], [F.col(c).cast("double").alias(c) for c in windows.FEATURES], "feature", "v")
    place = F.row_number().over(W.partitionBy("feature").orderBy(F.desc("v"), "source_ip", "window_start"))
    return long.withColumn("place", place).where("place <= 20").select("feature", "place", "source_ip", secs("window_start"), F.round("v", 6).alias("value"))


@query("rule_threshold_sweep", "WITH " + B.AUTH_FEATURES_SQL + ", sweep AS (" + " UNION ALL ".join(
    f"SELECT {t} AS threshold, {PRED_SQL.format(t=t)} AS p FROM feat" for t in (3, 5, 10, 15, 20)) +
    """) SELECT threshold, count(*) FILTER (p='NORMAL') AS normal, count(*) FILTER (p='SUSPICIOUS') AS suspicious, count(*) FILTER (p='ANOMALOUS') AS anomalous,
    count(*) AS windows, round(count(*) FILTER (p='ANOMALOUS') / count(*)::DOUBLE * 100, 6) AS anomalous_pct FROM sweep GROUP BY 1""")
def rule_threshold_sweep(spark, sf):
    return assess.threshold_sweep(features(spark, sf), [3, 5, 10, 15, 20]).withColumn("anomalous_pct", F.round("anomalous_pct", 6))


PCTS = {"p50": .5, "p75": .75, "p90": .9, "p95": .95, "p99": .99, "p995": .995, "max": 1.0}


@query("feature_percentiles", "WITH " + B.AUTH_FEATURES_SQL + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c}::DOUBLE AS v FROM feat" for c in windows.FEATURES) + ") SELECT feature, count(DISTINCT v) AS distinct_values, " +
    ", ".join(f"round(quantile_cont(v, {q}), 6) AS {n}" for n, q in PCTS.items()) + " FROM long GROUP BY 1")
def feature_percentiles(spark, sf):
    long = features(spark, sf).unpivot([], [F.col(c).cast("double").alias(c) for c in windows.FEATURES], "feature", "v")
    distinct = long.groupBy("feature").agg(F.count_distinct("v").alias("distinct_values"))
    return ranks.percentiles(long, ["feature"], "v", PCTS).select("feature", *r6(*PCTS)).join(distinct, "feature")


PAIRS = [(a, b) for i, a in enumerate(windows.FEATURES) for b in windows.FEATURES[i + 1:] if "no_identification_count" not in (a, b)]


@query("feature_correlations", "WITH " + B.AUTH_FEATURES_SQL + " " + " UNION ALL ".join(
    f"SELECT '{a}' AS left_feature, '{b}' AS right_feature, round(corr({a}, {b}), 6) AS r FROM feat" for a, b in PAIRS))
def feature_correlations(spark, sf):
    one = features(spark, sf).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in PAIRS])
    cells = F.array(*[F.struct(F.lit(a).alias("left_feature"), F.lit(b).alias("right_feature"), F.round(F.col(f"`{a}|{b}`"), 6).alias("r"))
                      for a, b in PAIRS])
    return one.select(F.inline(cells))


# ---- honeypot -----------------------------------------------------------------

def honeypot(spark, sf):
    e = B.auth_events(spark, sf)
    kind = (F.when(F.col("event_type").isin("failed_login", "successful_login"), windows.LOGIN)
            .when(F.col("event_type") == "invalid_user", windows.COMMAND)
            .when(F.col("event_type") == "disconnect", windows.DISCONNECT).otherwise(windows.CONNECT))
    name = F.when(F.col("k") % 10 == 9, F.lit("  ")).when(F.col("username") == "root", F.lit("ROOT")).otherwise(F.col("username"))
    events = e.select(
        "timestamp",
        F.when(F.col("k") >= 5, F.concat_ws("-", F.col("user_id"), F.date_format("timestamp", "yyyyMMdd"))).alias("session_id"),
        F.when(F.col("k") != 50, F.col("source_ip")).alias("ip"), kind.alias("event_type"),
        F.when(kind == windows.LOGIN, F.concat(F.lit("Username: "), name, F.lit(" , password: secret"))).alias("message"))
    return windows.with_login_flags(events, sshlog.honeypot_username(F.col("message")))


HONEY_SQL = "WITH " + B.AUTH_SQL + r""", hp0 AS (SELECT "timestamp" AS ts, CASE WHEN k >= 5 THEN user_id || '-' || strftime("timestamp", '%Y%m%d') END AS session_id,
 CASE WHEN k <> 50 THEN source_ip END AS ip,
 CASE WHEN event_type IN ('failed_login','successful_login') THEN 'SSH login' WHEN event_type='invalid_user' THEN 'exec_command' WHEN event_type='disconnect' THEN 'SSH disconnect' ELSE 'SSH connect' END AS event_type,
 CASE WHEN event_type IN ('failed_login','successful_login') THEN 'Username: ' || CASE WHEN k % 10 = 9 THEN '  ' WHEN username='root' THEN 'ROOT' ELSE username END || ' , password: secret' END AS message FROM auth),
 hp1 AS (SELECT *, nullif(trim(regexp_extract(message, '(?i)username:\s*(.*?),\s*password:', 1)), '') AS username FROM hp0),
 hp AS (SELECT *, event_type='SSH login' AS is_login, event_type='SSH connect' AS is_connect, event_type='SSH disconnect' AS is_disconnect, event_type='exec_command' AS is_command,
  event_type='SSH login' AND lower(coalesce(username,''))='root' AS is_root_login FROM hp1)"""


@query("honeypot_login_flags", HONEY_SQL + " SELECT event_type, username, count(*) AS n, count(*) FILTER (is_login) AS logins, count(*) FILTER (is_root_login) AS root_logins FROM hp GROUP BY 1, 2")
def honeypot_login_flags(spark, sf):
    return honeypot(spark, sf).groupBy("event_type", "username").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_login").alias("logins"), F.count_if("is_root_login").alias("root_logins"))


@query("honeypot_windows", HONEY_SQL + """ SELECT ip AS source_ip, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start_s, count(*) AS event_count, count(*) FILTER (is_connect) AS connect_count,
 count(*) FILTER (is_login) AS login_count, count(*) FILTER (is_disconnect) AS disconnect_count, count(*) FILTER (is_command) AS command_count,
 count(DISTINCT session_id) AS unique_sessions, count(DISTINCT CASE WHEN is_login THEN username END) AS unique_login_users, count(*) FILTER (is_root_login) AS root_login_count,
 round(CASE WHEN count(*) FILTER (is_login) > 0 THEN count(*) FILTER (is_root_login) / count(*) FILTER (is_login)::DOUBLE ELSE 0 END, 6) AS root_login_ratio,
 (count(*) FILTER (is_login) > 0)::INT AS has_login, (count(*) FILTER (is_command) > 0)::INT AS has_command FROM hp WHERE ip IS NOT NULL GROUP BY 1, 2""")
def honeypot_windows(spark, sf):
    return (windows.honeypot_windows(honeypot(spark, sf), "1 day").withColumn("root_login_ratio", F.round("root_login_ratio", 6))
            .withColumn("window_start_s", F.unix_seconds("window_start")).drop("window_start", "window_end"))


@query("honeypot_usernames", HONEY_SQL + " SELECT username, count(*) AS login_events, count(DISTINCT ip) AS unique_ips, count(DISTINCT session_id) AS unique_sessions FROM hp WHERE is_login AND username IS NOT NULL GROUP BY 1")
def honeypot_usernames(spark, sf):
    return windows.username_summary(honeypot(spark, sf))


IP_SQL = HONEY_SQL + """, ips AS (SELECT ip AS source_ip, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS total_events, count(*) FILTER (is_connect) AS connect_events,
 count(*) FILTER (is_login) AS login_events, count(*) FILTER (is_disconnect) AS disconnect_events, count(*) FILTER (is_command) AS command_events,
 count(DISTINCT session_id) AS unique_sessions, count(DISTINCT CASE WHEN is_login THEN username END) AS unique_login_users, count(*) FILTER (is_root_login) AS root_login_events,
 round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6::DOUBLE, 6) AS active_minutes FROM hp WHERE ip IS NOT NULL GROUP BY 1)"""


@query("honeypot_ips", IP_SQL + " SELECT * FROM ips")
def honeypot_ips(spark, sf):
    s = windows.ip_summary(honeypot(spark, sf))
    return s.select(*[c for c in s.columns if c not in ("first_seen", "last_seen", "active_minutes")],
                    F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), *r6("active_minutes"))


@query("honeypot_concentration", IP_SQL + """, ranked AS (SELECT total_events, row_number() OVER (ORDER BY total_events DESC, source_ip) AS r FROM ips)
 SELECT n AS top_n, CAST(sum(total_events) FILTER (r <= n) AS BIGINT) AS events, round(sum(total_events) FILTER (r <= n) / sum(total_events)::DOUBLE * 100, 6) AS share_pct
 FROM ranked, (VALUES (1), (10), (100)) t(n) GROUP BY 1""")
def honeypot_concentration(spark, sf):
    return windows.concentration(windows.ip_summary(honeypot(spark, sf))).withColumn("share_pct", F.round("share_pct", 6))


@query("honeypot_sessions", HONEY_SQL + """ SELECT session_id, arg_min(ip, {'t': ts, 'i': ip}) FILTER (ip IS NOT NULL) AS source_ip, epoch_us(min(ts)) AS first_us, count(*) AS event_count,
 count(*) FILTER (is_login) AS login_events, coalesce(string_agg(DISTINCT CASE WHEN is_login THEN username END, ', ' ORDER BY CASE WHEN is_login THEN username END), '') AS usernames, max(is_root_login::INT) AS has_root_login,
 round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE, 6) AS duration_seconds FROM hp WHERE session_id IS NOT NULL GROUP BY 1""")
def honeypot_sessions(spark, sf):
    return windows.session_summary(honeypot(spark, sf)).select(
        "session_id", "source_ip", F.unix_micros("first_seen").alias("first_us"), "event_count", "login_events", "usernames",
        "has_root_login", *r6("duration_seconds"))


# ---- exploration ----------------------------------------------------------------

@query("log_null_counts", PARSE_SQL + """ SELECT count(*) - count(username) AS username, count(*) - count(source_ip) AS source_ip, count(*) - count(source_port) AS source_port FROM parsed""")
def log_null_counts(spark, sf):
    return parsed_log(spark, sf).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("username", "source_ip", "source_port")])


@query("failed_attempts_by_ip", PARSE_SQL + " SELECT source_ip, CAST(sum(event_count) AS BIGINT) AS failed_attempts, count(DISTINCT username) AS distinct_users FROM parsed WHERE event_type='failed_login' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def failed_attempts_by_ip(spark, sf):
    return (parsed_log(spark, sf).where("event_type = 'failed_login'").groupBy("source_ip")
            .agg(F.sum("event_count").alias("failed_attempts"), F.count_distinct("username").alias("distinct_users"))
            .orderBy(F.desc("failed_attempts"), "source_ip").limit(10))


@query("top_log_users", PARSE_SQL + " SELECT username, count(*) AS events, count(DISTINCT source_ip) AS source_ips FROM parsed WHERE username IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_log_users(spark, sf):
    return (parsed_log(spark, sf).where("username IS NOT NULL").groupBy("username").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("source_ip").alias("source_ips"))
            .orderBy(F.desc("events"), "username").limit(10))


@query("failures_per_minute", PARSE_SQL + " SELECT CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute_s, CAST(sum(event_count) AS BIGINT) AS failures FROM parsed WHERE event_type='failed_login' GROUP BY 1")
def failures_per_minute(spark, sf):
    return (parsed_log(spark, sf).where("event_type = 'failed_login'")
            .groupBy(F.unix_seconds(F.date_trunc("minute", "timestamp")).alias("minute_s")).agg(F.sum("event_count").alias("failures")))


# ---- sensor and drive assessments ---------------------------------------------------

def readings(spark, sf):
    e = load(spark, sf, "events").withColumn("k", B.k_value())
    return e.select("event_id", F.concat(F.lit("SENSOR-"), F.expr("user_id div 10")).alias("source_id"), F.col("ts").alias("timestamp"),
                    F.when(F.col("k") % 11 != 0, F.col("value")).alias("temperature_c"),
                    F.when(F.col("k") % 22 != 0, F.col("k").cast("double") * 1.02).alias("humidity_pct"),
                    F.expr("CASE WHEN k < 5 THEN 'n/a' WHEN k < 10 THEN 'NaN' WHEN k < 15 THEN 'Infinity' ELSE cast(value as string) END").alias("raw"))


READINGS_SQL = f"""readings AS (SELECT event_id, 'SENSOR-' || (user_id // 10) AS source_id, ts, {B.K_SQL} AS k,
 CASE WHEN {B.K_SQL} % 11 <> 0 THEN value END AS temperature_c, CASE WHEN {B.K_SQL} % 22 <> 0 THEN {B.K_SQL}::DOUBLE * 1.02::DOUBLE END AS humidity_pct,
 CASE WHEN {B.K_SQL} < 5 THEN 'n/a' WHEN {B.K_SQL} < 10 THEN 'NaN' WHEN {B.K_SQL} < 15 THEN 'Infinity' ELSE CAST(value AS VARCHAR) END AS raw FROM events)"""
ENV_SQL = "WITH " + READINGS_SQL + """, env AS (SELECT *, (temperature_c IS NULL AND humidity_pct IS NULL) OR coalesce(humidity_pct < 0 OR humidity_pct > 100, false) AS invalid,
 concat_ws(',', CASE WHEN temperature_c > 35 THEN 'HIGH_TEMPERATURE' END, CASE WHEN humidity_pct > 80 THEN 'HIGH_HUMIDITY' END, CASE WHEN humidity_pct < 20 THEN 'LOW_HUMIDITY' END) AS fired FROM readings)"""


@query("environment_assessment", ENV_SQL + """ SELECT event_id, CASE WHEN invalid THEN '' ELSE fired END AS conditions,
 CASE WHEN invalid THEN 'INVALID' WHEN fired <> '' THEN string_split(fired, ',')[1] ELSE 'NORMAL' END AS assessment, NOT invalid AND fired <> '' AS anomaly_detected FROM env""")
def environment_assessment(spark, sf):
    return assess.assess_environment(readings(spark, sf)).select("event_id", F.array_join("conditions", ",").alias("conditions"),
                                                                 "assessment", "anomaly_detected")


@query("finite_measurements", "WITH " + READINGS_SQL + " SELECT event_id, CASE WHEN isfinite(TRY_CAST(raw AS DOUBLE)) THEN TRY_CAST(raw AS DOUBLE) END AS measurement FROM readings")
def finite_measurements(spark, sf):
    return readings(spark, sf).select("event_id", assess.finite_measurement(F.col("raw")).alias("measurement"))


@query("condition_error_summary", ENV_SQL + """, a AS (SELECT CASE WHEN invalid THEN 'INVALID' WHEN fired <> '' THEN string_split(fired, ',')[1] ELSE 'NORMAL' END AS category, temperature_c FROM env)
 SELECT category, count(*) AS windows, round(avg(temperature_c), 6) AS mean_error, round(quantile_cont(temperature_c, 0.5), 6) AS median_error, count(*) FILTER (temperature_c > 100) AS anomalous FROM a GROUP BY 1""")
def condition_error_summary(spark, sf):
    a = assess.assess_environment(readings(spark, sf)).withColumnRenamed("assessment", "category")
    base = a.groupBy("category").agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg("temperature_c"), 6).alias("mean_error"),
                                     F.count_if(F.col("temperature_c") > 100).alias("anomalous"))
    med = ranks.percentiles(a, ["category"], "temperature_c", {"median_error": 0.5}).select("category", *r6("median_error"))
    return base.join(med, "category", "left")
