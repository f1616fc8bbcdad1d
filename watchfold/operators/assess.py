"""Assessment rules: detectors per window, vote fusion, sensors, drives, abnormality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchfold.operators.ranks import cumulative

# Rule thresholds of the window detector.
FAILED_LOGIN_THRESHOLD, UNIQUE_USERS_THRESHOLD, ROOT_MIN_FAILURES, ROOT_RATIO_THRESHOLD = 10, 5, 5, 0.80
# Sensor limits (all exclusive).
MAX_TEMPERATURE_C, MAX_HUMIDITY_PCT, MIN_HUMIDITY_PCT = 35.0, 80.0, 20.0
# Fixed value: drive alert threshold.
DRIVE_THRESHOLD = 0.45
# States that count as abnormal in every domain, and the physical-security additions.
ABNORMAL_STATES = ["EXPLICIT_SECURITY_EVENT", "HIGH_CONFIDENCE_ANOMALY", "ANOMALY_CANDIDATE", "AT_RISK", "ENVIRONMENTAL_ANOMALY",
                   "HIGH_TEMPERATURE", "HIGH_HUMIDITY", "LOW_HUMIDITY", "AIRFLOW_ANOMALY", "SMOKE_DETECTED", "WATER_LEAK_DETECTED",
                   "COOLING_ANOMALY", "PPE_NON_COMPLIANT"]
PHYSICAL_ABNORMAL_STATES = ["UNKNOWN_PERSON", "PPE_NON_COMPLIANT"]
# Evidence domain of each live node kind.
DOMAIN_OF_KIND = {"maintenance": "MAINTENANCE", "environment": "ENVIRONMENTAL", "ppe": "SAFETY", "face": "PHYSICAL_SECURITY",
                  "ssh": "CYBERSECURITY"}


def lookup(table: dict[str, str], key: Column) -> Column:
    """Constant map lookup as a codegen-friendly CASE."""
    expr = None
    for k, v in table.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr


def domain_of(kind: Column) -> Column:
    return lookup(DOMAIN_OF_KIND, kind)


def rule_prediction(failed_threshold: int | Column = FAILED_LOGIN_THRESHOLD) -> tuple[Column, Column]:
    """(list of triggered rules, prediction) of a feature row."""
    limit = failed_threshold if isinstance(failed_threshold, Column) else F.lit(failed_threshold)
    rules = F.array_compact(F.array(
        F.when(F.col("failed_login_count") >= limit, "REPEATED_FAILURES"),
        F.when(F.col("unique_users") >= UNIQUE_USERS_THRESHOLD, "USERNAME_ENUMERATION"),
        F.when((F.col("failed_login_count") >= ROOT_MIN_FAILURES) & (F.col("root_attempt_ratio") >= ROOT_RATIO_THRESHOLD),
               "ROOT_TARGETING")))
    prediction = F.when(F.size(rules) >= 1, "ANOMALOUS").when(F.col("breakin_warning_count") >= 1, "SUSPICIOUS").otherwise("NORMAL")
    return rules, prediction


def detect_rules(features: DataFrame, span: str = "5 minutes") -> DataFrame:
    """Feature rows plus prediction, score, rule list and evidence text."""
    rules, prediction = rule_prediction()
    has = lambda name: F.array_contains("rule_list", name)
    out = features.withColumn("rule_list", rules).withColumn("prediction", prediction)
    evidence = F.array_compact(F.array(
        F.when(has("REPEATED_FAILURES"), F.concat(F.col("failed_login_count"), F.lit(f" failed logins in {span}"))),
        F.when(has("USERNAME_ENUMERATION"), F.concat(F.col("unique_users"), F.lit(" unique usernames attempted"))),
        F.when(has("ROOT_TARGETING"),
               F.concat(F.bround(F.col("root_attempt_ratio") * 100, 0).cast("int"), F.lit("% of failed attempts targeted root"))),
        F.when(F.col("breakin_warning_count") >= 1,
               F.concat(F.col("breakin_warning_count"), F.lit(" OpenSSH break-in warning(s)")))))
    return out.withColumns({
        "rule_score": F.size("rule_list"),
        "triggered_rules": F.array_join("rule_list", "; "),
        "evidence": F.array_join(evidence, "; "),
    }).drop("rule_list")


def explicit_signal() -> Column:
    return F.col("breakin_warning_count") > 0


def fuse_votes(df: DataFrame, rule: str = "rule_prediction", forest: str = "if_prediction", encoder: str = "ae_prediction") -> DataFrame:
    """Three detector predictions to votes, confidence, combination and evidence state.

    A SUSPICIOUS rule result is no vote."""
    flags = {name: F.col(c) == "ANOMALOUS" for name, c in (("RULE", rule), ("IF", forest), ("AE", encoder))}
    votes = sum((f.cast("int") for f in flags.values()), F.lit(0))
    out = df.withColumn("votes", votes).withColumn("explicit_signal", explicit_signal())
    v, signal = F.col("votes"), F.col("explicit_signal")
    combination = F.concat_ws("+", *[F.when(f, name) for name, f in flags.items()])
    return out.withColumns({
        "confidence": F.when(v == 3, "HIGH").when(v == 2, "MEDIUM").when(v == 1, "LOW")
                       .when(signal, "EXPLICIT_SECURITY_SIGNAL").otherwise("NONE"),
        "combination": F.when(v == 0, "NONE").otherwise(combination),
        "evidence_state": F.when(signal, "EXPLICIT_SECURITY_EVENT").when(v >= 2, "HIGH_CONFIDENCE_ANOMALY")
                           .when(v == 1, "ANOMALY_CANDIDATE").otherwise("NO_ANOMALY_EVIDENCE"),
    })


def security_relevant(assessments: DataFrame) -> DataFrame:
    return assessments.where(F.col("evidence_state") != "NO_ANOMALY_EVIDENCE")


def high_priority(assessments: DataFrame) -> DataFrame:
    return assessments.where(F.col("evidence_state").isin("EXPLICIT_SECURITY_EVENT", "HIGH_CONFIDENCE_ANOMALY"))


def agreement(rule: Column, forest: Column) -> Column:
    hit = forest == "ANOMALOUS"
    return (F.when((rule == "ANOMALOUS") & hit, "BOTH_ANOMALOUS").when(rule == "ANOMALOUS", "RULE_ONLY")
            .when((rule == "SUSPICIOUS") & hit, "SUSPICIOUS_AND_IF_ANOMALOUS").when(rule == "SUSPICIOUS", "RULE_SUSPICIOUS_ONLY")
            .when(hit, "IF_ONLY").otherwise("BOTH_NORMAL"))


def threshold_sweep(features: DataFrame, thresholds: list[int]) -> DataFrame:
    """State counts per failed-login threshold in one scan: each row carries its outcome under every threshold."""
    outcomes = F.array(*[F.struct(F.lit(t).alias("threshold"), rule_prediction(t)[1].alias("prediction")) for t in thresholds])
    return (features.select(F.explode(outcomes).alias("o")).groupBy("o.threshold")
            .agg(*[F.count_if(F.col("o.prediction") == s).alias(s.lower()) for s in ("NORMAL", "SUSPICIOUS", "ANOMALOUS")],
                 F.count(F.lit(1)).alias("windows"))
            .withColumn("anomalous_pct", F.col("anomalous") / F.col("windows") * 100))


# ---- sensors and drives -------------------------------------------------------

def finite_measurement(value: Column) -> Column:
    """Number when the text is a finite number, else null."""
    v = value.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def assess_environment(readings: DataFrame) -> DataFrame:
    """Conditions per reading. All triggered conditions are kept, the first one is primary; a row
    without any measurement or with humidity outside 0..100 is INVALID."""
    t, h = F.col("temperature_c"), F.col("humidity_pct")
    fired = F.array_compact(F.array(F.when(t > MAX_TEMPERATURE_C, "HIGH_TEMPERATURE"), F.when(h > MAX_HUMIDITY_PCT, "HIGH_HUMIDITY"),
                                    F.when(h < MIN_HUMIDITY_PCT, "LOW_HUMIDITY")))
    invalid = (t.isNull() & h.isNull()) | F.coalesce((h < 0) | (h > 100), F.lit(False))
    out = readings.withColumn("conditions", F.when(invalid, F.array().cast("array<string>")).otherwise(fired))
    return out.withColumns({
        "assessment": F.when(invalid, "INVALID").when(F.size("conditions") > 0, F.col("conditions")[0]).otherwise("NORMAL"),
        "anomaly_detected": F.size("conditions") > 0,
    })


def drive_health(scored: DataFrame, threshold: float = DRIVE_THRESHOLD) -> DataFrame:
    """Latest observation per drive and its state, for all drives at once (one partial aggregate)."""
    latest = scored.groupBy("serial_number").agg(
        F.max_by(F.struct("date", "probability"), F.struct("date", "probability")).alias("o"), F.count(F.lit(1)).alias("observations"))
    return latest.select("serial_number", F.col("o.date").alias("observation_date"), F.col("o.probability").alias("failure_probability"),
                         "observations", F.when(F.col("o.probability") >= threshold, "AT_RISK").otherwise("NORMAL").alias("assessment"))


def is_abnormal(domain: Column, state: Column, authorization: Column | None = None) -> Column:
    base = F.coalesce(state.isin(*ABNORMAL_STATES), F.lit(False))
    physical = F.coalesce(state.isin(*PHYSICAL_ABNORMAL_STATES), F.lit(False))
    if authorization is not None:
        physical = physical | F.coalesce(authorization == "UNAUTHORIZED", F.lit(False))
    return base | ((domain == "PHYSICAL_SECURITY") & physical)


def detector_abnormal(state: Column) -> Column:
    """Live-node form: the authorization result is folded into the state."""
    return F.coalesce(state.isin(*ABNORMAL_STATES, "UNKNOWN_PERSON", "UNAUTHORIZED"), F.lit(False))


def evidence_independence(domain: Column, source_class: Column) -> Column:
    return (F.when(F.coalesce(domain, F.lit("")) != "ENVIRONMENTAL", "PRIMARY")
            .when(source_class == "ENVIRONMENTAL_SENSOR", "INDEPENDENT")
            .when(source_class == "HARDWARE_TELEMETRY", "RELATED_SOURCE").otherwise("UNKNOWN"))


def face_state(recognition: Column, zone_authorization: Column) -> Column:
    """A failed lookup (null or UNKNOWN authorization) is never UNAUTHORIZED."""
    return (F.when(recognition == "UNKNOWN", "UNKNOWN_PERSON")
            .when((recognition == "RECOGNIZED") & (zone_authorization == "UNAUTHORIZED"), "UNAUTHORIZED")
            .otherwise(recognition))


def placed_by_score(rows: DataFrame, group: str, score: str) -> DataFrame:
    """`rows` with `place`: one more than the number of rows of the same group with a greater score. Rows without a score or group have none.

    Scores are counted per distinct value and cumulated in ranges, so no task holds a whole group.
    """
    at = cumulative(rows.where(F.col(score).isNotNull()), [group], score, {"__n": F.count(F.lit(1))})
    places = at.select(F.col(group).alias("__group"), F.col(score).alias("__score"), (F.col("__n_total") - F.col("__n_cum") + 1).alias("place"))
    return rows.join(places, (F.col(group) == F.col("__group")) & (F.col(score) == F.col("__score")), "left").drop("__group", "__score")
