"""Model queries on derived feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchfold.operators import drives as D, ml, validate as V
from watchfold.plans import bindings as B
from watchfold.plans.auth import features, r6, secs
from watchfold.plans.drives import HORIZON, END
from watchfold.plans.registry import query
from watchfold.session import materialize

COUNTS = ["failed_login_count", "successful_login_count", "invalid_user_count", "unique_users", "root_attempt_count"]
FEATURES = [*COUNTS, "failure_ratio", "root_attempt_ratio"]


def scaled(spark, sf):
    logged = materialize(ml.log_counts(features(spark, sf), COUNTS), "features")
    return ml.scale(logged, ml.robust_scaling(logged, FEATURES), FEATURES)


@query("robust_scaled_features", "WITH " + B.AUTH_FEATURES_SQL + ", lg AS (SELECT source_ip, window_start_s, " + ", ".join(f"ln(1 + {c}) AS {c}" for c in COUNTS) + ", failure_ratio, root_attempt_ratio FROM feat), st AS (SELECT " +
       ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, CASE WHEN quantile_cont({c}, 0.75) > quantile_cont({c}, 0.25) THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) ELSE 1 END AS s_{c}" for c in FEATURES) +
       " FROM lg) SELECT source_ip, window_start_s, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in FEATURES) + " FROM lg, st")
def robust_scaled_features(spark, sf):
    return scaled(spark, sf).select("source_ip", secs("window_start"), *[(F.round(c, 6) + 0.0).alias(c) for c in FEATURES])


def isolation_scores(spark, sf, trees=200):
    s = materialize(scaled(spark, sf).select("source_ip", "window_start", *FEATURES), "scaled")
    forest = ml.fit_isolation_forest(s, ["source_ip", "window_start"], FEATURES, trees)
    return materialize(ml.isolation_score(s, forest, FEATURES), "scores")


@query("isolation_forest")
def isolation_forest(spark, sf):
    return ml.flag_by_contamination(isolation_scores(spark, sf), 0.15).select("source_ip", secs("window_start"), F.round("anomaly_score", 6).alias("anomaly_score"), "if_prediction")


@query("contamination_sweep")
def contamination_sweep(spark, sf):
    return ml.contamination_sweep(isolation_scores(spark, sf), [0.05, 0.10, 0.15, 0.20])


@query("reconstruction_anomalies")
def reconstruction_anomalies(spark, sf):
    s = V.entity_split(scaled(spark, sf), "source_ip", 42)
    s = materialize(s.select("source_ip", "window_start", "split", *FEATURES), "scaled")
    model = ml.fit_linear_encoder(s.where("split = 'train'"), FEATURES, 3)
    scored = materialize(ml.reconstruction_error(model, s, FEATURES), "errors")
    held = scored.where("split = 'validation'")
    if held.isEmpty():
        raise ValueError("the validation split has no rows: no threshold can be set")
    return ml.flag_by_error(scored, held).select("source_ip", secs("window_start"), F.round("reconstruction_error", 6).alias("reconstruction_error"), "ae_prediction")


TEMPORAL = ["value", "value_delta_1", "value_delta_7", "value_7obs_mean", "value_7obs_range"]


def drive_rows(spark, sf):
    days = materialize(B.entity_days(spark, sf), "drive_days")  # read by the features, their block sizes and the registry
    f = D.temporal_features(days, ["value"], "value", ["value"])
    lab = D.label_drive_days(f, D.failure_registry(days), END, HORIZON)
    return materialize(lab.where("target IS NOT NULL").select("serial_number", "date", "period", "model", "target", *TEMPORAL), "drive_rows")


def fitted(spark, sf, pipeline):
    rows = drive_rows(spark, sf)
    # written once: a fit makes a pass for each imputed, indexed and sampled column, and would sample anew for each
    train = materialize(D.downsample_negatives(rows.where("period < '1999H1'"), 10).select("target", "model", *TEMPORAL), "train")
    return ml.fit_and_store(pipeline, train), rows


@query("random_forest_scores")
def random_forest_scores(spark, sf):
    model, rows = fitted(spark, sf, ml.forest_pipeline(TEMPORAL, trees=20, depth=6))
    return ml.score(model, rows, TEMPORAL).select("serial_number", F.date_format("date", "yyyy-MM-dd").alias("date"), "target", *r6("probability"))


@query("boosted_tree_scores")
def boosted_tree_scores(spark, sf):
    model, rows = fitted(spark, sf, ml.boosted_pipeline(TEMPORAL, "model", rounds=5))
    return ml.score(model, rows, TEMPORAL).select("serial_number", F.date_format("date", "yyyy-MM-dd").alias("date"), "target", *r6("probability"))


@query("forest_feature_importance")
def forest_feature_importance(spark, sf):
    model, _ = fitted(spark, sf, ml.forest_pipeline(TEMPORAL, trees=20, depth=6))
    return ml.feature_importance(spark, model, TEMPORAL)
