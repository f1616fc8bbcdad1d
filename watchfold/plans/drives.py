"""Drive telemetry queries: registry, labels, temporal features, sequences, sampling, inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchfold.operators import drives as D, ranks
from watchfold.plans import bindings as B
from watchfold.plans.auth import r6
from watchfold.plans.registry import query
from watchfold.sources.tables import load

END, HORIZON = "2001-08-01", 200
PERIODS = [f"{y}H{h}" for y in range(1995, 2002) for h in (1, 2)]


def label_sql(horizon: int) -> str:
    return "WITH " + B.ENTITY_DAYS_SQL + f""", reg AS (SELECT serial_number, min(date) AS failure_date, arg_min(model, date) AS failure_model FROM days WHERE failure = 1 GROUP BY 1),
lab0 AS (SELECT days.*, failure_date, CAST(failure_date - date AS INT) AS days_until_failure FROM days LEFT JOIN reg USING (serial_number)),
lab1 AS (SELECT *, CASE WHEN days_until_failure < 0 THEN 'POST_FAILURE' WHEN days_until_failure = 0 THEN 'FAILURE_DAY' WHEN days_until_failure BETWEEN 1 AND {horizon} THEN 'AT_RISK'
 WHEN date > DATE '{END}' - {horizon} THEN 'CENSORED' ELSE 'NORMAL' END AS label_state FROM lab0),
lab AS (SELECT *, CASE label_state WHEN 'NORMAL' THEN 0 WHEN 'AT_RISK' THEN 1 END AS target FROM lab1)"""


LABEL_SQL = label_sql(HORIZON)


def labelled(spark, sf, horizon=HORIZON):
    days = B.entity_days(spark, sf)
    return D.label_drive_days(days, D.failure_registry(days), END, horizon)


def d(name):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


@query("failure_registry", LABEL_SQL + " SELECT serial_number, strftime(failure_date, '%Y-%m-%d') AS failure_date, failure_model FROM reg")
def failure_registry(spark, sf):
    return D.failure_registry(B.entity_days(spark, sf)).select("serial_number", d("failure_date"), "failure_model")


@query("failure_horizon_labels", LABEL_SQL + " SELECT serial_number, strftime(date, '%Y-%m-%d') AS date, days_until_failure, label_state, target FROM lab")
def failure_horizon_labels(spark, sf):
    return labelled(spark, sf).select("serial_number", d("date"), "days_until_failure", "label_state", "target")


@query("label_split_integrity", LABEL_SQL + f""" SELECT rule, violations, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
 SELECT 'unlabelled_state_has_target' AS rule, count(*) FILTER (label_state IN ('FAILURE_DAY','CENSORED','POST_FAILURE') AND target IS NOT NULL) AS violations FROM lab
 UNION ALL SELECT 'labelled_state_without_target', count(*) FILTER (label_state IN ('NORMAL','AT_RISK') AND target IS NULL) FROM lab
 UNION ALL SELECT 'positive_outside_horizon', count(*) FILTER (target = 1 AND NOT coalesce(days_until_failure BETWEEN 1 AND {HORIZON}, false)) FROM lab
 UNION ALL SELECT 'row_after_failure_not_marked', count(*) FILTER (days_until_failure < 0 AND label_state <> 'POST_FAILURE') FROM lab)""")
def label_split_integrity(spark, sf):
    return D.split_integrity(labelled(spark, sf), HORIZON)


WEEK = 7
PERIOD_BOUNDS = [(p, f"{p[:4]}-{'01-01' if p[5] == '1' else '07-01'}", f"{p[:4]}-{'06-30' if p[5] == '1' else '12-31'}") for p in PERIODS]


@query("split_period_bounds", label_sql(WEEK) + f""", bounds(period, start_date, end_date) AS (VALUES {", ".join(f"('{p}', DATE '{a}', DATE '{b}')" for p, a, b in PERIOD_BOUNDS)}),
 g AS (SELECT period, start_date, end_date, count(date) AS rows, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (date NOT BETWEEN start_date AND end_date) AS rows_out_of_bounds,
  count(*) FILTER (label_state IN ('FAILURE_DAY','CENSORED','POST_FAILURE') AND target IS NOT NULL) AS unlabelled_with_target,
  count(*) FILTER (label_state = 'AT_RISK' AND NOT coalesce(target = 1 AND days_until_failure BETWEEN 1 AND {WEEK}, false)) AS positive_outside_horizon,
  count(*) FILTER (label_state = 'NORMAL' AND NOT coalesce(target = 0, false)) AS normal_with_other_target FROM bounds LEFT JOIN lab USING (period) GROUP BY ALL)
 SELECT g.* REPLACE (strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date, strftime(first_date, '%Y-%m-%d') AS first_date, strftime(last_date, '%Y-%m-%d') AS last_date),
  CASE WHEN g.first_date = g.start_date AND g.last_date = g.end_date AND rows_out_of_bounds + unlabelled_with_target + positive_outside_horizon + normal_with_other_target = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM g""")
def split_period_bounds(spark, sf):
    """Every half-year at the surveyed horizon of seven days, against the bounds that its name states."""
    bounds = spark.createDataFrame(PERIOD_BOUNDS, "period string, a string, b string").select("period", F.to_date("a").alias("start_date"), F.to_date("b").alias("end_date"))
    found = D.period_integrity(labelled(spark, sf, WEEK), bounds, WEEK)
    dates = ["start_date", "end_date", "first_date", "last_date"]
    return found.select(*[d(c) if c in dates else c for c in found.columns])


@query("drive_inventory", LABEL_SQL + """ SELECT model, period, count(*) AS drive_days, count(DISTINCT serial_number) AS drives, count(*) FILTER (failure = 1) AS failure_rows,
 count(DISTINCT CASE WHEN failure = 1 THEN serial_number END) AS failed_drives FROM days GROUP BY 1, 2""")
def drive_inventory(spark, sf):
    days = B.entity_days(spark, sf)
    return D.inventory(days, D.failure_registry(days))


INV_SQL = LABEL_SQL + """, inv AS (SELECT model, period, count(*) AS drive_days, count(DISTINCT serial_number) AS drives, count(DISTINCT CASE WHEN failure = 1 THEN serial_number END) AS failed_drives FROM days GROUP BY 1, 2)"""


@query("drive_candidate_summary", INV_SQL + " SELECT model, CAST(sum(drive_days) AS BIGINT) AS drive_days, max(drives) AS max_drives, CAST(sum(failed_drives) AS BIGINT) AS failed_drives, count(*) FILTER (failed_drives > 0) AS periods_with_failures FROM inv GROUP BY 1")
def drive_candidate_summary(spark, sf):
    return D.candidate_summary(drive_inventory(spark, sf))


@query("failed_drives_by_period", INV_SQL + " SELECT model, " + ", ".join(f"CAST(coalesce(sum(failed_drives) FILTER (period='{p}'), 0) AS BIGINT) AS \"{p}\"" for p in PERIODS) + " FROM inv GROUP BY 1")
def failed_drives_by_period(spark, sf):
    return D.failed_by_period(drive_inventory(spark, sf), PERIODS)


COVERAGE_SQL = "WITH " + B.ENTITY_DAYS_SQL + """, wide AS (SELECT period, model, count(*) AS rows, count(value) AS value, count(priority) AS priority, count(CASE WHEN failure = 1 THEN 1 END) AS failed FROM days GROUP BY 1, 2),
cov AS (SELECT period, model, 'value' AS "column", rows, value AS non_null FROM wide UNION ALL SELECT period, model, 'priority', rows, priority FROM wide UNION ALL SELECT period, model, 'failed', rows, failed FROM wide)"""


def coverage_rows(spark, sf):
    days = B.entity_days(spark, sf).withColumn("failed", F.when(F.col("failure") == 1, 1))
    return D.coverage(days, ["period", "model"], ["value", "priority", "failed"])


@query("column_coverage", COVERAGE_SQL + ' SELECT period, model, "column", rows, non_null, round(non_null / rows::DOUBLE, 6) AS coverage FROM cov')
def column_coverage(spark, sf):
    return coverage_rows(spark, sf).withColumn("coverage", F.round("coverage", 6))


@query("column_coverage_summary", COVERAGE_SQL + ' SELECT "column", round(min(non_null / rows::DOUBLE), 6) AS min_coverage, round(avg(non_null / rows::DOUBLE), 6) AS mean_coverage, min(non_null / rows::DOUBLE) >= 0.95 AS usable FROM cov GROUP BY 1')
def column_coverage_summary(spark, sf):
    return D.coverage_summary(coverage_rows(spark, sf)).select("column", *r6("min_coverage", "mean_coverage"), "usable")


VAR_SQL = "WITH " + B.ENTITY_DAYS_SQL + """, long AS (SELECT model, period, 'value' AS "column", value::DOUBLE AS v FROM days UNION ALL SELECT model, period, 'failure', failure::DOUBLE FROM days),
stats AS (SELECT model, period, "column", count(*) AS rows, count(v) AS non_null, count(DISTINCT v) AS distinct_values, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max FROM long GROUP BY 1, 2, 3)"""


def variance_rows(spark, sf):
    return D.variance_statistics(B.entity_days(spark, sf), ["model", "period"], ["value", "failure"])


@query("variance_statistics", VAR_SQL + ' SELECT model, period, "column", rows, non_null, distinct_values, round(mean, 4) AS mean, round(std, 4) AS std, round(min, 4) AS min, round(max, 4) AS max FROM stats')
def variance_statistics(spark, sf):
    return variance_rows(spark, sf).select("model", "period", "column", "rows", "non_null", "distinct_values",
                                           *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")])


@query("variance_summary", VAR_SQL + ' SELECT "column", round(min(std), 4) AS min_std, round(quantile_cont(std, 0.5), 4) AS median_std, bool_or(distinct_values <= 1) AS constant_somewhere FROM stats GROUP BY 1')
def variance_summary(spark, sf):
    return D.variance_summary(variance_rows(spark, sf)).select("column", *[F.round(c, 4).alias(c) for c in ("min_std", "median_std")], "constant_somewhere")


@query("normal_vs_at_risk", LABEL_SQL + """, long AS (SELECT label_state, 'value' AS "column", value::DOUBLE AS v FROM lab WHERE label_state IN ('NORMAL','AT_RISK') UNION ALL
 SELECT label_state, 'failure', failure::DOUBLE FROM lab WHERE label_state IN ('NORMAL','AT_RISK'))
 SELECT label_state, "column", round(avg(v), 4) AS mean, round(count(*) FILTER (v <> 0) / count(v)::DOUBLE * 100, 6) AS nonzero_pct, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.95), 4) AS p95 FROM long GROUP BY 1, 2""")
def normal_vs_at_risk(spark, sf):
    out = D.class_contrast(labelled(spark, sf), ["value", "failure"])
    return out.select("label_state", "column", *[F.round(c, 4).alias(c) for c in ("mean", "median", "p95")], *r6("nonzero_pct"))


@query("median_before_failure", LABEL_SQL + f" SELECT days_until_failure, count(value) AS n, round(quantile_cont(value, 0.5), 4) AS median FROM lab WHERE days_until_failure BETWEEN 0 AND {HORIZON} AND value IS NOT NULL GROUP BY 1")
def median_before_failure(spark, sf):
    return D.value_before_failure(labelled(spark, sf), "value", HORIZON).select("days_until_failure", "n", F.round("median", 4).alias("median"))


TEMPORAL_SQL = "WITH " + B.ENTITY_DAYS_SQL + """, w AS (SELECT *, value - lag(value) OVER s AS value_delta_1, value - lag(value, 7) OVER s AS value_delta_7,
 count(value) OVER r AS c7, avg(value) OVER r AS m7, max(value) OVER r AS x7, min(value) OVER r AS n7 FROM days
 WINDOW s AS (PARTITION BY serial_number ORDER BY date), r AS (PARTITION BY serial_number ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


def temporal(spark, sf, **kw):
    return D.temporal_features(B.entity_days(spark, sf), ["value"], "value", ["value"], **kw)


@query("row_lag_deltas", TEMPORAL_SQL + " SELECT serial_number, strftime(date, '%Y-%m-%d') AS date, round(value_delta_1, 4) AS value_delta_1, round(value_delta_7, 4) AS value_delta_7 FROM w")
def row_lag_deltas(spark, sf):
    return temporal(spark, sf).select("serial_number", d("date"), *[F.round(c, 4).alias(c) for c in ("value_delta_1", "value_delta_7")])


ROLL = ["value_7obs_mean", "value_7obs_max", "value_7obs_min", "value_7obs_range", "value_vs_7obs_mean"]


@query("rolling_observations", TEMPORAL_SQL + """ SELECT serial_number, strftime(date, '%Y-%m-%d') AS date, round(CASE WHEN c7 >= 2 THEN m7 END, 5) AS value_7obs_mean, round(CASE WHEN c7 >= 2 THEN x7 END, 5) AS value_7obs_max,
 round(CASE WHEN c7 >= 2 THEN n7 END, 5) AS value_7obs_min, round(CASE WHEN c7 >= 2 THEN x7 - n7 END, 5) AS value_7obs_range, round(CASE WHEN c7 >= 2 THEN value - m7 END, 5) AS value_vs_7obs_mean FROM w""")
def rolling_observations(spark, sf):
    return temporal(spark, sf).select("serial_number", d("date"), *[F.round(c, 5).alias(c) for c in ROLL])


@query("health_flags", TEMPORAL_SQL + " SELECT serial_number, strftime(date, '%Y-%m-%d') AS date, (coalesce(value, 0) > 0)::INT AS value_nonzero, (coalesce(value_delta_1, 0) > 0)::INT AS value_increased FROM w")
def health_flags(spark, sf):
    return temporal(spark, sf).select("serial_number", d("date"), "value_nonzero", "value_increased")


@query("current_period_features", TEMPORAL_SQL + " SELECT serial_number, strftime(date, '%Y-%m-%d') AS date, round(value_delta_7, 4) AS value_delta_7 FROM w WHERE period = '1998H1'")
def current_period_features(spark, sf):
    """Windows run over all periods, so a new period sees its history; only its own rows come out."""
    return temporal(spark, sf).where("period = '1998H1'").select("serial_number", d("date"), F.round("value_delta_7", 4).alias("value_delta_7"))


# ---- sequences ---------------------------------------------------------------------

LENGTH, CHANNELS = 5, ["mean_value", "n"]


def daily(spark, sf):
    e = load(spark, sf, "events")
    return (e.groupBy(F.col("user_id").alias("serial_number"), F.to_date("ts").alias("date"))
            .agg(F.round(F.avg("value"), 4).alias("mean_value"), F.count(F.lit(1)).alias("n"))
            .withColumn("target", F.when(F.col("n") < 6, (F.col("mean_value") > 60).cast("int"))))


def seqs(spark, sf):
    return D.sequences(daily(spark, sf), CHANNELS, LENGTH)


SEQ_SQL = """WITH daily0 AS (SELECT user_id AS serial_number, CAST(ts AS DATE) AS date, round(avg(value), 4) AS mean_value, count(*) AS n FROM events GROUP BY 1, 2),
daily AS (SELECT *, CASE WHEN n < 6 THEN (mean_value > 60)::INT END AS target FROM daily0),
st AS (SELECT *, coalesce((date - lag(date) OVER (PARTITION BY serial_number ORDER BY date) = 1)::INT, 0) AS step FROM daily),
sq AS (SELECT *, sum(step) OVER (PARTITION BY serial_number ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS steps,
 list(mean_value) OVER (PARTITION BY serial_number ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS vals,
 list(n) OVER (PARTITION BY serial_number ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ns FROM st),
el AS (SELECT * FROM sq WHERE steps = 4 AND target IS NOT NULL)"""


@query("eligible_sequences", SEQ_SQL + " SELECT serial_number, strftime(date, '%Y-%m-%d') AS date, target FROM el")
def eligible_sequences(spark, sf):
    return seqs(spark, sf).select("serial_number", d("date"), "target")


@query("materialised_sequences", SEQ_SQL + " SELECT serial_number, strftime(date, '%Y-%m-%d') AS date, len(vals) AS rows, round(list_sum(vals), 5) AS channel_sum, CAST(list_sum(ns) AS DOUBLE) AS count_sum, round(vals[1], 4) AS first_value FROM el")
def materialised_sequences(spark, sf):
    total = lambda i: F.aggregate("sequence", F.lit(0.0), lambda acc, row: acc + row[i])
    return seqs(spark, sf).select("serial_number", d("date"), F.size("sequence").alias("rows"), F.round(total(0), 5).alias("channel_sum"),
                                  total(1).alias("count_sum"), F.round(F.col("sequence")[0][0], 4).alias("first_value"))


@query("sequence_endpoint_lookup", SEQ_SQL + """ SELECT d.serial_number, strftime(d.date, '%Y-%m-%d') AS date, count(el.date) AS matches,
 CASE count(el.date) WHEN 1 THEN 'OK' WHEN 0 THEN 'MISSING' ELSE 'DUPLICATE' END AS status FROM daily d LEFT JOIN el ON el.serial_number = d.serial_number AND el.date = d.date WHERE d.target = 1 GROUP BY 1, 2""")
def sequence_endpoint_lookup(spark, sf):
    wanted = daily(spark, sf).where("target = 1").select("serial_number", "date")
    return D.endpoint_lookup(wanted, seqs(spark, sf)).select("serial_number", d("date"), "matches", "status")


STATS_SQL = SEQ_SQL + """, long AS (SELECT 'mean_value' AS channel, CASE WHEN mean_value >= 0 THEN ln(1 + mean_value) END AS v FROM daily UNION ALL SELECT 'n', n::DOUBLE FROM daily),
stats AS (SELECT channel, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75,
 CASE WHEN quantile_cont(v, 0.75) > quantile_cont(v, 0.25) THEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) ELSE 1.0 END AS scale, 1 - count(v) / count(*)::DOUBLE AS missing_rate FROM long GROUP BY 1)"""


def channel_stats(spark, sf):
    return D.robust_statistics(daily(spark, sf), CHANNELS, ["mean_value"])


@query("robust_channel_statistics", STATS_SQL + " SELECT channel, round(median, 6) AS median, round(q25, 6) AS q25, round(q75, 6) AS q75, round(scale, 6) AS scale, round(missing_rate, 6) AS missing_rate FROM stats")
def robust_channel_statistics(spark, sf):
    return channel_stats(spark, sf).select("channel", *r6("median", "q25", "q75", "scale", "missing_rate"))


@query("normalised_sequences", STATS_SQL + """, sm AS (SELECT max(median) FILTER (channel='mean_value') AS m, max(scale) FILTER (channel='mean_value') AS s FROM stats)
 SELECT serial_number, strftime(date, '%Y-%m-%d') AS date, round(greatest(-10, least(10, (ln(1 + vals[5]) - m) / s)), 5) AS last_scaled FROM el, sm""")
def normalised_sequences(spark, sf):
    n = D.normalise_sequences(seqs(spark, sf), channel_stats(spark, sf), CHANNELS, ["mean_value"])
    return n.select("serial_number", d("date"), F.round(F.col("sequence")[LENGTH - 1][0], 5).alias("last_scaled"))


# ---- sampling ------------------------------------------------------------------------

RATIO = 3
SAMPLE_SQL = LABEL_SQL + f""", pop AS (SELECT *, CAST('0x' || substr(md5(serial_number || '|' || strftime(date, '%Y-%m-%d') || '|42'), 1, 15) AS BIGINT) AS pos FROM lab WHERE target IS NOT NULL),
cnt AS (SELECT period, count(*) FILTER (target = 0) AS available, count(*) FILTER (target = 1) AS positives FROM pop GROUP BY 1),
goal AS (SELECT *, sum(positives) OVER () * {RATIO} AS goal, sum(available) OVER () AS all_av, period = max(period) OVER () AS last FROM cnt),
shr AS (SELECT *, least(CAST(round_even(goal * (available / all_av::DOUBLE), 0) AS BIGINT), available) AS share FROM goal),
quota AS (SELECT period, greatest(CASE WHEN last THEN least(goal - coalesce(sum(share) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), available) ELSE share END, 0) AS quota FROM shr),
neg AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY pos) AS rn FROM pop WHERE target = 0)"""


@query("negative_downsampling", SAMPLE_SQL + " SELECT serial_number, strftime(date, '%Y-%m-%d') AS date, period, target FROM pop WHERE target = 1 UNION ALL SELECT serial_number, strftime(date, '%Y-%m-%d'), neg.period, target FROM neg JOIN quota ON quota.period = neg.period WHERE rn <= quota")
def negative_downsampling(spark, sf):
    return D.downsample_negatives(labelled(spark, sf), RATIO).select("serial_number", d("date"), "period", "target")


@query("drive_history_contract", "WITH " + B.ENTITY_DAYS_SQL + """, g AS (SELECT serial_number, count(*) AS rows, count(DISTINCT date) AS dates, count(*) FILTER (value < 0) AS bad_values FROM days GROUP BY 1)
 SELECT serial_number, rows, dates, bad_values, concat_ws(',', CASE WHEN rows < 8 THEN 'TOO_FEW_ROWS' END, CASE WHEN rows > 10000 THEN 'TOO_MANY_ROWS' END, CASE WHEN rows <> dates THEN 'DUPLICATE_DATES' END, CASE WHEN bad_values > 0 THEN 'INVALID_VALUES' END) AS errors,
 rows >= 8 AND rows <= 10000 AND rows = dates AND bad_values = 0 AS valid FROM g""")
def drive_history_contract(spark, sf):
    return D.drive_history_contract(B.entity_days(spark, sf), ["value"])
