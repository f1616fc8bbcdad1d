"""Evaluation queries: detector metrics, curves, agreement, resampling, dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchfold.operators import assess, bayes, metrics as M, validate as V
from watchfold.plans import bindings as B
from watchfold.plans.auth import VOTED_SQL, r6, secs, voted
from watchfold.plans.pairs import ABN_SQL, CAND_SQL, CLEARED_SQL, DOMAIN_SQL, NODES, candidates
from watchfold.plans.registry import query
from watchfold.sources.tables import load

SC = "WITH " + B.SCORED_SQL
RATES = ["accuracy", "precision", "recall", "f1", "specificity", "fpr", "fnr", "balanced_accuracy"]
METRICS_SQL = """SELECT {by} detector, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS fpr, round(fn / nullif(fn + tp, 0)::DOUBLE, 6) AS fnr,
 round((coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0)) / 2, 6) AS balanced_accuracy FROM cf"""
DETECTORS = {"low": 0.3, "mid": 0.5, "high": 0.8}
CF = lambda by="": ", cf AS (" + " UNION ALL ".join(
    f"SELECT {by} '{d}' AS detector, count(*) FILTER (probability >= {t} AND y = 1) AS tp, count(*) FILTER (probability >= {t} AND y = 0) AS fp, count(*) FILTER (probability < {t} AND y = 1) AS fn, count(*) FILTER (probability < {t} AND y = 0) AS tn FROM scored"
    + (" GROUP BY " + by.rstrip(", ") if by else "") for d, t in DETECTORS.items()) + ") "


def flagged(spark, sf):
    return B.scored(spark, sf).withColumns({d: (F.col("probability") >= t).cast("int") for d, t in DETECTORS.items()})


@query("detector_metrics", SC + CF() + METRICS_SQL.format(by=""))
def detector_metrics(spark, sf):
    return M.binary_metrics(flagged(spark, sf), "y", list(DETECTORS)).select("detector", "tp", "fp", "fn", "tn", *r6(*RATES))


@query("per_model_metrics", SC + CF("model, ") + METRICS_SQL.format(by="model, "))
def per_model_metrics(spark, sf):
    return M.binary_metrics(flagged(spark, sf), "y", list(DETECTORS), ["model"]).select("model", "detector", "tp", "fp", "fn", "tn", *r6(*RATES))


@query("family_flag_rates", SC + " SELECT model, count(*) AS windows, " + ", ".join(f"round(avg((probability >= {t})::INT), 6) AS {d}_rate" for d, t in DETECTORS.items()) + " FROM scored GROUP BY 1")
def family_flag_rates(spark, sf):
    return M.flag_rates(flagged(spark, sf), "model", list(DETECTORS)).select("model", "windows", *r6(*[f"{d}_rate" for d in DETECTORS]))


RANK_SQL = SC + """, bs AS (SELECT {by} probability AS s, count(*) FILTER (y=1) AS pos, count(*) FILTER (y=0) AS neg FROM scored GROUP BY ALL),
 cs AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {pb} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (PARTITION BY {pb} ORDER BY s DESC) AS ap, sum(neg) OVER (PARTITION BY {pb} ORDER BY s DESC) AS an, sum(pos) OVER (PARTITION BY {pb}) AS p, sum(neg) OVER (PARTITION BY {pb}) AS n FROM bs)
 SELECT {by} round(sum(pos * (below + neg / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)::DOUBLE), 6) AS roc_auc, round(sum(pos * ap / (ap + an)::DOUBLE) / max(p)::DOUBLE, 6) AS average_precision, round(max(p) / (max(p) + max(n))::DOUBLE, 6) AS prevalence,
 round((sum(pos * ap / (ap + an)::DOUBLE) / max(p)::DOUBLE) / (max(p) / (max(p) + max(n))::DOUBLE), 6) AS pr_lift FROM cs GROUP BY ALL"""


@query("ranking_metrics", RANK_SQL.format(by="", pb="1"))
def ranking_metrics(spark, sf):
    return M.ranking_metrics(B.scored(spark, sf), "probability", "y").select(*r6("roc_auc", "average_precision", "prevalence", "pr_lift"))


@query("ranking_metrics_by_model", RANK_SQL.format(by="model, ", pb="model"))
def ranking_metrics_by_model(spark, sf):
    return M.ranking_metrics(B.scored(spark, sf), "probability", "y", ["model"]).select("model", *r6("roc_auc", "average_precision", "prevalence", "pr_lift"))


@query("alert_load", SC + """ SELECT count(*) AS rows, count(*) FILTER (probability >= 0.45) AS alerts, round(count(*) FILTER (probability >= 0.45) * 1000 / count(*)::DOUBLE, 6) AS alerts_per_1000,
 round((count(*) FILTER (probability >= 0.45 AND y=1) / count(*) FILTER (y=1)::DOUBLE + count(*) FILTER (probability < 0.45 AND y=0) / count(*) FILTER (y=0)::DOUBLE) / 2, 6) AS balanced_accuracy FROM scored""")
def alert_load(spark, sf):
    return M.alert_load(B.scored(spark, sf), "probability", "y", 0.45).select("rows", "alerts", *r6("alerts_per_1000", "balanced_accuracy"))


@query("drive_recall", SC + " SELECT count(DISTINCT serial_number) AS failed_drives, count(DISTINCT CASE WHEN probability >= 0.95 THEN serial_number END) AS drives_caught, round(count(DISTINCT CASE WHEN probability >= 0.95 THEN serial_number END) / count(DISTINCT serial_number)::DOUBLE, 6) AS drive_recall FROM scored WHERE y = 1")
def drive_recall(spark, sf):
    return M.drive_recall(B.scored(spark, sf), 0.95).withColumn("drive_recall", F.round("drive_recall", 6))


FW = """, fw AS (SELECT serial_number, min({'d': date, 'f': failure_date}) AS w FROM scored WHERE y = 1 AND probability >= 0.45 GROUP BY 1), lt AS (SELECT serial_number, w.d AS date, CAST(w.f - w.d AS INT) AS lead_time_days FROM fw)"""


@query("first_warnings", SC + FW + " SELECT serial_number, strftime(date, '%Y-%m-%d') AS date, lead_time_days FROM lt")
def first_warnings(spark, sf):
    return M.first_warnings(B.scored(spark, sf), 0.45).select("serial_number", F.date_format("date", "yyyy-MM-dd").alias("date"), "lead_time_days")


@query("lead_time", SC + FW + " SELECT count(*) AS drives, round(avg(lead_time_days), 6) AS mean_lead_days, count(*) FILTER (lead_time_days = 7) AS full_horizon_warnings, round(quantile_cont(lead_time_days, 0.5), 6) AS median_lead_days FROM lt")
def lead_time(spark, sf):
    return M.lead_time(B.scored(spark, sf), 0.45).select("drives", "full_horizon_warnings", *r6("mean_lead_days", "median_lead_days"))


@query("lead_time_distribution", SC + FW + " SELECT lead_time_days, count(*) AS drives FROM lt GROUP BY 1")
def lead_time_distribution(spark, sf):
    return M.first_warnings(B.scored(spark, sf), 0.45).groupBy("lead_time_days").agg(F.count(F.lit(1)).alias("drives"))


# Thresholds of the operating curve.
THRESHOLDS = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.80, 0.90]
CURVE_SQL = SC + ", th(t) AS (VALUES " + ",".join(f"({t}::DOUBLE)" for t in THRESHOLDS) + """), tot AS (SELECT count(*) AS total, count(DISTINCT CASE WHEN y=1 THEN serial_number END) AS failed FROM scored),
 fail AS (SELECT DISTINCT serial_number FROM scored WHERE y = 1),
 pt AS (SELECT t, count(*) FILTER (probability >= t) AS alerts, count(*) FILTER (probability >= t AND y=1) AS true_alerts, count(DISTINCT CASE WHEN probability >= t AND y=1 THEN serial_number END) AS caught, count(DISTINCT CASE WHEN probability >= t THEN serial_number END) AS flagged,
  count(DISTINCT CASE WHEN probability >= t AND serial_number IN (SELECT serial_number FROM fail) THEN serial_number END) AS ff FROM scored, th GROUP BY 1),
 fw AS (SELECT t, serial_number, min({'d': date, 'f': failure_date}) AS w FROM scored, th WHERE y = 1 AND probability >= t GROUP BY 1, 2), ld AS (SELECT t, quantile_cont(CAST(w.f - w.d AS INT), 0.5) AS med, avg(CAST(w.f - w.d AS INT)) AS mean FROM fw GROUP BY 1),
 curve AS (SELECT pt.t AS threshold, failed AS failed_drives, caught AS failed_drives_caught, round(caught / failed::DOUBLE, 6) AS drive_recall, alerts, round(alerts * 1000 / total::DOUBLE, 6) AS alerts_per_1000, round(coalesce(true_alerts / nullif(alerts, 0)::DOUBLE, 0), 6) AS row_precision, flagged AS drives_flagged,
  round(coalesce(ff / nullif(flagged, 0)::DOUBLE, 0), 6) AS drive_precision, round(med, 6) AS median_lead_days, round(mean, 6) AS mean_lead_days FROM pt CROSS JOIN tot LEFT JOIN ld ON ld.t = pt.t)"""


@query("operating_curve", CURVE_SQL + " SELECT * FROM curve")
def operating_curve(spark, sf):
    c = M.operating_curve(B.scored(spark, sf), THRESHOLDS)
    return c.select("threshold", "failed_drives", "failed_drives_caught", "alerts", "drives_flagged", *r6("drive_recall", "alerts_per_1000", "row_precision", "drive_precision", "median_lead_days", "mean_lead_days"))


@query("operating_curve_marginal", CURVE_SQL + """ SELECT threshold, round(CASE WHEN failed_drives_caught - lead(failed_drives_caught) OVER w > 0 THEN (drives_flagged - lead(drives_flagged) OVER w) / (failed_drives_caught - lead(failed_drives_caught) OVER w)::DOUBLE END, 6) AS extra_checks_per_failure FROM curve WINDOW w AS (ORDER BY threshold)""")
def operating_curve_marginal(spark, sf):
    return M.marginal_cost(M.operating_curve(B.scored(spark, sf), THRESHOLDS)).withColumn("extra_checks_per_failure", F.round("extra_checks_per_failure", 6))


@query("model_population_comparison", SC + """, a AS (SELECT serial_number, date, max(probability) AS pa, max(y) AS ya FROM scored GROUP BY 1, 2), b AS (SELECT serial_number, date, max(quantity / 50.0::DOUBLE) AS pb, max(y) AS yb FROM scored WHERE model = 'F' GROUP BY 1, 2)
 SELECT count(*) AS shared_rows, count(*) FILTER (ya <> yb) AS label_conflicts, round(avg(pa), 6) AS mean_left, round(avg(pb), 6) AS mean_right, count(*) FILTER (pa >= 0.5 AND pb >= 0.5) AS both_alert FROM a JOIN b USING (serial_number, date)""")
def model_population_comparison(spark, sf):
    s = B.scored(spark, sf)
    a = s.groupBy("serial_number", "date").agg(F.max("probability").alias("pa"), F.max("y").alias("ya"))
    b = s.where("model = 'F'").groupBy("serial_number", "date").agg(F.max(F.col("quantity") / 50).alias("pb"), F.max("y").alias("yb"))
    return a.join(b, ["serial_number", "date"]).agg(F.count(F.lit(1)).alias("shared_rows"), F.count_if(F.col("ya") != F.col("yb")).alias("label_conflicts"),
                                                     F.round(F.avg("pa"), 6).alias("mean_left"), F.round(F.avg("pb"), 6).alias("mean_right"), F.count_if((F.col("pa") >= 0.5) & (F.col("pb") >= 0.5)).alias("both_alert"))


REC_T = [i / 10 for i in range(11)]
REC_SQL = SC + """, rec AS (SELECT CASE WHEN model = 'F' THEN 1 ELSE 0 END AS enrolled, y AS correct, 1 - probability AS distance FROM scored), th(t) AS (VALUES """ + ",".join(f"({t}::DOUBLE)" for t in REC_T) + """),
 g AS (SELECT t, count(*) FILTER (enrolled=1) AS known, count(*) FILTER (enrolled=0) AS unk, count(*) FILTER (enrolled=1 AND distance <= t AND correct=1) AS i, count(*) FILTER (enrolled=1 AND distance > t) AS r, count(*) FILTER (enrolled=1 AND distance <= t AND correct=0) AS m, count(*) FILTER (enrolled=0 AND distance <= t) AS fa FROM rec, th GROUP BY 1),
 sw AS (SELECT t AS threshold, i / known::DOUBLE AS ir, r / known::DOUBLE AS rr, m / known::DOUBLE AS mr, fa / unk::DOUBLE AS far, (i / known::DOUBLE + 1 - fa / unk::DOUBLE) / 2 AS br FROM g)"""


def recognition(spark, sf):
    return B.scored(spark, sf).select(F.when(F.col("model") == "F", 1).otherwise(0).alias("enrolled"), F.col("y").alias("correct"), (1 - F.col("probability")).alias("distance"))


@query("recognition_threshold_sweep", REC_SQL + " SELECT threshold, round(ir, 6) AS identification_rate, round(rr, 6) AS false_rejection_rate, round(mr, 6) AS misidentification_rate, round(far, 6) AS false_acceptance_rate, round(br, 6) AS balanced_rate FROM sw")
def recognition_threshold_sweep(spark, sf):
    return M.recognition_sweep(recognition(spark, sf), REC_T).select("threshold", *r6("identification_rate", "false_rejection_rate", "misidentification_rate", "false_acceptance_rate", "balanced_rate"))


@query("recognition_best_threshold", REC_SQL + " SELECT threshold, round(br, 6) AS balanced_rate FROM sw ORDER BY br DESC, far, threshold LIMIT 1")
def recognition_best_threshold(spark, sf):
    return M.best_threshold(M.recognition_sweep(recognition(spark, sf), REC_T)).withColumn("balanced_rate", F.round("balanced_rate", 6))


@query("abstention_threshold", SC + """, v AS (SELECT DISTINCT probability AS s FROM scored), cand AS (SELECT s FROM v UNION SELECT 0 UNION SELECT 1 UNION SELECT (s + lead(s) OVER (ORDER BY s)) / 2 FROM v),
 ba AS (SELECT cand.s AS threshold, (count(*) FILTER (probability >= cand.s AND y=1) / count(*) FILTER (y=1)::DOUBLE + count(*) FILTER (probability < cand.s AND y=0) / count(*) FILTER (y=0)::DOUBLE) / 2 AS b FROM scored, cand WHERE cand.s IS NOT NULL GROUP BY 1)
 SELECT threshold, round(b, 6) AS balanced_accuracy FROM ba ORDER BY b DESC, threshold DESC LIMIT 1""")
def abstention_threshold(spark, sf):
    return M.abstention_threshold(B.scored(spark, sf), "probability", "y").withColumn("balanced_accuracy", F.round("balanced_accuracy", 6))


# ---- agreement and rates ------------------------------------------------------------

@query("labeller_kappa", """WITH l AS (SELECT quality AS a, 1 - toxic AS b FROM labels), g AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS m, sum(a) AS a1, sum(b) AS b1 FROM l),
 e AS (SELECT n, m / n::DOUBLE AS po, (a1 * b1 + (n - a1) * (n - b1)) / (n * n)::DOUBLE AS pe FROM g) SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM e""")
def labeller_kappa(spark, sf):
    return M.cohens_kappa(load(spark, sf, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")), "a", "b").select("n", *r6("agreement", "kappa"))


@query("compliance_confusion", """WITH cf AS (SELECT 'toxic' AS detector, count(*) FILTER (toxic=1 AND quality=0) AS tp, count(*) FILTER (toxic=1 AND quality=1) AS fp, count(*) FILTER (toxic=0 AND quality=0) AS fn, count(*) FILTER (toxic=0 AND quality=1) AS tn FROM labels) """ + METRICS_SQL.format(by=""))
def compliance_confusion(spark, sf):
    l = load(spark, sf, "labels").withColumn("truth", 1 - F.col("quality"))
    return M.binary_metrics(l, "truth", ["toxic"]).select("detector", "tp", "fp", "fn", "tn", *r6(*RATES))


@query("wilson_intervals", SC + """, g AS (SELECT serial_number, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s FROM scored GROUP BY 1), p AS (SELECT *, s / n AS p, 1.96::DOUBLE * 1.96::DOUBLE AS z2 FROM g)
 SELECT serial_number, CAST(n AS BIGINT) AS n, round((p + z2 / (2 * n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 6) AS low, round((p + z2 / (2 * n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 6) AS high FROM p""")
def wilson_intervals(spark, sf):
    g = B.scored(spark, sf).groupBy("serial_number").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    low, high = M.wilson(F.col("s"), F.col("n"))
    return g.select("serial_number", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


CURVE2 = SC + """, cv AS (SELECT model, probability AS confidence, avg(y) AS f1 FROM scored GROUP BY 1, 2)"""


def class_curve(spark, sf):
    return B.scored(spark, sf).groupBy("model", F.col("probability").alias("confidence")).agg(F.avg("y").alias("f1"))


@query("curve_point_at_confidence", CURVE2 + " SELECT model, arg_min(confidence, abs(confidence - 0.47) * 1000 + confidence / 1000) AS confidence, round(arg_min(f1, abs(confidence - 0.47) * 1000 + confidence / 1000), 6) AS f1 FROM cv GROUP BY 1")
def curve_point_at_confidence(spark, sf):
    return M.nearest_on_curve(class_curve(spark, sf), "model", "confidence", 0.47).withColumn("f1", F.round("f1", 6))


@query("curve_best_confidence", CURVE2 + " SELECT model, arg_max(confidence, {'f': f1, 'c': -confidence}) AS confidence, round(max(f1), 6) AS f1 FROM cv GROUP BY 1")
def curve_best_confidence(spark, sf):
    return M.best_f1_confidence(class_curve(spark, sf), "model", "confidence", "f1").withColumn("f1", F.round("f1", 6))


@query("pair_rule_metrics", CAND_SQL + """, cf AS (SELECT 'crisp' AS detector, count(*) FILTER (crisp AND truth) AS tp, count(*) FILTER (crisp AND NOT truth) AS fp, count(*) FILTER (NOT crisp AND truth) AS fn, count(*) FILTER (NOT crisp AND NOT truth) AS tn FROM sc
 UNION ALL SELECT 'bayesian', count(*) FILTER (p >= 0.5 AND truth), count(*) FILTER (p >= 0.5 AND NOT truth), count(*) FILTER (p < 0.5 AND truth), count(*) FILTER (p < 0.5 AND NOT truth) FROM sc) """ + METRICS_SQL.format(by=""))
def pair_rule_metrics(spark, sf):
    s = bayes.score(candidates(spark, sf)).select(*[F.col(c).cast("int").alias(n) for n, c in (("truth", "truth"), ("crisp", "crisp"), ("bayesian", "correlated"))])
    return M.binary_metrics(s, "truth", ["crisp", "bayesian"]).select("detector", "tp", "fp", "fn", "tn", *r6(*RATES))


DRAWS = 2000
BOOT_SQL = CAND_SQL + f""", cell AS (SELECT scenario_id, count(*) FILTER (crisp AND truth) AS ctp, count(*) FILTER (crisp AND NOT truth) AS cfp, count(*) FILTER (NOT crisp AND truth) AS cfn, count(*) FILTER (p >= 0.5 AND truth) AS btp, count(*) FILTER (p >= 0.5 AND NOT truth) AS bfp, count(*) FILTER (p < 0.5 AND truth) AS bfn FROM sc GROUP BY 1),
 ix AS (SELECT *, row_number() OVER (ORDER BY md5(scenario_id)) - 1 AS idx, count(*) OVER () AS n FROM cell),
 pk AS (SELECT d.range AS draw, CAST('0x' || substr(md5('11|' || d.range || '|' || ix.idx), 1, 15) AS BIGINT) % n AS pick FROM ix, range(0, {DRAWS}) d),
 bs AS (SELECT draw, CAST(sum(ctp) AS BIGINT) AS ctp, CAST(sum(cfp) AS BIGINT) AS cfp, CAST(sum(cfn) AS BIGINT) AS cfn, CAST(sum(btp) AS BIGINT) AS btp, CAST(sum(bfp) AS BIGINT) AS bfp, CAST(sum(bfn) AS BIGINT) AS bfn FROM pk JOIN ix ON ix.idx = pick GROUP BY 1),
 bf AS (SELECT draw, coalesce(2 * ctp / nullif(2 * ctp + cfp + cfn, 0)::DOUBLE, 0) AS cf1, coalesce(2 * btp / nullif(2 * btp + bfp + bfn, 0)::DOUBLE, 0) AS bf1 FROM bs)"""


def bootstrap_draws(spark, sf):
    s = bayes.score(candidates(spark, sf))
    cells = s.groupBy("scenario_id").agg(*[c.alias(f"c{n}") for n, c in zip(("tp", "fp", "fn"), bayes.confusion(F.col("crisp"), F.col("truth")))],
                                         *[c.alias(f"b{n}") for n, c in zip(("tp", "fp", "fn"), bayes.confusion(F.col("correlated"), F.col("truth")))])
    d = M.cluster_bootstrap(cells, "scenario_id", DRAWS, 11, ["ctp", "cfp", "cfn", "btp", "bfp", "bfn"])
    return d.select("draw", bayes.f1(F.col("ctp"), F.col("cfp"), F.col("cfn")).alias("crisp_f1"), bayes.f1(F.col("btp"), F.col("bfp"), F.col("bfn")).alias("bayesian_f1"))


@query("bootstrap_f1_draws", BOOT_SQL + " SELECT draw, round(cf1, 6) AS crisp_f1, round(bf1, 6) AS bayesian_f1 FROM bf")
def bootstrap_f1_draws(spark, sf):
    return bootstrap_draws(spark, sf).select("draw", *r6("crisp_f1", "bayesian_f1"))


@query("bootstrap_f1_interval", BOOT_SQL + " SELECT round(quantile_cont(bf1 - cf1, 0.025), 6) AS low, round(quantile_cont(bf1 - cf1, 0.975), 6) AS high, round(avg((bf1 > cf1)::INT), 6) AS share_better FROM bf")
def bootstrap_f1_interval(spark, sf):
    d = bootstrap_draws(spark, sf).withColumn("diff", F.col("bayesian_f1") - F.col("crisp_f1"))
    return d.agg(F.round(F.percentile("diff", 0.025), 6).alias("low"), F.round(F.percentile("diff", 0.975), 6).alias("high"), F.round(F.avg((F.col("diff") > 0).cast("int")), 6).alias("share_better"))


# ---- latency and dashboards ------------------------------------------------------------

@query("route_latency", r"""WITH r AS (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', ''), '/\d+', '/{id}', 'g'), '\.\w+$', '') AS route, length(html) % 500 AS ms FROM pages)
 SELECT route, count(*) AS n, round(quantile_cont(ms, 0.5), 6) AS median, round(quantile_cont(ms, 0.95), 6) AS p95, min(ms)::INT AS min, max(ms)::INT AS max FROM r GROUP BY 1""")
def route_latency(spark, sf):
    r = load(spark, sf, "pages").select(M.route_template(F.col("url")).alias("route"), (F.length("html") % 500).alias("ms"))
    return M.latency_summary(r, "route", "ms").select("route", "n", *r6("median", "p95"), "min", "max")


@query("dashboard_states", NODES + f" SELECT coalesce(kind, 'All') AS kind, coalesce(state, 'All') AS state, count(*) AS total, count(*) FILTER ({ABN_SQL}) AS abnormal FROM nodes GROUP BY ROLLUP (kind, state)")
def dashboard_states(spark, sf):
    n = B.nodes(spark, sf).withColumn("abnormal", assess.detector_abnormal(F.col("state")))
    return n.rollup("kind", "state").agg(F.count(F.lit(1)).alias("total"), F.count_if("abnormal").alias("abnormal")).na.fill("All", ["kind", "state"])


@query("dashboard_timeline", NODES + f" SELECT strftime(ts, '%Y-%m-%d') AS day, kind, count(*) AS total, count(*) FILTER ({ABN_SQL}) AS abnormal FROM nodes GROUP BY 1, 2")
def dashboard_timeline(spark, sf):
    n = B.nodes(spark, sf).withColumn("abnormal", assess.detector_abnormal(F.col("state")))
    return n.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "kind").agg(F.count(F.lit(1)).alias("total"), F.count_if("abnormal").alias("abnormal"))


@query("dashboard_verdict_counts", NODES + CLEARED_SQL + " SELECT kind, verdict, count(*) AS n FROM lv GROUP BY 1, 2")
def dashboard_verdict_counts(spark, sf):
    from watchfold.operators.severity import latest_verdicts
    return latest_verdicts(B.verdicts(spark, sf)).groupBy("kind", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("dashboard_last_day", NODES + f" SELECT zone_id, count(*) AS abnormal_last_24h FROM nodes WHERE {ABN_SQL} AND ts > (SELECT max(ts) FROM nodes) - INTERVAL 24 HOUR GROUP BY 1")
def dashboard_last_day(spark, sf):
    n = B.nodes(spark, sf)
    latest = n.agg(F.max("ts").alias("latest"))
    return (n.where(assess.detector_abnormal(F.col("state"))).crossJoin(F.broadcast(latest)).where(F.col("ts") > F.col("latest") - F.expr("INTERVAL 24 HOURS"))
            .groupBy("zone_id").agg(F.count(F.lit(1)).alias("abnormal_last_24h")))


# ---- joins of results and labels ---------------------------------------------------------

@query("detector_result_join", VOTED_SQL + " SELECT source_ip, window_start_s, rule_prediction, if_prediction, ae_prediction FROM voted")
def detector_result_join(spark, sf):
    v = voted(spark, sf).select("source_ip", "window_start", "rule_prediction", "if_prediction", "ae_prediction")
    key = ["source_ip", "window_start"]
    parts = [v.select(*key, c) for c in ("rule_prediction", "if_prediction", "ae_prediction")]
    return V.one_to_one_join(parts, key).select("source_ip", secs("window_start"), "rule_prediction", "if_prediction", "ae_prediction")


MANIFEST_SQL = VOTED_SQL + """, man AS (SELECT source_ip, window_start_s, CASE WHEN rule_score >= 2 THEN 'ATTACK' ELSE 'NORMAL' END AS ground_truth FROM voted WHERE failed_login_count <> 7
 UNION ALL SELECT 'x' || source_ip, window_start_s, 'ATTACK' FROM voted WHERE failed_login_count = 3)"""


def manifest(spark, sf):
    v = voted(spark, sf)
    real = v.where("failed_login_count <> 7").select("source_ip", "window_start", F.when(F.col("rule_score") >= 2, "ATTACK").otherwise("NORMAL").alias("ground_truth"))
    ghost = v.where("failed_login_count = 3").select(F.concat(F.lit("x"), "source_ip").alias("source_ip"), "window_start", F.lit("ATTACK").alias("ground_truth"))
    return real.unionByName(ghost), v


@query("label_manifest_match", MANIFEST_SQL + """ SELECT coalesce(m.source_ip, f.source_ip) AS source_ip, coalesce(m.window_start_s, f.window_start_s) AS window_start_s, m.ground_truth, f.rule_prediction,
 CASE WHEN f.source_ip IS NULL THEN 'MANIFEST_ONLY' WHEN m.source_ip IS NULL THEN 'FEATURES_ONLY' ELSE 'MATCHED' END AS match_status FROM man m FULL JOIN voted f ON f.source_ip = m.source_ip AND f.window_start_s = m.window_start_s""")
def label_manifest_match(spark, sf):
    m, v = manifest(spark, sf)
    out = V.manifest_match(m, v.select("source_ip", "window_start", "rule_prediction"), ["source_ip", "window_start"])
    return out.select("source_ip", secs("window_start"), "ground_truth", "rule_prediction", "match_status")


@query("entity_split", """WITH u AS (SELECT DISTINCT user_id AS entity FROM events), p AS (SELECT entity, (CAST('0x' || substr(md5(entity || '|42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) AS u FROM u)
 SELECT entity, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split FROM p""")
def entity_split(spark, sf):
    e = load(spark, sf, "events").select(F.col("user_id").alias("entity")).distinct()
    return V.entity_split(e, "entity", 42)


_SETS = [("train", "validation"), ("train", "test"), ("validation", "test")]


@query("split_leakage", """WITH u AS (SELECT user_id AS entity, (CAST('0x' || substr(md5(user_id || '|42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) AS u FROM events), p AS (SELECT entity, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split FROM u) """ +
       " UNION ALL ".join(f"SELECT '{x}/{y}' AS pair, count(*) AS shared_entities FROM (SELECT entity FROM p WHERE split = '{x}' INTERSECT SELECT entity FROM p WHERE split = '{y}')" for x, y in _SETS))
def split_leakage(spark, sf):
    e = load(spark, sf, "events").select(F.col("user_id").alias("entity"))
    return V.split_leakage(V.entity_split(e, "entity", 42), "entity", "split", ["train", "validation", "test"])


@query("zero_variance_features", VOTED_SQL + """, lg AS (SELECT 'failed_login_count' AS feature, failed_login_count::DOUBLE AS v FROM voted UNION ALL SELECT 'unique_users', unique_users::DOUBLE FROM voted UNION ALL SELECT 'constant', 0.0 FROM voted) SELECT feature, count(DISTINCT v) AS distinct_values, count(DISTINCT v) <= 1 AS constant FROM lg GROUP BY 1""")
def zero_variance_features(spark, sf):
    return V.zero_variance(voted(spark, sf).withColumn("constant", F.lit(0.0)), ["failed_login_count", "unique_users", "constant"])
