"""Evaluation metrics: confusion, ranking curves, operating curves, queues, agreement, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from watchfold.functions.ids import short_sha
from watchfold.operators import ranks
from watchfold.session import materialize


def div(a: Column, b: Column, empty=0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def binary_metrics(df: DataFrame, truth: str, detectors: list[str], by: list[str] | None = None) -> DataFrame:
    """Confusion counts and rates of 0/1 detector columns, all detectors in one pass. 0/0 gives 0 for
    precision, recall and F1, null for the rates of an empty class."""
    by = by or []
    wide = df.groupBy(*by).agg(*[F.count_if((F.col(d) == p) & (F.col(truth) == t)).alias(f"{d}__{name}")
                                 for d in detectors for name, p, t in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))])
    cells = F.array(*[F.struct(F.lit(d).alias("detector"), *[F.col(f"{d}__{n}").alias(n) for n in ("tp", "fp", "fn", "tn")]) for d in detectors])
    c = wide.select(*by, F.inline(cells))
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    p, r = div(tp, tp + fp), div(tp, tp + fn)
    return c.select(*by, "detector", "tp", "fp", "fn", "tn", div(tp + tn, tp + fp + fn + tn).alias("accuracy"), p.alias("precision"), r.alias("recall"),
                    div(2 * p * r, p + r).alias("f1"), div(tn, tn + fp, None).alias("specificity"), div(fp, fp + tn, None).alias("fpr"),
                    div(fn, fn + tp, None).alias("fnr"), ((r + div(tn, tn + fp)) / 2).alias("balanced_accuracy"))


def flag_rates(df: DataFrame, family: str, detectors: list[str]) -> DataFrame:
    """Share of flagged rows per scenario family, one column per detector."""
    return df.groupBy(family).agg(F.count(F.lit(1)).alias("windows"), *[F.avg(F.col(d).cast("double")).alias(f"{d}_rate") for d in detectors])


def ranking_counts(df: DataFrame, score: str, truth: str, by: list[str] | None = None) -> DataFrame:
    """Per distinct score: positives and negatives with running and total sums (score ascending)."""
    return ranks.cumulative(df, by or [], score, {"pos": F.count_if(F.col(truth) == 1), "neg": F.count_if(F.col(truth) == 0)})


def ranking_metrics(df: DataFrame, score: str, truth: str, by: list[str] | None = None) -> DataFrame:
    """ROC-AUC (a tie counts one half) and average precision grouped by threshold."""
    by = by or []
    c = ranking_counts(df, score, truth, by)
    below = F.col("neg_cum") - F.col("neg")
    above_pos, above_neg = F.col("pos_total") - F.col("pos_cum") + F.col("pos"), F.col("neg_total") - F.col("neg_cum") + F.col("neg")
    sums = c.groupBy(*by).agg(
        F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("wins"), F.max("pos_total").alias("p"), F.max("neg_total").alias("n"),
        F.sum(F.col("pos") * div(above_pos, above_pos + above_neg)).alias("ap_sum"))
    prevalence = F.col("p") / (F.col("p") + F.col("n"))
    ap = div(F.col("ap_sum"), F.col("p"))
    return sums.select(*by, div(F.col("wins"), F.col("p") * F.col("n")).alias("roc_auc"), ap.alias("average_precision"), prevalence.alias("prevalence"),
                       div(ap, prevalence).alias("pr_lift"))


def alert_load(df: DataFrame, score: str, truth: str, threshold: float) -> DataFrame:
    flag = F.col(score) >= threshold
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(flag).alias("alerts"), (F.count_if(flag) * 1000 / F.count(F.lit(1))).alias("alerts_per_1000"),
                  ((div(F.count_if(flag & (F.col(truth) == 1)), F.count_if(F.col(truth) == 1)) +
                    div(F.count_if(~flag & (F.col(truth) == 0)), F.count_if(F.col(truth) == 0))) / 2).alias("balanced_accuracy"))


# ---- drives ------------------------------------------------------------------------

def drive_recall(scored: DataFrame, threshold: float) -> DataFrame:
    """Failing drives with at least one alert inside the horizon: one row per drive first."""
    d = scored.where("y = 1").groupBy("serial_number").agg(F.max("probability").alias("top"))
    return d.agg(F.count(F.lit(1)).alias("failed_drives"), F.count_if(F.col("top") >= threshold).alias("drives_caught")) \
            .withColumn("drive_recall", div(F.col("drives_caught"), F.col("failed_drives")))


def first_warnings(scored: DataFrame, threshold: float) -> DataFrame:
    """First true alert per drive and its lead time in days."""
    first = scored.where((F.col("y") == 1) & (F.col("probability") >= threshold)).groupBy("serial_number").agg(
        F.min(F.struct("date", "failure_date")).alias("w"))
    return first.select("serial_number", F.col("w.date").alias("date"), F.datediff("w.failure_date", "w.date").alias("lead_time_days"))


def lead_time(scored: DataFrame, threshold: float, horizon: int = 7) -> DataFrame:
    f = first_warnings(scored, threshold)
    base = f.agg(F.count(F.lit(1)).alias("drives"), F.avg("lead_time_days").alias("mean_lead_days"), F.count_if(F.col("lead_time_days") == horizon).alias("full_horizon_warnings"))
    return base.crossJoin(ranks.percentiles(f, [], "lead_time_days", {"median_lead_days": 0.5}).drop("n"))


def operating_curve(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """All thresholds from one pass: a row falls into the highest threshold it reaches, and the
    at most len(thresholds) + 1 bucket sums are cumulated from above."""
    ts = sorted(thresholds)
    bucket = sum((F.when(F.col("probability") >= t, 1).otherwise(0) for t in ts), F.lit(0))
    levels = scored.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(ts)], "level int, threshold double")
    rows = scored.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    per_drive = scored.groupBy("serial_number").agg(F.max(bucket).alias("any_bucket"), F.max(F.when(F.col("y") == 1, bucket)).alias("true_bucket"))
    drives = per_drive.groupBy("any_bucket", "true_bucket").agg(F.count(F.lit(1)).alias("drives"))
    row_sums = levels.join(rows, F.col("bucket") >= F.col("level"), "left").groupBy("level").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("alerts"), F.coalesce(F.sum("pos"), F.lit(0)).alias("true_alerts"))
    at = lambda c: F.coalesce(F.sum(F.when(c, F.col("drives"))), F.lit(0))
    drive_sums = levels.join(drives, F.lit(True), "left").groupBy("level").agg(
        at(F.col("true_bucket").isNotNull()).alias("failed_drives"), at(F.col("true_bucket") >= F.col("level")).alias("failed_drives_caught"),
        at(F.col("any_bucket") >= F.col("level")).alias("drives_flagged"),
        at((F.col("any_bucket") >= F.col("level")) & F.col("true_bucket").isNotNull()).alias("flagged_failing"))
    reached = F.explode(F.sequence(F.lit(1), F.col("__b")))
    warned = (scored.where("y = 1").withColumn("__b", bucket).where("__b >= 1")
              .groupBy("serial_number", "__b").agg(F.min(F.struct("date", "failure_date")).alias("w"))
              .select("serial_number", "w", reached.alias("level")).groupBy("serial_number", "level").agg(F.min("w").alias("w"))
              .select("level", F.datediff("w.failure_date", "w.date").alias("lead")))
    leads = warned.groupBy("level").agg(F.percentile("lead", 0.5).alias("median_lead_days"), F.avg("lead").alias("mean_lead_days"))
    total = scored.agg(F.count(F.lit(1)).alias("total"))
    j = levels.join(row_sums, "level").join(drive_sums, "level").join(leads, "level", "left").crossJoin(total)
    return j.select("threshold", "failed_drives", "failed_drives_caught", div(F.col("failed_drives_caught"), F.col("failed_drives")).alias("drive_recall"), "alerts",
                    (F.col("alerts") * 1000 / F.col("total")).alias("alerts_per_1000"), div(F.col("true_alerts"), F.col("alerts")).alias("row_precision"), "drives_flagged",
                    div(F.col("flagged_failing"), F.col("drives_flagged")).alias("drive_precision"), "median_lead_days", "mean_lead_days")


def marginal_cost(curve: DataFrame) -> DataFrame:
    """Extra drives flagged per extra failure caught, against the next higher threshold (one row per threshold)."""
    w = W.orderBy("threshold")
    caught = F.col("failed_drives_caught") - F.lead("failed_drives_caught").over(w)
    flagged = F.col("drives_flagged") - F.lead("drives_flagged").over(w)
    return curve.select("threshold", F.when(caught > 0, flagged / caught).alias("extra_checks_per_failure"))


# ---- recognition and abstention -------------------------------------------------------

def recognition_sweep(records: DataFrame, thresholds: list[float]) -> DataFrame:
    """Records: enrolled 0/1, correct 0/1 (nearest is the true person), distance. One pass, one row per threshold."""
    hits = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (F.col("distance") <= t).alias("accepted")) for t in thresholds])
    e = records.select("enrolled", "correct", F.inline(hits))
    known, acc, right = F.col("enrolled") == 1, F.col("accepted"), F.col("correct") == 1
    g = e.groupBy("threshold").agg(F.count_if(known).alias("known"), F.count_if(~known).alias("unknown"), F.count_if(known & acc & right).alias("identified"),
                                   F.count_if(known & ~acc).alias("rejected"), F.count_if(known & acc & ~right).alias("misidentified"), F.count_if(~known & acc).alias("false_accepted"))
    ident, reject = div(F.col("identified"), F.col("known")), div(F.col("false_accepted"), F.col("unknown"))
    return g.select("threshold", ident.alias("identification_rate"), div(F.col("rejected"), F.col("known")).alias("false_rejection_rate"),
                    div(F.col("misidentified"), F.col("known")).alias("misidentification_rate"), reject.alias("false_acceptance_rate"), ((ident + 1 - reject) / 2).alias("balanced_rate"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.max_by("threshold", F.struct("balanced_rate", -F.col("false_acceptance_rate"), -F.col("threshold"))).alias("threshold"), F.max("balanced_rate").alias("balanced_rate"))


def abstention_threshold(df: DataFrame, score: str, answerable: str) -> DataFrame:
    """Threshold with the best balanced accuracy among 0, 1, all scores and midpoints; a tie goes to the higher one.

    Counts per distinct score are cumulated by `ranks`, so no pair of scores is ever formed. Between
    two neighbouring scores the outcome does not change: a score and the midpoint below it accept the same rows."""
    c = ranking_counts(df, score, answerable)
    s = F.col(score)
    accepted_pos, rejected_neg = F.col("pos_total") - F.col("pos_cum") + F.col("pos"), F.col("neg_cum") - F.col("neg")
    at = c.select(s.alias("threshold"), ((div(accepted_pos, F.col("pos_total")) + div(rejected_neg, F.col("neg_total"))) / 2).alias("balanced_accuracy"), "pos_total", "neg_total")
    top = c.agg(F.max(score).alias("m"))
    above = top.where(F.col("m") < 1).select(F.lit(1.0).alias("threshold"), F.lit(0.5).alias("balanced_accuracy"))
    below = F.broadcast(top).select(F.lit(0.0).alias("threshold"), F.lit(0.5).alias("balanced_accuracy"))
    allc = at.select("threshold", "balanced_accuracy").unionByName(above).unionByName(below)
    return allc.agg(F.max(F.struct("balanced_accuracy", "threshold")).alias("b")).select("b.threshold", "b.balanced_accuracy")


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per query: hit, recall, precision over deduplicated documents of the first k, reciprocal rank."""
    docs = ranked.where(F.col("rank") <= k).groupBy("query_id", "document_id").agg(F.min("rank").alias("rank"))
    right = docs.join(expected.select("query_id", "document_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "document_id"], "left")
    g = right.groupBy("query_id").agg(F.count(F.lit(1)).alias("docs"), F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_rank"))
    want = expected.groupBy("query_id").agg(F.count_distinct("document_id").alias("wanted"))
    j = want.join(g, "query_id", "left").na.fill(0, ["docs", "hits"])
    return j.select("query_id", (F.col("hits") > 0).cast("int").alias("hit"), div(F.col("hits"), F.col("wanted")).alias("recall"), div(F.col("hits"), F.col("docs")).alias("precision"),
                    F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"))


# ---- alerts ------------------------------------------------------------------------

def operator_view(members: DataFrame, alert: str, incident: str) -> DataFrame:
    """Alerts shown, incidents, incidents inside one alert, and alone in it."""
    sizes = members.groupBy(alert).agg(F.count(F.lit(1)).alias("alert_size"))
    inc = members.where(F.col(incident).isNotNull()).groupBy(incident).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(alert).alias("alerts"), F.min(alert).alias(alert))
    j = inc.join(sizes, alert).agg(F.count(F.lit(1)).alias("incidents"), F.count_if(F.col("alerts") == 1).alias("incidents_fully_linked"),
                                   F.count_if((F.col("alerts") == 1) & (F.col("n") == F.col("alert_size"))).alias("incidents_linked_cleanly"))
    return sizes.agg(F.count(F.lit(1)).alias("alerts_shown")).crossJoin(j)


def queue_order(alerts: DataFrame, alert: str, rank: str, seed: int) -> DataFrame:
    """Alerts by severity, ties in seeded random order, with their place; the place comes from ranges, not from a one-task sort."""
    shuffled = F.md5(F.concat_ws("|", F.col(alert).cast("string"), F.lit(str(seed))))
    a = alerts.withColumn("__shuffle", shuffled).withColumn("__range", F.substring("__shuffle", 1, 2))
    cells = a.groupBy(rank, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy(F.desc(rank), "__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.select(rank, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy(rank, "__range").orderBy("__shuffle", alert)
    return a.join(offsets, [rank, "__range"]).withColumn("place", F.row_number().over(inside) + F.col("__before")).drop("__shuffle", "__range", "__before")


def queue_metrics(queue: DataFrame, truth: DataFrame, alert: str) -> DataFrame:
    """Average precision of genuine alerts, alerts until every incident and every event is seen, mean first rank."""
    c = ranks.cumulative(queue, [], "place", {"g": F.count_if("genuine")})
    ap = c.where("g > 0").agg(F.avg(F.col("g_cum") / F.col("place")).alias("average_precision"))
    seen = truth.join(queue.select(alert, "place"), alert).groupBy("incident").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    s = seen.agg(F.max("first").alias("alerts_until_all_incidents"), F.max("last").alias("alerts_until_all_events"), F.avg("first").alias("mean_first_rank"))
    return ap.crossJoin(s)


def escalation_separation(groups: DataFrame, rules: dict[str, Column], truth: str) -> DataFrame:
    """Genuine share among escalated groups minus the rest, per rule; null when a side is empty."""
    flags = F.array(*[F.struct(F.lit(i).alias("rule_order"), F.lit(n).alias("rule"), c.alias("esc")) for i, (n, c) in enumerate(rules.items())])
    g = groups.select(F.col(truth).cast("int").alias("t"), F.inline(flags))
    return g.groupBy("rule_order", "rule").agg(F.count_if("esc").alias("escalated"), F.count(F.lit(1)).alias("groups"), F.avg(F.when(F.col("esc"), F.col("t"))).alias("genuine_escalated"),
                                               F.avg(F.when(~F.col("esc"), F.col("t"))).alias("genuine_rest")) \
            .withColumn("separation", F.col("genuine_escalated") - F.col("genuine_rest"))


def select_rule(separations: DataFrame) -> DataFrame:
    """Rule with the largest separation; an empty side ranks last, a tie goes to the earlier rule."""
    return separations.agg(F.max_by("rule", F.struct(F.coalesce("separation", F.lit(-9.0)), -F.col("rule_order"))).alias("rule"))


# ---- agreement, intervals, resampling ---------------------------------------------------

def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    n, m = F.count(F.lit(1)), F.count_if(F.col(a) == F.col(b))
    g = df.agg(n.alias("n"), m.alias("same"), F.sum(a).alias("a1"), F.sum(b).alias("b1"))
    po = F.col("same") / F.col("n")
    pe = (F.col("a1") * F.col("b1") + (F.col("n") - F.col("a1")) * (F.col("n") - F.col("b1"))) / (F.col("n") * F.col("n"))
    return g.select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(1.0)).alias("kappa"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson 95% interval; (0, 0) for an empty group."""
    p, z2 = successes / n, z * z
    centre, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    side = lambda s: F.when(n > 0, (centre + s * half) / (1 + z2 / n)).otherwise(F.lit(0.0))
    return side(-1), side(1)


def nearest_on_curve(curve: DataFrame, by: str, grid: str, at: float) -> DataFrame:
    """Grid point nearest to a confidence, per class; the lower one on a tie."""
    return curve.groupBy(by).agg(F.min_by(F.struct("*"), F.struct(F.abs(F.col(grid) - at), F.col(grid))).alias("p")).select("p.*")


def best_f1_confidence(curve: DataFrame, by: str, grid: str, f1: str) -> DataFrame:
    return curve.groupBy(by).agg(F.max_by(grid, F.struct(f1, -F.col(grid))).alias("confidence"), F.max(f1).alias("f1"))


#: Partitions of the draws of a bootstrap.
DRAW_PARTITIONS = 64


def cluster_bootstrap(cells: DataFrame, unit: str, draws: int, seed: int, counts: list[str]) -> DataFrame:
    """Resampled sums per draw: whole units with replacement. `cells` has one pre-aggregated row per unit.

    Each (draw, slot) picks a unit by hash. The draws are dealt over partitions and meet the slots there; picks are summed per draw
    straight from their units, so that a task holds one row of sums for each of its draws, whatever the number of units."""
    indexed = materialize(unit_index(cells, unit).select("idx", *counts), "units")
    n = indexed.agg(F.count(F.lit(1)).alias("n"))
    dealt = indexed.sparkSession.range(0, draws, 1, DRAW_PARTITIONS).select(F.col("id").cast("int").alias("draw"))
    slots = dealt.crossJoin(indexed.select("idx")).crossJoin(F.broadcast(n))
    pick = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "draw", "idx")), 1, 15), 16, 10).cast("long") % F.col("n")).alias("idx")
    return slots.select("draw", pick).join(indexed, "idx").groupBy("draw").agg(*[F.sum(c).alias(c) for c in counts])


def unit_index(cells: DataFrame, unit: str) -> DataFrame:
    """Zero-based dense index of the units in hash order, from range counts."""
    h = cells.withColumn("__h", F.md5(F.col(unit).cast("string"))).withColumn("__r", F.substring("__h", 1, 2))
    before = W.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    offs = h.groupBy("__r").agg(F.count(F.lit(1)).alias("__n")).select("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"))
    return h.join(offs, "__r").withColumn("idx", F.row_number().over(W.partitionBy("__r").orderBy("__h")) - 1 + F.col("__b")).drop("__h", "__r", "__b")


def percentile_interval(draws: DataFrame, value: str) -> DataFrame:
    return draws.agg(F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"))


# ---- latency, dashboards ------------------------------------------------------------------

def route_template(path: Column) -> Column:
    """Path with numbers and file endings replaced by placeholders; query and fragment dropped."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^https?://[^/]+", ""), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"/\d+", "/{id}"), r"\.\w+$", "")


def latency_summary(df: DataFrame, route: str, value: str) -> DataFrame:
    base = df.groupBy(route).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    return ranks.percentiles(df, [route], value, {"median": .5, "p95": .95}).join(base, route)
