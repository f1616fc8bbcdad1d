"""Drive-day labelling, temporal features, sequences, sampling and inventories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from watchfold.operators import ranks, series
from watchfold.session import materialize

HORIZON_DAYS = 7


def failure_registry(days: DataFrame) -> DataFrame:
    """Earliest explicit failure per drive, with the first model seen at that date."""
    return days.where(F.col("failure") == 1).groupBy("serial_number").agg(
        F.min("date").alias("failure_date"),
        F.min_by("model", F.when(F.col("model").isNotNull(), F.struct("date", "model"))).alias("failure_model"))


def label_drive_days(days: DataFrame, registry: DataFrame, end_date: str, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Label states; later states win: NORMAL, CENSORED, AT_RISK, FAILURE_DAY, POST_FAILURE."""
    left = F.datediff("failure_date", "date")
    state = (F.when(left < 0, "POST_FAILURE").when(left == 0, "FAILURE_DAY").when(left.between(1, horizon), "AT_RISK")
             .when(F.col("date") > F.date_sub(F.lit(end_date).cast("date"), horizon), "CENSORED").otherwise("NORMAL"))
    return (days.join(registry.select("serial_number", "failure_date"), "serial_number", "left")
            .withColumn("days_until_failure", left).withColumn("label_state", state)
            .withColumn("target", F.when(F.col("label_state") == "NORMAL", 0).when(F.col("label_state") == "AT_RISK", 1)))


def temporal_features(days: DataFrame, lag_columns: list[str], rolling_column: str, flag_columns: list[str],
                      key: str = "serial_number", order: str = "date", max_rows: int = series.MAX_GROUP_ROWS) -> DataFrame:
    """Row-lag deltas (1 and 7 observations), 7-observation rolling statistics with at least two
    values, and health flags. One shuffle by drive serves all of them."""
    rows, part = series.blocks(days, key, order, 7, max_rows)
    by = W.partitionBy(*part).orderBy(order)
    seven = by.rowsBetween(-6, 0)
    deltas = {f"{c}_delta_{n}": F.col(c) - F.lag(c, n).over(by) for c in lag_columns for n in (1, 7)}
    enough = F.count(rolling_column).over(seven) >= 2
    rolling = {f"{rolling_column}_7obs_{name}": F.when(enough, fn(rolling_column).over(seven))
               for name, fn in (("mean", F.avg), ("max", F.max), ("min", F.min))}
    out = rows.withColumns({**deltas, **rolling}).where(~F.col("is_halo")).drop("is_halo", "series_block")
    positive = lambda c: (F.coalesce(F.col(c), F.lit(0)) > 0).cast("int")
    flags = {f"{c}_nonzero": positive(c) for c in flag_columns} | {f"{c}_increased": positive(f"{c}_delta_1") for c in flag_columns}
    return out.withColumns({
        **flags,
        f"{rolling_column}_7obs_range": F.col(f"{rolling_column}_7obs_max") - F.col(f"{rolling_column}_7obs_min"),
        f"{rolling_column}_vs_7obs_mean": F.col(rolling_column) - F.col(f"{rolling_column}_7obs_mean"),
    })


def sequences(days: DataFrame, channels: list[str], length: int = 30, target: str = "target", key: str = "serial_number",
              order: str = "date", max_rows: int = series.MAX_GROUP_ROWS) -> DataFrame:
    """Endpoints with `length` consecutive calendar days ending there and a target, with the
    `length` x channels array. Arrays are built only from the bounded frame."""
    rows, part = series.blocks(days, key, order, length, max_rows)
    by = W.partitionBy(*part).orderBy(order)
    step = rows.withColumn("__step", F.coalesce((F.datediff(order, F.lag(order).over(by)) == 1).cast("int"), F.lit(0)))
    steps = F.sum("__step").over(by.rowsBetween(-(length - 2), 0))
    frame = F.collect_list(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in channels])) \
        .over(by.rowsBetween(-(length - 1), 0))
    return (step.withColumn("__steps", steps).withColumn("sequence", frame)
            .where((F.col("__steps") == length - 1) & F.col(target).isNotNull() & ~F.col("is_halo"))
            .drop("__step", "__steps", "is_halo", "series_block"))


def endpoint_lookup(endpoints: DataFrame, seqs: DataFrame) -> DataFrame:
    """Every requested endpoint with the number of sequences found; anything but one is an error."""
    found = seqs.groupBy("serial_number", "date").agg(F.count(F.lit(1)).alias("matches"))
    return (endpoints.join(found, ["serial_number", "date"], "left").na.fill(0, ["matches"])
            .withColumn("status", F.when(F.col("matches") == 1, "OK").when(F.col("matches") == 0, "MISSING").otherwise("DUPLICATE")))


def hash_position(*parts: Column) -> Column:
    """Uniform 60-bit number of a key, the same on every engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def take_smallest(df: DataFrame, groups: list[str], position: str, quota: DataFrame) -> DataFrame:
    """Exactly `quota` rows per group, those with the smallest hash positions.

    4096 position ranges are counted; whole ranges below the quota pass and only the range
    that crosses it is ranked, so no task sorts a whole group."""
    ranged = df.withColumn("__range", F.shiftright(F.col(position), 48))
    counts = ranged.groupBy(*groups, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*groups).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).join(quota, groups)
    open_ranges = offsets.where(F.col("__before") < F.col("quota"))
    kept = ranged.join(open_ranges, [*groups, "__range"])
    inside = W.partitionBy(*groups, "__range").orderBy(position)
    whole = kept.where(F.col("__before") + F.col("__n") <= F.col("quota"))
    crossing = (kept.where(F.col("__before") + F.col("__n") > F.col("quota"))
                .withColumn("__rank", F.row_number().over(inside)).where(F.col("__rank") + F.col("__before") <= F.col("quota"))
                .drop("__rank"))
    return whole.unionByName(crossing).select(*df.columns)


def negative_quota(labelled: DataFrame, ratio: int) -> DataFrame:
    """Rows to take per period: proportional share, half-even rounding, the last period takes the rest."""
    counts = labelled.groupBy("period").agg(F.count_if(F.col("target") == 0).alias("available"), F.count_if(F.col("target") == 1).alias("positives"))
    every = W.partitionBy()
    upto = W.orderBy("period").rowsBetween(W.unboundedPreceding, -1)
    goal = counts.withColumn("goal", F.sum("positives").over(every) * ratio).withColumn("all_available", F.sum("available").over(every))
    share = F.least(F.bround(F.col("goal") * (F.col("available") / F.col("all_available")), 0).cast("long"), F.col("available"))
    last = F.col("period") == F.max("period").over(every)
    placed = goal.withColumn("share", share).withColumn("last", last)
    rest = F.least(F.col("goal") - F.coalesce(F.sum("share").over(upto), F.lit(0)), F.col("available"))
    return placed.select("period", F.greatest(F.when(F.col("last"), rest).otherwise(F.col("share")), F.lit(0)).alias("quota"))


def downsample_negatives(labelled: DataFrame, ratio: int = 50, seed: int = 42) -> DataFrame:
    """All positives and `ratio` negatives per positive, exact and reproducible."""
    rows = labelled.where(F.col("target").isNotNull()).withColumn(
        "sample_position", hash_position(F.col("serial_number"), F.col("date"), F.lit(seed)))
    picked = take_smallest(rows.where("target = 0"), ["period"], "sample_position", negative_quota(rows, ratio))
    return rows.where("target = 1").unionByName(picked)


# ---- inventories ------------------------------------------------------------------

def inventory(days: DataFrame, registry: DataFrame) -> DataFrame:
    base = days.groupBy("model", "period").agg(F.count(F.lit(1)).alias("drive_days"), F.count_distinct("serial_number").alias("drives"),
                                               F.count_if(F.col("failure") == 1).alias("failure_rows"))
    failed = days.where("failure = 1").groupBy("model", "period").agg(F.count_distinct("serial_number").alias("failed_drives"))
    return base.join(failed, ["model", "period"], "left").na.fill(0, ["failed_drives"])


def candidate_summary(inv: DataFrame) -> DataFrame:
    return inv.groupBy("model").agg(F.sum("drive_days").alias("drive_days"), F.max("drives").alias("max_drives"),
                                    F.sum("failed_drives").alias("failed_drives"), F.count_if(F.col("failed_drives") > 0).alias("periods_with_failures"))


def failed_by_period(inv: DataFrame, periods: list[str]) -> DataFrame:
    return inv.groupBy("model").pivot("period", periods).agg(F.sum("failed_drives")).na.fill(0)


def coverage(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """Non-null share per group and column: one aggregate pass, then unpivot of the small result."""
    wide = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in columns])
    long = wide.unpivot([*groups, "rows"], columns, "column", "non_null")
    return long.withColumn("coverage", F.col("non_null") / F.col("rows"))


def coverage_summary(cov: DataFrame, minimum: float = 0.95) -> DataFrame:
    return cov.groupBy("column").agg(F.min("coverage").alias("min_coverage"), F.avg("coverage").alias("mean_coverage")) \
              .withColumn("usable", F.col("min_coverage") >= minimum)


def variance_statistics(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    long = df.unpivot(groups, [F.col(c).cast("double").alias(c) for c in columns], "column", "v")
    return long.groupBy(*groups, "column").agg(
        F.count(F.lit(1)).alias("rows"), F.count("v").alias("non_null"), F.count_distinct("v").alias("distinct_values"),
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def variance_summary(stats: DataFrame) -> DataFrame:
    """Minimum and median spread of each column over the groups; number of groups is small by contract."""
    return stats.groupBy("column").agg(F.min("std").alias("min_std"), F.percentile("std", 0.5).alias("median_std"),
                                       F.bool_or(F.col("distinct_values") <= 1).alias("constant_somewhere"))


def class_contrast(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """NORMAL vs AT_RISK: exact median, mean, 95th percentile and nonzero share."""
    rows = materialize(labelled.where(F.col("label_state").isin("NORMAL", "AT_RISK")).select("label_state", *columns), "labelled")
    long = (rows.unpivot(["label_state"], [F.col(c).cast("double").alias(c) for c in columns], "column", "v"))
    base = long.groupBy("label_state", "column").agg(F.avg("v").alias("mean"), (F.count_if(F.col("v") != 0) / F.count("v") * 100).alias("nonzero_pct"))
    pct = ranks.percentiles(long, ["label_state", "column"], "v", {"median": 0.5, "p95": 0.95}).drop("n")
    return base.join(pct, ["label_state", "column"])


def value_before_failure(labelled: DataFrame, column: str, horizon: int) -> DataFrame:
    near = labelled.where(F.col("days_until_failure").between(0, horizon))
    return ranks.percentiles(near, ["days_until_failure"], column, {"median": 0.5})


def robust_statistics(df: DataFrame, channels: list[str], log_channels: list[str], groups: list[str] | None = None) -> DataFrame:
    """Per channel: log1p where asked (negatives count as missing), median, quartiles, scale (IQR, 1 when 0), missing rate."""
    cols = [(F.when(F.col(c) >= 0, F.log1p(c)) if c in log_channels else F.col(c).cast("double")).alias(c) for c in channels]
    long = df.unpivot(groups or [], cols, "channel", "v")
    long = long.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    missing = long.groupBy("channel").agg((1 - F.count("v") / F.count(F.lit(1))).alias("missing_rate"))
    pct = ranks.percentiles(long, ["channel"], "v", {"median": .5, "q25": .25, "q75": .75}).drop("n")
    iqr = F.col("q75") - F.col("q25")
    return pct.withColumn("scale", F.when(iqr > 0, iqr).otherwise(F.lit(1.0))).join(missing, "channel")


def normalise_sequences(seqs: DataFrame, stats: DataFrame, channels: list[str], log_channels: list[str], clip: float = 10.0) -> DataFrame:
    """log1p, missing -> median, (x - median) / scale, clipped. `stats` is one row per channel, so the broadcast is bounded."""
    packed = stats.agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("median", "scale")))).alias("stats"))
    def cell(x, i):
        name = channels[i]
        v = F.when(x >= 0, F.log1p(x)) if name in log_channels else x
        s = F.col("stats")[name]
        return F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.coalesce(F.when(~F.isnan(v), v), s["median"]) - s["median"]) / s["scale"]))
    scaled = F.transform("sequence", lambda row: F.array(*[cell(row[i], i) for i in range(len(channels))]))
    return seqs.crossJoin(F.broadcast(packed)).withColumn("sequence", scaled).drop("stats")


def split_integrity(labelled: DataFrame, horizon: int) -> DataFrame:
    """One row per rule with the number of violating rows."""
    state, target = F.col("label_state"), F.col("target")
    rules = {
        "unlabelled_state_has_target": state.isin("FAILURE_DAY", "CENSORED", "POST_FAILURE") & target.isNotNull(),
        "labelled_state_without_target": state.isin("NORMAL", "AT_RISK") & target.isNull(),
        "positive_outside_horizon": (target == 1) & ~F.coalesce(F.col("days_until_failure").between(1, horizon), F.lit(False)),
        "row_after_failure_not_marked": (F.col("days_until_failure") < 0) & (state != "POST_FAILURE"),
    }
    one = labelled.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return one.unpivot([], list(rules), "rule", "violations").withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def period_integrity(labelled: DataFrame, bounds: DataFrame, horizon: int) -> DataFrame:
    """One row for each expected period (period, start_date, end_date): rows, first and last date, violations, PASS or FAIL.

    A period passes when its rows begin and end on its bounds, none lies outside, only NORMAL and AT_RISK rows have a target, and
    positives are 1 to `horizon` days before the failure. A period without rows fails.
    """
    state, target = F.col("label_state"), F.col("target")
    rules = {
        "rows_out_of_bounds": ~F.col("date").between(F.col("start_date"), F.col("end_date")),
        "unlabelled_with_target": state.isin("FAILURE_DAY", "CENSORED", "POST_FAILURE") & target.isNotNull(),
        "positive_outside_horizon": (state == "AT_RISK") & ~F.coalesce((target == 1) & F.col("days_until_failure").between(1, horizon), F.lit(False)),
        "normal_with_other_target": (state == "NORMAL") & ~F.coalesce(target == 0, F.lit(False)),
    }
    rows = labelled.select("period", "date", "label_state", "target", "days_until_failure").join(bounds, "period")
    sums = rows.groupBy("period").agg(F.count("date").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), *[F.count_if(c).alias(n) for n, c in rules.items()])
    g = bounds.join(sums, "period", "left").na.fill(0, ["rows", *rules])
    sound = (F.col("first_date") == F.col("start_date")) & (F.col("last_date") == F.col("end_date")) & (reduce(lambda a, b: a + b, [F.col(n) for n in rules]) == 0)
    return g.withColumn("status", F.when(sound, "PASS").otherwise("FAIL"))


def drive_history_contract(days: DataFrame, columns: list[str], minimum: int = 8, maximum: int = 10000) -> DataFrame:
    """Errors per drive: row count, unique dates, finite and non-negative values."""
    bad = reduce(lambda a, b: a | b, [(F.col(c) < 0) | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf")) for c in columns])
    g = days.groupBy("serial_number").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("date").alias("dates"), F.count_if(bad).alias("bad_values"))
    errors = F.array_compact(F.array(
        F.when(F.col("rows") < minimum, "TOO_FEW_ROWS"), F.when(F.col("rows") > maximum, "TOO_MANY_ROWS"),
        F.when(F.col("rows") != F.col("dates"), "DUPLICATE_DATES"), F.when(F.col("bad_values") > 0, "INVALID_VALUES")))
    return g.withColumn("errors", F.array_join(errors, ",")).withColumn("valid", F.size(errors) == 0)
