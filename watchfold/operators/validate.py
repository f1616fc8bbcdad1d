"""Contracts and integrity checks that return rows, not exceptions, at table scale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def assert_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"duplicate keys in {what}: {', '.join(keys)}")
    return df


def one_to_one_join(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Inner join of detector results; a duplicate key on any side is an error."""
    checked = [assert_unique(p, keys, f"input {i}") for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.join(b, keys), checked)


def manifest_match(manifest: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer match with a side indicator; duplicate manifest keys are an error."""
    m = assert_unique(manifest, keys, "manifest").withColumn("__m", F.lit(1))
    f = assert_unique(features, keys, "features").withColumn("__f", F.lit(1))
    status = F.when(F.col("__f").isNull(), "MANIFEST_ONLY").when(F.col("__m").isNull(), "FEATURES_ONLY").otherwise("MATCHED")
    return m.join(f, keys, "full").withColumn("match_status", status).drop("__m", "__f")


def entity_split(df: DataFrame, entity: str, seed: int, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Split by a hash of the entity: rows of one entity always share a set, without any shuffle."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(entity).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.withColumn("split", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def split_leakage(df: DataFrame, entity: str, split: str, names: list[str]) -> DataFrame:
    """Entities that occur in two sets, per pair of sets; all counts must be 0."""
    seen = df.groupBy(entity).agg(*[F.max((F.col(split) == n).cast("int")).alias(f"in_{n}") for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    one = seen.agg(*[F.count_if((F.col(f"in_{a}") == 1) & (F.col(f"in_{b}") == 1)).alias(f"{a}/{b}") for a, b in pairs])
    return one.unpivot([], [F.col(f"`{a}/{b}`") for a, b in pairs], "pair", "shared_entities")


def zero_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "feature", "v")
    return long.groupBy("feature").agg(F.count_distinct("v").alias("distinct_values")).withColumn("constant", F.col("distinct_values") <= 1)


def missing_and_unexpected(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Expected minus observed and observed minus expected, as one table."""
    gone = expected.select(*keys).distinct().join(observed.select(*keys).distinct(), keys, "left_anti").withColumn("problem", F.lit("MISSING"))
    extra = observed.select(*keys).distinct().join(expected.select(*keys).distinct(), keys, "left_anti").withColumn("problem", F.lit("UNEXPECTED"))
    return gone.unionByName(extra)


def sensor_batch_contract(readings: DataFrame, batch: str, minimum: int = 1, maximum: int = 500) -> DataFrame:
    """Errors per sensor batch: row count, unique timestamps, at least one measurement per row."""
    empty = F.col("temperature_c").isNull() & F.col("humidity_pct").isNull()
    bad = lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    g = readings.groupBy(batch).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("timestamp").alias("times"), F.count_if(empty).alias("empty_rows"),
                                    F.count_if(bad(F.col("temperature_c")) | bad(F.col("humidity_pct"))).alias("not_finite"))
    errors = F.array_compact(F.array(
        F.when((F.col("rows") < minimum) | (F.col("rows") > maximum), "ROW_COUNT"), F.when(F.col("rows") != F.col("times"), "DUPLICATE_TIMESTAMPS"),
        F.when(F.col("empty_rows") > 0, "ROW_WITHOUT_MEASUREMENT"), F.when(F.col("not_finite") > 0, "NOT_FINITE")))
    return g.withColumn("errors", F.array_join(errors, ",")).withColumn("valid", F.size(errors) == 0)


def correlation_record_errors(event_ids: Column, domains: Column, scope: Column) -> Column:
    return F.array_compact(F.array(
        F.when(F.size(F.array_distinct(event_ids)) < 2, "FEWER_THAN_TWO_EVENTS"), F.when(F.size(event_ids) != F.size(F.array_distinct(event_ids)), "DUPLICATE_EVENTS"),
        F.when(F.size(F.array_distinct(domains)) < 2, "FEWER_THAN_TWO_DOMAINS"), F.when(~F.coalesce(scope.isin("SERVER", "RACK", "ZONE"), F.lit(False)), "INVALID_SCOPE")))


def capture_metadata_errors(now: Column) -> Column:
    """Errors of declared capture metadata joined with the camera table (camera_zone)."""
    offset = F.col("captured_at").rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    ts = F.try_to_timestamp(F.col("captured_at"))
    return F.array_compact(F.array(
        F.when(F.col("camera_zone").isNull(), "UNKNOWN_CAMERA").when(F.col("camera_zone") != F.col("zone_id"), "CAMERA_NOT_IN_ZONE"),
        F.when(ts.isNull(), "INVALID_TIME").when(~offset, "TIME_WITHOUT_OFFSET").when(ts > now, "TIME_IN_FUTURE")))
