"""Event-time streams: window features, interval joins, session windows, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from watchfold.operators.bandjoin import time_cell
from watchfold.operators.pairs import compatible
from watchfold.operators.windows import entity_window_features

WATERMARK = "10 minutes"
#: Length of a time cell of the interval join, in intervals: a right row is kept 1 + 2 / CELL_SPANS times.
CELL_SPANS = 8


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """File stream of one Parquet table, a file or a folder of files; zone-less timestamps are declared UTC as in batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # a pattern, as a stream takes no path that is a single file; a folder that it matches is listed with all its files
    df = spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")
    zoneless = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain what is available in append mode into a Parquet folder and read it."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def streaming_features(events: DataFrame, duration: str = "5 minutes", minutes: float = 5.0, watermark: str = WATERMARK) -> DataFrame:
    """Window features in append mode. Distinct users are a sketch of bounded size in state, see `entity_window_features`."""
    return entity_window_features(events.withWatermark("timestamp", watermark), duration, minutes, exact_distinct=False)


def deduplicated(events: DataFrame, key: list[str], ts: str = "timestamp", watermark: str = WATERMARK) -> DataFrame:
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(key)


def interval_join(left: DataFrame, right: DataFrame, seconds: int = 900, watermark: str = WATERMARK) -> DataFrame:
    """Cross-kind pairs of two node streams (zone_id, kind, id, ts) within the interval; both watermarks bound the state.

    A row is looked up among the rows of its zone and time cell, not among all rows that the state holds of the zone. A cell is
    CELL_SPANS intervals long; a right row within an interval of a cell's end stands in the next one too, so each pair meets once."""
    l = left.withWatermark("ts", watermark).select(*[F.col(c).alias(f"left_{c}") for c in ("zone_id", "kind", "id", "ts")])
    r = right.withWatermark("ts", watermark).select(*[F.col(c).alias(f"right_{c}") for c in ("zone_id", "kind", "id", "ts")])
    reach = seconds * 1_000_000
    cell = lambda us: time_cell(us, CELL_SPANS * reach)
    l = l.withColumn("left_cell", cell(F.unix_micros("left_ts")))
    r = r.withColumn("right_cell", F.explode(F.sequence(cell(F.unix_micros("right_ts") - reach), cell(F.unix_micros("right_ts") + reach))))
    span = F.expr(f"INTERVAL {seconds} SECONDS")
    on = ((F.col("left_zone_id") == F.col("right_zone_id")) & (F.col("left_cell") == F.col("right_cell"))
          & (F.col("right_ts") >= F.col("left_ts") - span) & (F.col("right_ts") <= F.col("left_ts") + span)
          & (F.col("left_kind") < F.col("right_kind")) & compatible(F.col("left_kind"), F.col("right_kind")))
    return l.join(r, on).drop("left_cell", "right_cell")


def session_windows(events: DataFrame, entity: str = "source_ip", gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    return (events.withWatermark("timestamp", watermark).groupBy(entity, F.session_window("timestamp", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("event_type") == "failed_login").alias("failed"))
            .select(entity, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "event_count", "failed"))
