"""Incremental file ingestion with a ledger, and streaming upserts."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchfold.sources.upsert import upsert_parquet

LEDGER = "path STRING, length LONG, modified_at TIMESTAMP, content_sha256 STRING, status STRING, recorded_at TIMESTAMP, kind STRING"
DONE = ["COMPLETE", "PARTIAL"]
FILES = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"
AGAIN = ["FAILED", "PENDING"]


def _ledger(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Entries of one kind; the ledger is partitioned by kind, so others are not read."""
    try:
        entries = spark.read.schema(LEDGER).parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        entries = spark.createDataFrame([], LEDGER)
    return entries.where(F.col("kind") == kind)


def _record(entries: DataFrame, kind: str, ledger_path: str) -> None:
    rows = entries.select("path", "length", "modified_at", "content_sha256", "status", F.current_timestamp().alias("recorded_at"), F.lit(kind).alias("kind"))
    rows.write.mode("append").partitionBy("kind").parquet(ledger_path)


def process_files(files: DataFrame, kind: str, ledger_path: str, handle: Callable[[DataFrame], DataFrame], max_bytes: int, min_age_seconds: int = 5) -> DataFrame:
    """Handle new files once and append their outcome to the ledger.

    Key = (path, length, modification time, SHA-256 of the bytes): a changed file is new, a file marked COMPLETE or PARTIAL
    is skipped, a FAILED one is tried again. Files above `max_bytes` are recorded as TOO_LARGE from their metadata, before any
    content is read; files younger than `min_age_seconds` are recorded as PENDING and left for a later pass. `handle` gets (path,
    content_sha256, content) rows and returns (path, content_sha256, status) rows; a file that it leaves out, and every
    file of a pass in which it raises, is FAILED.
    """
    spark = files.sparkSession
    settled = F.col("modificationTime") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(min_age_seconds)))
    meta = ["path", "length", F.col("modificationTime").alias("modified_at")]
    ledger = _ledger(spark, ledger_path, kind)
    done = ledger.where(F.col("status").isin(*DONE))
    light = files.where(~settled | (F.col("length") > max_bytes)).select(*meta, F.lit(None).cast("string").alias("content_sha256"),
                                                                        F.when(settled, "TOO_LARGE").otherwise("PENDING").alias("status"))
    _record(light.join(ledger.select("path", "length", "modified_at", "status"), ["path", "length", "modified_at", "status"], "left_anti"), kind, ledger_path)
    keyed = files.where(settled & (F.col("length") <= max_bytes)).select(*meta, F.sha2("content", 256).alias("content_sha256"), "content")
    fresh = keyed.join(done.select("path", "length", "modified_at", "content_sha256"), ["path", "length", "modified_at", "content_sha256"], "left_anti")
    known = fresh.select("path", "length", "modified_at", "content_sha256")
    try:
        outcome = handle(fresh.select("path", "content_sha256", "content")).select("path", "content_sha256", "status")
        _record(known.join(outcome, ["path", "content_sha256"], "left").withColumn("status", F.coalesce("status", F.lit("FAILED"))), kind, ledger_path)
    except Exception as exc:  # whatever the handler does, the files get their entry and later passes go on
        warnings.warn(f"{kind}: the handler failed, its files are marked FAILED: {exc}")
        _record(known.withColumn("status", F.lit("FAILED")), kind, ledger_path)
    return _ledger(spark, ledger_path, kind)


def scan_once(spark: SparkSession, folder: str, glob: str, kind: str, ledger_path: str, handle: Callable[[DataFrame], DataFrame], max_bytes: int, min_age_seconds: int = 5) -> DataFrame:
    """One polling pass over a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return process_files(files, kind, ledger_path, handle, max_bytes, min_age_seconds)


def open_paths(spark: SparkSession, kind: str, ledger_path: str, at_most: int) -> list[str]:
    """The longest-waiting `at_most` paths whose latest entry is FAILED or PENDING."""
    latest = _ledger(spark, ledger_path, kind).groupBy("path").agg(F.max(F.struct("recorded_at", "status")).alias("last"))
    waiting = latest.where(F.col("last.status").isin(*AGAIN)).orderBy("last.recorded_at", "path").limit(at_most)
    return [r["path"] for r in waiting.select("path").collect()]


def ingest_stream(spark: SparkSession, folder: str, glob: str, kind: str, ledger_path: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame],
                  max_bytes: int, interval: str | None = None, files_per_trigger: int = 1000, min_age_seconds: int = 5):
    """The same as a stream: one shot (`interval` None) or on a processing-time interval.

    The stream itself carries paths only; a batch reads the contents of at most `files_per_trigger` new files and as many that failed or
    were too young before (also once at the start, when there may be no new file). A replayed
    micro-batch finds its files in the ledger and does nothing.
    """
    def read(paths: list[str]) -> None:
        present = [p for p in paths if _exists(spark, p)]
        if present:
            process_files(spark.read.format("binaryFile").load(present), kind, ledger_path, handle, max_bytes, min_age_seconds)

    def batch(rows: DataFrame, _: int) -> None:
        new = [r["path"] for r in rows.select("path").collect()]
        read(sorted({*new, *open_paths(spark, kind, ledger_path, files_per_trigger)}))

    read(open_paths(spark, kind, ledger_path, files_per_trigger))
    files = (spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).schema(FILES).load(folder).select("path"))
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def latest_upsert_stream(rows: DataFrame, target: str, key: list[str], order: Column, checkpoint: str):
    """Latest row per key kept in a Parquet table, merged batch by batch; replays change nothing."""
    def merge(batch: DataFrame, _: int) -> None:
        upsert_parquet(batch.sparkSession, target, batch, key, order)
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()
