"""Table scans and sinks: Parquet, CSV and JSON lines with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table. Zone-less timestamps are declared UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, required: list[str] | None = None) -> DataFrame:
    """CSV scan with a declared schema; the header is checked against it when required columns are named."""
    if required:
        header = spark.read.option("header", True).csv(path)
        require_columns(header, required)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def split_bad_timestamps(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `column` as UTC timestamp or null, rows whose text was not a timestamp)."""
    parsed = df.withColumn("__ts", F.try_to_timestamp(F.col(column)))
    good = parsed.drop(column).withColumnRenamed("__ts", column)
    bad = parsed.where(F.col(column).isNotNull() & F.col("__ts").isNull()).drop("__ts")
    return good, bad


def timestamp_report(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Rows, parsed rows and coerced-to-null rows per group."""
    ts = F.try_to_timestamp(F.col(column))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(ts).alias("parsed"),
        F.count_if(F.col(column).isNotNull() & ts.isNull()).alias("coerced"),
    )


def labelled_scan(spark: SparkSession, path: str, columns: list[str], label: str, periods: list[str] | None = None,
                  locked_periods: tuple[str, ...] = ()) -> DataFrame:
    """Period-partitioned scan: partition pruning on `period`, column pruning, labelled rows only.

    A locked period (final test data) is refused instead of read by accident.
    """
    blocked = sorted(set(periods or ()) & set(locked_periods))
    if blocked:
        raise PermissionError(f"locked period requested: {', '.join(blocked)}")
    df = spark.read.parquet(path)
    if periods is not None:
        df = df.where(F.col("period").isin(*periods))
    elif locked_periods:
        df = df.where(~F.col("period").isin(*locked_periods))
    return df.select(*columns).where(F.col(label).isNotNull())


def write_periods(df: DataFrame, path: str, keep: DataFrame, key: str, columns: list[str]) -> None:
    """Compact extract: wanted keys and columns only, one folder per period; a large period is written by several tasks."""
    (df.join(keep.select(key).distinct(), key, "left_semi")
       .select(*columns, "period")
       .hint("rebalance", "period")
       .write.mode("overwrite").partitionBy("period").parquet(path))


def file_inventory(spark: SparkSession, path: str, serial: str, failure: str) -> DataFrame:
    """Per daily CSV file (by path, names may repeat across folders): rows, distinct serials, failure rows.

    The header of every file is checked against the inferred columns: a file with other names or another order is an
    error, not a miscount.
    """
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    require_columns(df, [serial, failure])
    return (df.select(F.col("_metadata.file_path").alias("file"), serial, failure)
              .groupBy("file")
              .agg(F.count(F.lit(1)).alias("rows"),
                   F.count_distinct(serial).alias("serials"),
                   F.count_if(F.col(failure).cast("int") == 1).alias("failure_rows")))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
