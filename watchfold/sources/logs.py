"""Log text scans that keep the 1-based line number of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from watchfold.session import Scratch

#: Blocks of a scan that may be broadcast: at some 200 bytes each, 50 MB.
BROADCAST_BLOCKS = 1 << 18


def explode_lines(df: DataFrame, text: str = "value", keep: list[str] | None = None) -> DataFrame:
    """One row per line with its 1-based number. A final newline opens no extra line."""
    body = F.regexp_replace(F.col(text), r"\r?\n\z", "")
    return df.select(*(keep or []), F.posexplode(F.split(body, r"\r?\n")).alias("pos", "value")) \
             .select(*(keep or []), (F.col("pos") + 1).cast("long").alias("line_number"), "value")


def read_log_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Log files as (file, line_number, value); bytes that are not UTF-8 become U+FFFD, a carriage return before the newline goes.

    Files are split into blocks like any text scan, however long they are, and no file is one row. A first pass counts the lines that begin in each block; running
    sums over a file's blocks, in order of their offsets, give the number of each block's first line. Lines meet their block by an equi-join with that table, one
    row for each block, which is broadcast up to BROADCAST_BLOCKS blocks. Inside a block the scan's own row numbers, which rise by one from
    line to line, give the place. Both passes must cut files alike: where executors come and go between them, fix
    spark.sql.files.minPartitionNum. A scan cut otherwise fails, it never numbers wrongly."""
    scan = (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value"))
    found = scan.groupBy("file", "block").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("lines"))
    found, (n,) = Scratch(spark, "log-blocks").table(found, F.count(F.lit(1)))
    before = F.sum("lines").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = found.select("file", "block", "first_row", "lines", F.coalesce(before, F.lit(0)).alias("lines_before"))
    lines = scan.join(F.broadcast(blocks) if n <= BROADCAST_BLOCKS else blocks, ["file", "block"], "left")
    place = F.col("row") - F.col("first_row")
    # a block's rows are as many as its places: any other cut leaves at least one row without a place
    number = F.when((place >= 0) & (place < F.col("lines")), F.col("lines_before") + place + 1).otherwise(F.raise_error(F.lit("log files were cut into other blocks than before")))
    return lines.select("file", number.cast("long").alias("line_number"), F.regexp_replace(F.make_valid_utf8("value"), r"\r\z", "").alias("value"))
