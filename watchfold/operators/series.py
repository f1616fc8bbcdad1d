"""Ordered-series windows that survive one key holding most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

# Rows one window group may hold before its key is cut into blocks.
MAX_GROUP_ROWS = 2_000_000


def blocks(df: DataFrame, key: str, order: str, halo: int, max_rows: int = MAX_GROUP_ROWS) -> tuple[DataFrame, list[str]]:
    """(rows, window partition columns) for a window that looks back at most `halo` rows.

    Usual case: no key is longer than `max_rows`, and the window runs per key. Otherwise
    every row gets its exact position from per-month counts (no single-task sort), keys are
    cut into blocks of `max_rows` rows and the last `halo` rows of a block are copied into
    the next one. Copies carry `is_halo` and must be filtered after the window.
    """
    longest = df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if longest <= max_rows:
        return df.withColumn("is_halo", F.lit(False)), [key]
    month = df.withColumn("__month", F.date_trunc("month", F.col(order)))
    inside = W.partitionBy(key, "__month").orderBy(order)
    before = W.partitionBy(key).orderBy("__month").rowsBetween(W.unboundedPreceding, -1)
    offset = (month.groupBy(key, "__month").agg(F.count(F.lit(1)).alias("__n"))
              .select(key, "__month", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    placed = (month.withColumn("__in", F.row_number().over(inside) - 1).join(offset, [key, "__month"])
              .withColumn("__pos", F.col("__in") + F.col("__before")))
    block = F.floor(F.col("__pos") / max_rows)
    tail = F.col("__pos") % max_rows >= max_rows - halo
    targets = F.when(tail, F.array(F.struct(block.alias("b"), F.lit(False).alias("h")),
                                   F.struct((block + 1).alias("b"), F.lit(True).alias("h")))) \
               .otherwise(F.array(F.struct(block.alias("b"), F.lit(False).alias("h"))))
    out = placed.withColumn("__t", F.explode(targets)).select(*df.columns, F.col("__t.b").alias("series_block"),
                                                              F.col("__t.h").alias("is_halo"))
    return out, [key, "series_block"]
