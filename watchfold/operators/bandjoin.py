"""Interval ("band") joins as equi joins on time cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Rows of one (keys, time cell) that may meet in one task before the cell is salted.
MAX_CELL_ROWS = 200_000


def time_cell(us: Column, window_us: int) -> Column:
    """Number of the window-long cell of a microsecond instant, in exact integer arithmetic."""
    return ((us - F.pmod(us, F.lit(window_us))) / window_us).cast("long")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_us: str, right_us: str, window_us: int,
              max_cell_rows: int = MAX_CELL_ROWS) -> DataFrame:
    """Pairs with equal `keys` and |left_us - right_us| <= window_us (inclusive), each once.

    Time is cut into cells of the window length. A right row is copied into the cells next
    to its own, so each pair meets in exactly one cell and needs no later deduplication.
    Cells with too many left rows are salted: left rows spread by hash, right rows are
    copied to every salt of such a cell. Columns other than `keys` must differ by name.
    """
    cell = lambda us: time_cell(F.col(us), window_us)
    l = left.withColumn("__cell", cell(left_us))
    r = right.withColumn("__cell", F.explode(F.sequence(cell(right_us) - 1, cell(right_us) + 1)))
    on = [*keys, "__cell"]
    # One plan for all sizes: cells without an entry in `hot` have one salt. There is at most one hot cell for `max_cell_rows` left rows,
    # so the table is broadcast, and neither side is shuffled for its salts.
    hot = F.broadcast(l.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max_cell_rows)
           .select(*on, F.ceil(F.col("__n") / max_cell_rows).cast("int").alias("__salts")))
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    l = l.join(hot, on, "left").withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), salts).cast("int")).drop("__salts")
    r = r.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    on = [*on, "__salt"]
    joined = l.join(r, on).where(F.abs(F.col(left_us) - F.col(right_us)) <= window_us)
    return joined.drop("__cell", "__salt")


def side(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """Columns prefixed for one side of a self join; keys keep their names."""
    return df.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keys])
