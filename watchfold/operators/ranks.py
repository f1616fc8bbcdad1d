"""Exact cumulative sums and percentiles without a one-task sort.

Values are counted per distinct value first, cut into ordered ranges, summed per
range, and only then cumulated inside each range. A hot value is one row after the
first step; a hot group spreads over its ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from watchfold.session import materialize

RANGES = 64


def cumulative(df: DataFrame, groups: list[str], key: str, sums: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """Per group and distinct key: the sums, their running totals `<name>_cum` (key ascending,
    inclusive) and the group totals `<name>_total`."""
    agg = df.groupBy(*groups, key).agg(*[c.alias(n) for n, c in sums.items()])
    steps = F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)])
    cuts = agg.where(F.col(key).isNotNull()).groupBy(*groups).agg(F.percentile_approx(key, steps, F.lit(1000)).alias("__cuts"))
    joined = agg.join(cuts, groups, "left") if groups else agg.crossJoin(F.broadcast(cuts))
    cut = joined.withColumn("__range", F.size(F.filter("__cuts", lambda b: b < F.col(key)))).drop("__cuts")
    totals = cut.groupBy(*groups, "__range").agg(*[F.sum(n).alias(n) for n in sums])
    upto = W.partitionBy(*groups).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*groups)
    offsets = totals.select(*groups, "__range",
                            *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(f"__{n}_before") for n in sums],
                            *[F.sum(n).over(whole).alias(f"{n}_total") for n in sums])
    inside = W.partitionBy(*groups, "__range").orderBy(key)
    running = cut.select("*", *[F.sum(n).over(inside).alias(f"__{n}_in") for n in sums])
    out = running.join(offsets, [*groups, "__range"])
    return out.select(*groups, key, *sums,
                      *[(F.col(f"__{n}_before") + F.col(f"__{n}_in")).alias(f"{n}_cum") for n in sums],
                      *[F.col(f"{n}_total") for n in sums])


def _ranged(df: DataFrame, value: str, ranges: int) -> DataFrame:
    """`__range`: number of the sorted `__cuts` below the value, by halving; one comparison a halving instead of one a cut."""
    step, df = 1 << ((ranges - 1).bit_length() - 1), df.withColumn("__range", F.lit(0))
    while step:
        df = df.withColumn("__range", F.col("__range") + F.when(F.get("__cuts", F.col("__range") + (step - 1)) < F.col(value), step).otherwise(0))
        step >>= 1
    return df


def percentiles(df: DataFrame, groups: list[str], value: str, points: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """Exact linear-interpolated percentiles of the non-null values per group.

    The values are written once and counted per ordered range. Only the ranges that hold a wanted place are sorted, so no task
    sorts or hashes all values; cuts and wanted ranges are written too, which tells the planner how small they are."""
    rows = materialize(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*groups, value), "values")
    steps = F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)])
    cuts = materialize(rows.groupBy(*groups).agg(F.percentile_approx(value, steps, F.lit(1000)).alias("__cuts")), "cuts")
    joined = rows.join(cuts, groups) if groups else rows.crossJoin(F.broadcast(cuts))
    cut = _ranged(joined, value, ranges).drop("__cuts")
    upto = W.partitionBy(*groups).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    counted = cut.groupBy(*groups, "__range").agg(F.count(F.lit(1)).alias("__n")).select(
        *groups, "__range", "__n", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy(*groups)).alias("__n_total"))
    place = lambda q: (F.col("__n_total") - 1) * F.lit(float(q))
    holds = [(F.col("__before") <= side(place(q))) & (side(place(q)) < F.col("__before") + F.col("__n")) for q in points.values() for side in (F.floor, F.ceil)]
    wanted = materialize(counted.where(reduce(lambda a, b: a | b, holds)).drop("__n"), "wanted")
    cum = cut.join(wanted, [*groups, "__range"]).groupBy(*groups, "__range", "__before", "__n_total", value).agg(F.count(F.lit(1)).alias("__n"))
    cum = cum.withColumn("__n_cum", F.col("__before") + F.sum("__n").over(W.partitionBy(*groups, "__range").orderBy(value)))
    first, last, total = F.col("__n_cum") - F.col("__n"), F.col("__n_cum") - 1, F.col("__n_total")
    v = F.col(value).cast("double")
    aggs = []
    for name, q in points.items():
        pos = place(q)
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when((first <= rank) & (rank <= last), v)).alias(f"__{name}_{side}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"__{name}_w"))
    res = cum.groupBy(*groups).agg(F.max(total).alias("n"), *aggs)
    return res.select(*groups, "n", *[
        (F.col(f"__{name}_lo") + (F.col(f"__{name}_hi") - F.col(f"__{name}_lo")) * F.col(f"__{name}_w")).alias(name)
        for name in points])


def positions(df: DataFrame, groups: list[str], order: list[str], name: str, max_rows: int = 2_000_000, ranges: int = RANGES) -> DataFrame:
    """Zero-based position of each row in its group by `order` (a strict order, first column numeric).

    Usual case: one window per group. When a group is longer than `max_rows`, its first order
    column is cut into ranges, rows are counted per range and ranked inside it only."""
    longest = df.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    if longest <= max_rows:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*groups).orderBy(*order)) - 1)
    steps = F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)])
    cuts = df.groupBy(*groups).agg(F.percentile_approx(order[0], steps, F.lit(1000)).alias("__cuts"))
    cut = df.join(cuts, groups).withColumn("__range", F.size(F.filter("__cuts", lambda b: b < F.col(order[0])))).drop("__cuts")
    before = W.partitionBy(*groups).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut.groupBy(*groups, "__range").agg(F.count(F.lit(1)).alias("__n")).select(*groups, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy(*groups, "__range").orderBy(*order)) - 1
    return cut.withColumn("__in", inside).join(offsets, [*groups, "__range"]).withColumn(name, F.col("__in") + F.col("__before")).drop("__in", "__before", "__range")
