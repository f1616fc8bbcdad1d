"""Helpers of several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_SHARE = 1000


def spread_join(rows: DataFrame, side: DataFrame, key: str, n: str, total: int, columns: list[str]) -> DataFrame:
    """`rows` with `columns` of `side`, which has one row for each key and in `n` the number of rows that carry it.

    Fewer than HOT_SHARE keys can each have more than 1 / HOT_SHARE of all `total` rows. These are broadcast
    (their number is bounded by that), so no key gathers its rows in one task; the others meet by key.
    """
    names = {c: f"__hot_{c}" for c in [key, *columns]}
    hot = side.where(F.col(n) > total / HOT_SHARE).select(*[F.col(c).alias(a) for c, a in names.items()])
    met = rows.join(F.broadcast(hot), F.col(key) == F.col(names[key]), "left")
    own = [F.col(f"`{c}`") for c in rows.columns]
    common = met.where(F.col(names[key]).isNotNull()).select(*own, *[F.col(names[c]).alias(c) for c in columns])
    rest = met.where(F.col(names[key]).isNull()).select(*own).join(side.select(F.col(key).alias("__key"), *columns), F.col(key) == F.col("__key"))
    return common.unionByName(rest.select(*own, *columns))
