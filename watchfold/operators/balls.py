"""Cells of unit vectors around pivots, and which of them a query can skip.

Angles between unit vectors obey the triangle inequality: no row of a cell is nearer to a query than the angle to the cell's pivot less the
cell's radius. Pivots are a bounded sample of the rows; any sample gives exact results, a better one smaller cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Pivots at most; they travel with the tasks, as do the cells' sizes and radii.
MAX_PIVOTS = 1024
#: Rounding of a scalar product and of its arc cosine.
SLACK = 1e-7


def unit(rows: pd.Series) -> np.ndarray:
    """Rows of length one; a zero vector stays zero."""
    m = np.stack(rows.to_numpy()).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def pivots(gallery: DataFrame, key: str, n: int) -> np.ndarray:
    """At most min(n, MAX_PIVOTS) rows of `gallery`, those with the smallest hashes, as unit vectors."""
    rows = gallery.select("vec", F.xxhash64(key).alias("h")).orderBy("h").limit(min(n, MAX_PIVOTS)).select("vec").toPandas()
    return unit(rows["vec"]) if len(rows) else np.zeros((0, 0))


def placed(gallery: DataFrame, centres: np.ndarray) -> DataFrame:
    """`gallery` with its cell, that of the nearest pivot, and the angle to it. Zero vectors have a cell of their own behind the others."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in gallery.schema.fields) + ", cell int, angle double"

    def run(batches):
        for b in batches:
            if b.empty:
                continue
            m = unit(b["vec"])
            near = m @ centres.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(m)), cell], -1, 1))
            zero = ~m.any(axis=1)
            yield b.assign(cell=np.where(zero, len(centres), cell).astype(np.int32), angle=np.where(zero, np.pi, angle))

    return gallery.mapInPandas(run, schema)


def aimed(queries: DataFrame, centres: np.ndarray, cells: pd.DataFrame, enough: int) -> DataFrame:
    """`queries` with `first`, the most promising cells that hold `enough` rows together, and `later`, the other cells with the greatest
    score that a row in them can have. cells: cell, rows, radius."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields) + ", first array<int>, later array<struct<cell: int, bound: double>>"
    number, rows, radius = cells["cell"].to_numpy(), cells["rows"].to_numpy(), cells["radius"].to_numpy()

    def run(batches):
        for b in batches:
            if b.empty:
                continue
            away = np.arccos(np.clip(unit(b["vec"]) @ centres.T, -1, 1))
            away = np.concatenate([away, np.zeros((len(b), 1))], axis=1)[:, number]  # the cell of zero vectors is never skipped
            bound = np.cos(np.maximum(away - radius, 0))
            order = np.argsort(-bound, axis=1, kind="stable")
            first, later = [], []
            for k, o in enumerate(order):
                n = int(np.searchsorted(np.cumsum(rows[o]), enough)) + 1
                first.append(number[o[:n]].tolist())
                later.append([{"cell": int(number[c]), "bound": float(bound[k, c])} for c in o[n:]])
            yield b.assign(first=first, later=later)

    return queries.mapInPandas(run, schema)
