"""Exact nearest vectors and ranked retrieval: matrix products of the cells that a bound cannot rule out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from watchfold.operators import balls
from watchfold.operators.balls import unit
from watchfold.session import Scratch

# Rows of one side that meet in one task.
BLOCK_ROWS = 8192
ABSTENTION_THRESHOLD = 0.5922  # fixed value


def _blocks(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def _leading(scores: np.ndarray, docs: np.ndarray, keep: int, cap: int | None) -> np.ndarray:
    """Places of the rows that can reach the final `keep` results, best first, ties by place."""
    if len(scores) > keep:
        if cap is None:
            least = np.partition(scores, -keep)[-keep]
        else:
            best = np.full(docs.max() + 1, -np.inf)
            np.maximum.at(best, docs, scores)
            best = best[best > -np.inf]
            least = np.partition(best, -keep)[-keep] if len(best) >= keep else -np.inf
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    order = near[np.argsort(-scores[near], kind="stable")]
    if cap is None:
        return order[:keep]
    d = docs[order]
    turn = pd.Series(d).groupby(d).cumcount().to_numpy()
    leading = d[turn == 0][:keep]
    return np.union1d(order[:keep], order[(turn < cap) & np.isin(d, leading)])


def _scored(queries: DataFrame, gallery: DataFrame, keep: int, cap: int | None, block_rows: int) -> DataFrame:
    """Candidates of queries (query_id, mask, vec, cell, part, floor) among the gallery rows of their cell and part.

    Both meet in bounded groups whose scores are a matrix product, and only a group's own best rows leave it, none below the query's floor."""
    nq = _blocks(queries, block_rows)
    q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int"))
    g = gallery.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    names = ["query_id", "item_id", "document_id", "score"]

    def cell(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        right = right.sort_values("item_id").reset_index(drop=True)
        scores = unit(left["vec"]) @ unit(right["vec"]).T
        allowed = (left["mask"].to_numpy()[:, None] & right["mask"].to_numpy()[None, :]) != 0
        allowed &= scores >= left["floor"].to_numpy()[:, None]
        docs = pd.factorize(right["document_id"])[0]
        taken = []
        for i in range(len(left)):
            idx = np.flatnonzero(allowed[i])
            taken.append(idx[_leading(scores[i, idx], docs[idx], keep, cap)] if len(idx) else idx)
        rows, places = np.repeat(np.arange(len(left)), [len(t) for t in taken]), np.concatenate(taken)
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[rows], "item_id": right["item_id"].to_numpy()[places],
                             "document_id": right["document_id"].to_numpy()[places], "score": scores[rows, places]})

    types = {f.name: f.dataType.simpleString() for f in gallery.schema.fields} | {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    schema = f"query_id {types['query_id']}, item_id {types['item_id']}, document_id {types['document_id']}, score double"
    keys = ["cell", "part", "qb"]
    return q.groupBy(*keys).cogroup(g.groupBy(*keys)).applyInPandas(cell, schema)


def cosine_candidates(queries: DataFrame, gallery: DataFrame, keep: int, cap: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, item_id, document_id, score): for each query every row that can reach its final `keep` results.

    queries: query_id, mask, vec; gallery: item_id, document_id, mask, vec. A pair is eligible when the masks share a bit.

    The gallery lies in cells of about `block_rows` rows around pivots (`balls`). A query first meets its most promising cells; the score of its `keep`-th
    row there (with a cap: of its `keep`-th document) is a floor that later rows must reach. Then it meets only those other cells in which a row
    can reach the floor. A query that finds fewer than `keep` meets all cells, so results are exact whatever the data. Neither side is broadcast or
    collected; pivots, and one size and radius for each, are at most MAX_PIVOTS rows.

    With a per-document cap a group keeps its best `keep` rows and the best `cap` rows of its
    best `keep` documents: a row left out has `keep` better documents, or `keep` better rows."""
    scratch = Scratch(queries.sparkSession, "vectors")
    q = queries.select("query_id", "mask", "vec")
    gallery = gallery.select("item_id", "document_id", "mask", "vec")
    centres = balls.pivots(gallery, "item_id", _blocks(gallery, block_rows))
    if not len(centres):
        return q.join(gallery, F.lit(False)).select("query_id", "item_id", "document_id", F.lit(0.0).alias("score"))
    g = scratch.table(balls.placed(gallery, centres))
    cells = g.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), (F.max("angle") + balls.SLACK).alias("radius")).orderBy("cell").toPandas()
    split = F.create_map(*[F.lit(int(v)) for c, n in zip(cells["cell"], cells["rows"]) for v in (c, -(-n // block_rows))])
    g = g.select("item_id", "document_id", "mask", "vec", "cell", F.pmod(F.xxhash64("item_id"), split[F.col("cell")]).cast("int").alias("part"))
    aim = balls.aimed(q, centres, cells, 4 * keep)
    if len(cells) > 1:
        aim = scratch.table(aim)
    parts = lambda df: df.select("query_id", "mask", "vec", "cell", F.explode(F.sequence(F.lit(0), split[F.col("cell")] - 1)).alias("part"), "floor")
    found = _scored(parts(aim.select("query_id", "mask", "vec", F.explode("first").alias("cell"), F.lit(-2.0).alias("floor"))), g, keep, cap, block_rows)
    if len(cells) == 1:
        return found
    found = scratch.table(found)
    best = found if cap is None else found.groupBy("query_id", "document_id").agg(F.max("score").alias("score"))
    floors = best.groupBy(F.col("query_id").alias("__id")).agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(keep - 1)).alias("floor"))
    floors = floors.withColumn("floor", F.coalesce(F.col("floor") - balls.SLACK, F.lit(-2.0)))
    later = aim.join(floors, F.col("query_id") == F.col("__id"), "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    left = later.select("query_id", "mask", "vec", "floor", F.explode(F.filter("later", lambda c: c["bound"] >= F.col("floor"))).alias("c")).withColumn("cell", F.col("c.cell"))
    return found.unionByName(_scored(parts(left), g, keep, cap, block_rows))


def retrieve(queries: DataFrame, gallery: DataFrame, top_k: int = 5, ranking: str = "controlled", abstain: bool = False,
             threshold: float = ABSTENTION_THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Ranked results per query: raw, diverse (first of each document, then the rest) or controlled (two per document, then the rest)."""
    cap = {"raw": None, "diverse": 1, "controlled": 2}[ranking]
    c = cosine_candidates(queries, gallery, top_k, cap, block_rows)
    by_score = [F.desc("score"), "item_id"]
    if cap is not None:
        c = c.withColumn("__turn", F.row_number().over(W.partitionBy("query_id", "document_id").orderBy(*by_score)))
        by_score = [(F.col("__turn") > cap).cast("int"), *by_score]
    ranked = c.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*by_score)))
    if abstain:
        ranked = ranked.withColumn("__best", F.max("score").over(W.partitionBy("query_id"))).where(F.col("__best") >= threshold)
    return ranked.where(F.col("rank") <= top_k).select("query_id", "rank", "item_id", "document_id", "score")


def nearest_enrolled(queries: DataFrame, enrolled: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Nearest enrolled vector by cosine distance and the recognition decision. enrolled: item_id, document_id (owner), vec."""
    open_mask = F.lit(1).cast("long")
    c = cosine_candidates(queries.withColumn("mask", open_mask), enrolled.withColumn("mask", open_mask), 1, None, block_rows)
    best = c.groupBy("query_id").agg(F.max_by(F.struct("document_id", "item_id", "score"), F.struct("score", -F.col("item_id"))).alias("b"))
    distance = 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("b.score")))
    return best.select("query_id", F.col("b.document_id").alias("nearest_owner"), distance.alias("distance"),
                       F.when(distance <= threshold, "RECOGNIZED").otherwise("UNKNOWN").alias("recognition_status"),
                       F.when(distance <= threshold, F.col("b.document_id").cast("string")).otherwise("UNKNOWN").alias("person_id"))
