"""Nearest vectors by inner product with randomly rotated one-bit codes.

Index: a vector x of norm |x| and direction o is stored with the signs of R o, one bit for each dimension (R: a random rotation from a
fixed seed), and the correction f = <o, signs / sqrt(D)>. For a query direction q, <signs / sqrt(D), R q> / f estimates <o, q>
without bias, and the error stays below eps * sqrt((1 - f^2) / f^2) / sqrt(D - 1) except with a chance that falls as exp(-c eps^2). Every row is
indexed; nothing is trained.

Search: rows are dealt into blocks of about `BLOCK_ROWS`, queries into blocks of about `BLOCK_QUERIES`; every pair of blocks is one
group. A group estimates all its products from the codes, scores the `FIRST` best estimates of each query exactly, takes the
k-th exact score as the query's bar, and scores every other row whose upper bound reaches it: first by a matrix product, then those that may still be among
the k best in the order of their components. Its k best leave the group, and a query's k best of all groups are its result. Rows are copied once for each query block, queries once for each row block.

Edge cases: vectors that are null, zero, empty, or hold a null or non-finite component take no part, as queries or candidates; so do
vectors whose length is not the most frequent one (of equally frequent lengths, the greatest). Repeated rows are rows of their own: a query
meets its copies, never itself. Equal scores: smaller vec_id first, null last. Fewer than k candidates: all. Empty table: empty result.
Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from watchfold.llm.registry import query, table
from watchfold.session import Scratch

K, EPS, SEED = 20, 3.0, 20240607
BLOCK_ROWS, BLOCK_QUERIES, FIRST = 8192, 1024, 64
CELLS = 1 << 22  # estimates held at once


def rotation(dim: int) -> np.ndarray:
    """Random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norms and corrections."""
    dim = vectors.shape[1]
    peak = np.abs(vectors).max(axis=1, initial=0)  # scaled first, so that huge or tiny components neither overflow nor vanish
    scaled = vectors / peak[:, None]
    length = np.sqrt((scaled ** 2).sum(axis=1))
    turned = scaled @ rotation(dim).T / length[:, None]
    return np.packbits(turned > 0, axis=1, bitorder="little"), peak * length, np.abs(turned).sum(axis=1) / np.sqrt(dim)


def _encode_batches(batches, dim):
    for batch in batches:
        code, norm, fit = encode(matrix(batch.column(2), dim))
        width = code.shape[1]
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], packed, pa.array(norm), pa.array(fit)], ["uid", "vec_id", "vector", "code", "norm", "fit"])


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def index(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(uid, vec_id, vector, code, norm, fit) for every usable row, written once, and the dimension."""
    v = F.col("embedding").cast("array<double>")
    fit = vectors.select("vec_id", v.alias("vector")).where(usable(F.col("vector")))
    common = fit.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 1
    rows = fit.where(F.size("vector") == dim).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), "vector")
    return scratch.table(rows.mapInArrow(partial(_encode_batches, dim=dim), "uid long, vec_id long, vector array<double>, code binary, norm double, fit double")), dim


def _exact(queries: np.ndarray, rows: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of pairs, summed in the order of the components."""
    total = np.zeros(len(qi))
    for d in range(rows.shape[1]):
        total += queries[qi, d] * rows[xi, d]
    return total


def _contenders(query: np.ndarray, rows: np.ndarray, reached: np.ndarray, norm: np.ndarray, q_norm: float, k: int) -> np.ndarray:
    """Of the rows `reached` by the bound, those that can be among the k best whatever the order of summation."""
    if len(reached) <= k:
        return reached
    score = rows[reached] @ query
    if not np.isfinite(score).all():
        return reached
    error = 4 * len(query) * np.finfo(float).eps * float(q_norm) * norm[reached]
    return reached[score + error >= np.partition(score - error, len(reached) - k)[len(reached) - k]]


def search_block(queries: pa.Table, rows: pa.Table, dim: int, k: int, eps: float) -> pa.Table:
    """The k best rows of the block for each query of the block."""
    q, x = matrix(queries["vector"], dim), matrix(rows["vector"], dim)
    q_id, x_id = queries["uid"].to_numpy(), rows["uid"].to_numpy()
    ids = rows["vec_id"].combine_chunks()
    place = np.where(ids.is_null(), np.iinfo(np.int64).max, ids.fill_null(0).to_numpy(zero_copy_only=False))
    codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(x), -1)
    signs = np.unpackbits(codes, axis=1, count=dim, bitorder="little").astype(np.float32) * 2 - 1
    norm, fit = rows["norm"].to_numpy(), rows["fit"].to_numpy()
    scale = (norm / fit / np.sqrt(dim)).astype(np.float32)
    slack = (eps * norm * np.sqrt(np.maximum(0, 1 - fit ** 2)) / fit / np.sqrt(max(1, dim - 1))).astype(np.float32)
    turned = (q @ rotation(dim).T).astype(np.float32)
    q_norm = np.linalg.norm(q, axis=1).astype(np.float32)
    out_q, out_x, out_s = [], [], []
    step = max(1, CELLS // max(1, len(x)))
    for at in range(0, len(q), step):
        near = turned[at:at + step] @ signs.T * scale
        near[q_id[at:at + step, None] == x_id[None, :]] = -np.inf
        n = len(near)
        first = min(len(x), max(FIRST, k))
        top = np.argpartition(-near, first - 1, axis=1)[:, :first] if first < len(x) else np.broadcast_to(np.arange(len(x)), (n, len(x)))
        best = _exact(q, x, np.repeat(np.arange(at, at + n), first), top.ravel()).reshape(n, first)
        best[np.isneginf(np.take_along_axis(near, top, 1))] = -np.inf
        bar = np.partition(best, first - k, axis=1)[:, first - k] if first >= k else np.full(n, -np.inf)
        np.put_along_axis(near, top, np.where(np.isneginf(np.take_along_axis(near, top, 1)), -np.inf, np.inf), 1)  # of the first, any may be among the k best
        chosen_rows = [_contenders(q[at + i], x, np.flatnonzero((near[i] + q_norm[at + i] * slack >= bar[i]) & ~np.isneginf(near[i])), norm, q_norm[at + i], k)
                       for i in range(n)]
        qi = np.repeat(np.arange(n), [len(c) for c in chosen_rows])
        xi = np.concatenate(chosen_rows) if n else np.empty(0, np.int64)
        score = _exact(q, x, qi + at, xi)
        order = np.lexsort((place[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        start = np.r_[0, np.cumsum(np.bincount(qi, minlength=n))][:-1]
        kept = np.arange(len(qi)) - start[qi] < k
        out_q.append(q_id[qi[kept] + at]), out_x.append(xi[kept]), out_s.append(score[kept])
    chosen = pa.array(np.concatenate(out_x) if out_x else np.empty(0, np.int64))
    return pa.table({"query_uid": np.concatenate(out_q) if out_q else np.empty(0, np.int64), "uid": rows["uid"].take(chosen), "vec_id": rows["vec_id"].take(chosen),
                     "score": np.concatenate(out_s) if out_s else np.empty(0)})


def search(vectors: DataFrame, is_query: Column, k: int = K, eps: float = EPS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that `is_query` (over vec_id) takes as a query."""
    scratch = Scratch(vectors.sparkSession, "ann")
    rows, dim = index(vectors, scratch)
    asked = rows.where(is_query)
    n, n_asked = rows.count(), asked.count()
    blocks, asked_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_asked // BLOCK_QUERIES))
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    place = lambda m: F.pmod(F.xxhash64("uid"), F.lit(m)).cast("int")
    left = asked.select(place(asked_blocks).alias("qb"), all_of(blocks).alias("xb"), "uid", "vector")
    right = rows.select(all_of(asked_blocks).alias("qb"), place(blocks).alias("xb"), "uid", "vec_id", "vector", "code", "norm", "fit")

    def one(queries: pa.Table, block: pa.Table) -> pa.Table:
        return search_block(queries, block, dim, k, eps)

    found = left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInArrow(one, "query_uid long, uid long, vec_id long, score double")
    order = W.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select(F.col("uid").alias("query_uid"), F.col("vec_id").alias("query_id"))
    return best.join(names, "query_uid").select("query_id", "rank", "vec_id", "score")


ANN_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, list_reduce(list_transform(list_zip(q.e, x.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
      FROM u q JOIN u x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


@query("op9_ann", ANN_SQL)
def op9_ann(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
