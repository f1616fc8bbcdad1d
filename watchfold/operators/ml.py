"""Model jobs: scaling, forests, boosted trees, isolation forest, reconstruction error."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from watchfold.operators import ranks
from watchfold.session import scratch_path

# Forest settings.
FOREST_TREES, FOREST_LEAF, ISOLATION_TREES, ISOLATION_SAMPLE = 300, 2, 200, 256


def log_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """log1p of count columns; a negative count is an error."""
    check = lambda c: F.when(F.col(c) < 0, F.raise_error(F.lit(f"negative count in {c}"))).otherwise(F.log1p(c))
    return df.withColumns({c: check(c) for c in columns})


def robust_scaling(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median and IQR per column (IQR 1 when 0), one row per column."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "column", "v")
    p = ranks.percentiles(long, ["column"], "v", {"median": .5, "q25": .25, "q75": .75})
    iqr = F.col("q75") - F.col("q25")
    return p.select("column", "median", F.when(iqr > 0, iqr).otherwise(F.lit(1.0)).alias("scale"))


def scale(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / IQR; the statistics are one row per column and ride along as one packed row."""
    packed = stats.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("median", "scale")))).alias("__s"))
    return df.crossJoin(F.broadcast(packed)).withColumns({c: (F.col(c) - F.col("__s")[c]["median"]) / F.col("__s")[c]["scale"] for c in columns}).drop("__s")


def forest_pipeline(features: list[str], label: str = "target", trees: int = FOREST_TREES, depth: int = 12, seed: int = 42) -> Pipeline:
    """Median imputer and random forest with square-root feature sampling."""
    filled = [f"{c}__f" for c in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"),
        RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, minInstancesPerNode=FOREST_LEAF, featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed)])


def boosted_pipeline(features: list[str], category: str | None = None, label: str = "target", rounds: int = 50, seed: int = 42) -> Pipeline:
    """Gradient-boosted comparison model, optionally with a one-hot hardware column."""
    filled = [f"{c}__f" for c in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled)]
    inputs = list(filled)
    if category:
        stages += [StringIndexer(inputCol=category, outputCol=f"{category}__i", handleInvalid="keep"), OneHotEncoder(inputCols=[f"{category}__i"], outputCols=[f"{category}__o"])]
        inputs.append(f"{category}__o")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features"), GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, seed=seed)])


def fit_and_store(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """Fit, write the model to the shared folder and load it back. The loaded model carries no training
    summary, which holds on to the session and cannot be shipped to tasks once a query was observed."""
    path = scratch_path(train.sparkSession, "model")
    pipeline.fit(train).write().save(path)
    return PipelineModel.load(path)


def score(model, df: DataFrame, required: list[str]) -> DataFrame:
    """Batch scoring with a column contract; probability of the positive class."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing model columns: {', '.join(missing)}")
    return model.transform(df).withColumn("probability", vector_to_array("probability")[1])


def feature_importance(spark, model, features: list[str]) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()[:len(features)]
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double").orderBy(F.desc("importance"))


# ---- isolation forest -----------------------------------------------------------

def average_path(n):
    """Expected depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (id, feature, threshold, left, right, depth value of a leaf)."""
    nodes, open_nodes, nxt = [], [(0, points, 0)], 1
    while open_nodes:
        at, rows, depth = open_nodes.pop()
        spans = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else []
        if depth >= limit or len(rows) <= 1 or len(spans) == 0:
            nodes.append((at, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))))
            continue
        f = int(rng.choice(spans))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        left = rows[:, f] < cut
        nodes.append((at, f, cut, nxt, nxt + 1, 0.0))
        open_nodes += [(nxt, rows[left], depth + 1), (nxt + 1, rows[~left], depth + 1)]
        nxt += 2
    return nodes


def fit_isolation_forest(df: DataFrame, key: list[str], features: list[str], trees: int = ISOLATION_TREES, sample: int = ISOLATION_SAMPLE, seed: int = 42) -> DataFrame:
    """Node table of the forest. Rows are dealt to trees by hash and thinned by hash to about twice
    the sample, so a tree's group stays small whatever the table size; `sample` rows of it build the tree."""
    n = df.count()
    copies = max(1, -(-trees * sample * 2 // max(n, 1)))
    share = min(1.0, trees * sample * 2 / max(n * copies, 1))
    h = lambda salt: F.xxhash64(*[F.col(k).cast("string") for k in key], F.col("copy"), F.lit(seed), F.lit(salt))
    dealt = df.select(*key, *features, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")) \
        .withColumn("tree", F.pmod(h("tree"), F.lit(trees)).cast("int")).withColumn("order", h("order")) \
        .where(F.pmod(h("keep"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    limit = int(np.ceil(np.log2(sample)))

    def build(group, pdf: pd.DataFrame) -> pd.DataFrame:
        picked = pdf.sort_values("order")[features].to_numpy(dtype=np.float64)[:sample]
        nodes = _grow(picked, np.random.default_rng(seed * 100_003 + int(group[0])), limit)
        return pd.DataFrame([(group[0], *x) for x in nodes], columns=["tree", "node", "feature", "threshold", "left", "right", "depth"])

    return dealt.groupBy("tree").applyInPandas(build, "tree int, node int, feature int, threshold double, left int, right int, depth double")


def isolation_score(df: DataFrame, forest: DataFrame, features: list[str], sample: int = ISOLATION_SAMPLE) -> DataFrame:
    """Anomaly score 2^(-mean depth / expected depth). The node table has at most trees x (2 x sample - 1)
    rows by construction, so it is the one table brought to the driver and shipped to the tasks."""
    table = forest.toPandas()
    packed = []
    for _, t in table.groupby("tree"):
        t = t.sort_values("node")
        packed.append((t["feature"].to_numpy(), t["threshold"].to_numpy(), t["left"].to_numpy(), t["right"].to_numpy(), t["depth"].to_numpy()))
    trees = df.sparkSession.sparkContext.broadcast(packed)
    expected = float(average_path(sample))

    @F.pandas_udf("double")
    def anomaly(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=np.float64) for c in cols])
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, left, right, depth in trees.value:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.maximum(f, 0)] < threshold[at]
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            total += depth[at]
        return pd.Series(np.power(2.0, -(total / len(trees.value)) / expected))

    return df.withColumn("anomaly_score", anomaly(*[F.col(c).cast("double") for c in features]))


def flag_by_contamination(scored: DataFrame, contamination: float, score_column: str = "anomaly_score") -> DataFrame:
    cut = ranks.percentiles(scored, [], score_column, {"cut": 1 - contamination}).select("cut")
    return scored.crossJoin(F.broadcast(cut)).withColumn("if_prediction", F.when(F.col(score_column) > F.col("cut"), "ANOMALOUS").otherwise("NORMAL")).drop("cut")


def contamination_sweep(scored: DataFrame, levels: list[float], score_column: str = "anomaly_score") -> DataFrame:
    """Flagged rows per contamination level from one ranked pass."""
    names = {f"c{i}": 1 - c for i, c in enumerate(levels)}
    cuts = ranks.percentiles(scored, [], score_column, names)
    cells = F.array(*[F.struct(F.lit(c).alias("contamination"), F.col(f"c{i}").alias("cut")) for i, c in enumerate(levels)])
    one = cuts.select(F.inline(cells))
    hits = scored.select(score_column).join(F.broadcast(one), F.col(score_column) > F.col("cut"))
    return one.join(hits.groupBy("contamination").agg(F.count(F.lit(1)).alias("flagged")), "contamination", "left").select("contamination", F.round("cut", 6).alias("cut"), F.coalesce("flagged", F.lit(0)).alias("flagged"))


# ---- reconstruction error ------------------------------------------------------------

def fit_linear_encoder(train: DataFrame, features: list[str], dimensions: int):
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), PCA(k=dimensions, inputCol="__x", outputCol="__z")]).fit(train)


def reconstruction_error(model, df: DataFrame, features: list[str]) -> DataFrame:
    """Mean squared error of the projection onto the principal components (features are centred by the scaling before)."""
    basis = model.stages[-1].pc.toArray()  # features x dimensions, model size
    coded = model.transform(df).withColumn("__z", vector_to_array("__z"))
    back = [sum((F.col("__z")[j] * F.lit(float(basis[i, j])) for j in range(basis.shape[1])), F.lit(0.0)) for i in range(len(features))]
    err = sum(((F.col(c) - b) ** 2 for c, b in zip(features, back)), F.lit(0.0)) / len(features)
    return coded.withColumn("reconstruction_error", err).drop("__x", "__z")


def flag_by_error(scored: DataFrame, validation: DataFrame, quantile: float = 0.99) -> DataFrame:
    """ANOMALOUS above the exact quantile of the validation errors (strictly)."""
    cut = ranks.percentiles(validation, [], "reconstruction_error", {"cut": quantile}).select("cut")
    return scored.crossJoin(F.broadcast(cut)).withColumn("ae_prediction", F.when(F.col("reconstruction_error") > F.col("cut"), "ANOMALOUS").otherwise("NORMAL")).drop("cut")
