"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL_FOLDER: dict[str, str] = {}


def build_session(app: str = "watchfold", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by spark.checkpoint.dir.

    A machine-local folder is used only in local mode with the setting absent.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    key = spark.conf.get("spark.app.id", "local")
    if key not in _LOCAL_FOLDER:
        _LOCAL_FOLDER[key] = tempfile.mkdtemp(prefix="watchfold-")
    return _LOCAL_FOLDER[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write `df` once to the shared folder, in folders by the columns `by` (texts that are not empty), and read it back.

    The result has no lineage and survives the loss of executors. Iterative
    operators call this once per round, so plans do not grow.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, tuple]:
    """`materialize` plus aggregate values of the written rows, observed during the same job."""
    seen = Observation(name)
    out = materialize(df.observe(seen, *[m.alias(f"m{i}") for i, m in enumerate(metrics)]), name)
    values = seen.get
    return out, tuple(values[f"m{i}"] for i in range(len(metrics)))


class Scratch:
    """Tables of one operator run below the shared folder.

    `table` writes a DataFrame and reads it back like `materialize`; `drop` removes a table that
    nothing reads any more, so an iterative operator keeps one round on disk instead of all.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self._paths = spark, scratch_path(spark, name), {}

    def table(self, df: DataFrame, *metrics: Column) -> DataFrame | tuple[DataFrame, tuple]:
        """With metrics: also their values over the written rows, observed during the same job."""
        path = f"{self.root}/{len(self._paths)}"
        seen = Observation() if metrics else None
        (df.observe(seen, *[m.alias(f"m{i}") for i, m in enumerate(metrics)]) if metrics else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return (out, tuple(seen.get[f"m{i}"] for i in range(len(metrics)))) if metrics else out

    def drop(self, df: DataFrame) -> None:
        _, path = self._paths[id(df)]
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
