"""Session helpers: a local session for tests and benches, and the shared
checkpoint folder used to cut lineage on a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "featurespark") -> SparkSession:
    """Local session for tests and benches (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


#: temporary folders of local sessions that name none
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    It must be set on a cluster; only a local session gets a temporary one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="featurespark-")
    return configured.rstrip("/")


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package when it runs from a checkout instead of an
    installation (executors that see the folder, or local mode)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def stage(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: computed once,
    column-pruned by its readers, with statistics, and safe when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _staged(df.sparkSession).append(path)
    return out


_STAGED: dict[str, list[str]] = {}


def _staged(spark: SparkSession) -> list[str]:
    return _STAGED.setdefault(spark.sparkContext.applicationId, [])


def drop_staged(spark: SparkSession) -> int:
    """Delete what :func:`stage` has written in this application; results read from it
    must have been written before.  Returns the number of tables."""
    paths = _staged(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    n = len(paths)
    paths.clear()
    return n


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
