"""Shared folders, staged tables and deterministic batches of documents."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: a null id sorts after every other id
NULL_ID = 9223372036854775807


#: temporary folders of local sessions that name none
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may leave it unset; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="featurespark-llm-")
    return folder.rstrip("/")


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package when it runs from a checkout instead of an
    installation (executors that see the folder, or local mode)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, and a
    lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def id_or_last(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0)


def batch_count(spark: SparkSession, total_bytes: int, batch_bytes: int) -> int:
    """Batches of about ``batch_bytes`` of text, and two for each shuffle partition."""
    return max(-(-total_bytes // batch_bytes), 2 * partitions(spark))


def bucket_count(spark: SparkSession, total_bytes: int, bucket_bytes: int = 6_000_000) -> int:
    """Buckets of the keys of about ``bucket_bytes`` of text (a million words), and one for
    most shuffle partitions (a power of two): batches times buckets is the number of blobs."""
    return max(-(-total_bytes // bucket_bytes), 1 << (partitions(spark).bit_length() - 1))


def batched(docs: DataFrame, batches: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(batch, id, text): every document in the batch its id hashes to (without an id, its
    text, so that many of them do not meet); null text is empty."""
    id_ = F.col(id_col).cast("long")
    return docs.select(
        F.pmod(F.when(id_.isNull(), F.xxhash64(F.col(text_col))).otherwise(F.xxhash64(id_)), F.lit(batches)).cast("int").alias("batch"),
        F.col(id_col).cast("long").alias("id"),
        text_or_empty(text_col).alias("text"),
    )
