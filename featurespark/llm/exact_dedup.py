"""Exact deduplication against a persistent digest index (DataFrame functions only).

The index is a table bucketed and sorted by digest, so the sort-merge anti-join
that separates new digests from known ones reads it without a shuffle, and without a
sort while a bucket is one file; what is new is appended in the same layout, and
:meth:`DigestIndex.compact` makes a bucket one file again.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from featurespark.llm.shared import stage, text_or_empty

#: fixed: the characters deleted before texts are compared
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def normalised(text_col: str):
    return F.translate(text_or_empty(text_col), BLANKS, "")


class DigestIndex:
    """Table (digest binary, keep_id long, n_chars long), bucketed and sorted by digest.
    It lasts as long as the session's catalog: across applications with a metastore.

    ``buckets`` holds for a new table, which is created empty; aim at 1 GB a bucket (about
    2·10^7 digests). An existing table keeps its own.
    """

    SCHEMA = "digest binary, keep_id long, n_chars long"

    def __init__(self, spark: SparkSession, table: str, buckets: int = 16):
        self.spark, self.table, self.buckets = spark, table, buckets
        if not spark.catalog.tableExists(table):
            self._write(spark.createDataFrame([], self.SCHEMA), table)
        told = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
        self.buckets = int(told["data_type"])

    def _write(self, rows: DataFrame, table: str) -> None:
        (rows.select("digest", "keep_id", "n_chars").repartition(self.buckets, "digest")
         .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
         .saveAsTable(table))

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    @contextmanager
    def in_order(self):
        """Plans made inside read a bucket of one file in its stored order."""
        name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def new(self, found: DataFrame) -> DataFrame:
        """Rows of ``found`` (digest, ...) whose digest the index lacks."""
        return found.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame) -> None:
        self._write(rows, self.table)

    def compact(self) -> None:
        """One file a bucket: written beside the table, which it then replaces by name."""
        whole = f"{self.table}_compacted"
        # through a plain table: Spark would take the buckets it reads for the shuffle asked for
        self._write(stage(self.rows(), "digest-index"), whole)
        self.drop()
        self.spark.sql(f"ALTER TABLE {whole} RENAME TO {self.table}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.table}")


def dedup_against_index(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """Decide every row of ``docs`` against ``index`` and append its new digests.

    Texts are equal when identical without blanks. Of equal new texts the row with
    the most code points, then the smallest id, stays; a digest that the index
    already holds keeps the indexed row. Returns (doc_id, keep_id, group_size, kept,
    text_sha256), one row for each input row; group_size counts the rows of ``docs``.

    Null text counts as empty. A null id loses ties. A row repeated under one id is
    the same document: its rows carry the same decision. An empty table gives no
    rows. Other columns are not read, so their names do not matter.
    """
    keyed = stage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)).alias("digest"),
        F.char_length(text_or_empty(text_col)).cast("long").alias("n_chars"),
    ), "digests")
    found = (keyed.groupBy("digest")
             .agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("order"))).alias("best"), F.count("*").alias("group_size"))
             .select("digest", (-F.col("best.order")).alias("keep_id"), F.col("best.n_chars").alias("n_chars"), "group_size"))
    found = stage(found, "digest-groups")
    held = index.rows().select("digest", F.col("keep_id").alias("held_id"), F.col("n_chars").alias("held_chars"), F.lit(True).alias("held"))
    with index.in_order():
        fresh = stage(index.new(found), "digests-new")
        resolved = stage(found.join(held.hint("merge"), "digest", "left").select(
            "digest", F.when(F.col("held"), F.col("held_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.when(F.col("held"), F.lit(-1)).otherwise(F.col("n_chars")).alias("n_chars"), "group_size"), "digests-resolved")
    index.append(fresh)
    kept = F.col("r.keep_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.n_chars") == F.col("k.n_chars"))
    return keyed.alias("k").join(resolved.alias("r"), F.col("k.digest") == F.col("r.digest")).select(
        F.col("k.doc_id").alias("doc_id"), F.col("r.keep_id").alias("keep_id"), F.col("r.group_size").alias("group_size"),
        kept.alias("kept"), F.lower(F.hex(F.col("k.digest"))).alias("text_sha256"))
