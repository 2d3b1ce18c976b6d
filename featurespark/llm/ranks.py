"""Places of rows in their key's order, without one task for a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from featurespark.llm.shared import partitions, stage


def numbered(rows: DataFrame, key: str, order: list[Column], tag: str) -> DataFrame:
    """``rows`` with ``idx``, the 0-based place in its key's order, and ``n``, the key's rows.

    Rows are dealt by range over (key, order), so a key that holds a third of them spreads
    over many tasks, and written once with their place in the task. The table of (key, task,
    rows) gives the offsets: a key has at most one row there for each task. Rows that are
    equal in ``order`` share a task; append columns until they are interchangeable.
    """
    by = [F.col(key).asc_nulls_first(), *order]
    cut = rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    # monotonically_increasing_id: task in the upper 31 bits, place in the lower 33
    cut = stage(cut.withColumn("at", F.monotonically_increasing_id()), tag)
    placed = cut.withColumn("task", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    runs = stage(placed.groupBy(F.col(key).alias("of"), F.col("task").alias("in")).agg(F.min("at").alias("first"), F.count("*").alias("held")), tag + "-runs")
    of = Window.partitionBy("of")
    before = F.coalesce(F.sum("held").over(of.orderBy("in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("of", "in", (before - F.col("first")).alias("shift"), F.sum("held").over(of).alias("n"))
    return placed.join(runs, F.col(key).eqNullSafe(F.col("of")) & (F.col("task") == F.col("in"))).select(
        *rows.columns, (F.col("at") + F.col("shift")).alias("idx"), "n")
