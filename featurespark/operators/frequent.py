"""Distinct values of many columns, the most frequent and the smallest of them, without long
texts in a shuffle.

A value is counted under its first HEAD characters and, when it is longer, its md5. Values
whose heads differ are ordered by them; only long values with one head and the same count need
more of the text, and only where they decide which of them are chosen. The whole text is
read again for the chosen ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: characters by which a value is counted and ordered
HEAD = 32
#: texts of one head and count that are read whole for a column; more are narrowed by longer heads
TIED = 1000
SALT = 64

KEYS = ["column_name", "head", "digest"]


def keyed(values: DataFrame) -> DataFrame:
    """(column_name, value) with ``head`` and, for longer values, ``digest``."""
    long = F.char_length("value") > HEAD
    return values.where(F.col("value").isNotNull()).select(
        "*", F.when(long, F.substring("value", 1, HEAD)).otherwise(F.col("value")).alias("head"), F.when(long, F.md5("value")).alias("digest"))


def counted(values: DataFrame) -> DataFrame:
    """(column_name, head, digest, count) of (column_name, value) rows, staged."""
    return stage(keyed(values).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("count")), "value-counts")


def distinct_values(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column_name").agg(F.count(F.lit(1)).cast("bigint").alias("distinct_count"))


def top_k(rows: DataFrame, group: str, order: list[Column], k: int, salt: list[str], rank_col: str = "rank") -> DataFrame:
    """Top-k rows per ``group`` in ``order``: first within (group, salt) — spreading
    one group's rows over as many salts as the session's shuffle parallelism
    (at least SALT) — then among the ≤ salts·k survivors."""
    parallel = max(SALT, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*salt), F.lit(parallel)))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy(group, "salt").orderBy(*order))).where(F.col("r") <= k)
    last = Window.partitionBy(group).orderBy(*order)
    return first.drop("r", "salt").withColumn(rank_col, F.row_number().over(last).cast("bigint")).where(F.col(rank_col) <= k)


def _order(by_count: bool) -> list[Column]:
    return ([F.col("count").desc()] if by_count else []) + [F.col("head").asc(), F.col("digest").isNotNull().asc()]


def _candidates(counts: DataFrame, k: int, by_count: bool) -> DataFrame:
    """Values before the k-th place of their column, and (``tied``) those that share it up to
    their heads."""
    top = top_k(counts, "column_name", _order(by_count), k, ["head", "digest"])
    edge = [F.col("count")] * by_count + [F.col("head"), F.col("digest").isNotNull().alias("long")]
    last = top.groupBy("column_name").agg(F.max_by(F.struct(*edge), "rank").alias("edge"))
    near = counts.join(F.broadcast(last), "column_name").withColumn("here", F.struct(*edge))         # a row per column
    if by_count:
        before = (F.col("count") > F.col("edge.count")) | ((F.col("count") == F.col("edge.count")) & (
            (F.col("head") < F.col("edge.head")) | ((F.col("head") == F.col("edge.head")) & F.col("digest").isNull() & F.col("edge.long"))))
    else:
        before = F.col("here") < F.col("edge")
    tied = F.col("here") == F.col("edge")
    return stage(near.where(before | tied).select(*KEYS, "count", tied.alias("tied")), "top-values")


def _narrowed(values: DataFrame, tied: DataFrame, names: list[str]) -> DataFrame:
    """``tied`` (with ``need``, how many of them are wanted) cut to the wanted ones and what
    shares their place, by longer and longer heads, until each of the columns ``names`` has at
    most TIED."""
    size = HEAD * 8
    while names:
        mine = F.col("column_name").isin(names)
        shared = tied.where(mine).select("column_name", "head").distinct()       # one row per column
        heads = keyed(values.where(mine)).where(F.col("digest").isNotNull()).join(F.broadcast(shared), ["column_name", "head"]).select("column_name", "digest", F.substring("value", 1, size).alias("longer"),
                                                                                   (F.char_length("value") > size).alias("rest")).distinct()
        placed = stage(tied.where(mine).join(heads, ["column_name", "digest"]), "longer-heads")
        counted = placed.groupBy("column_name", "longer", "rest").agg(F.count(F.lit(1)).alias("n"))
        # the smallest distinct heads that together hold the wanted number
        first = top_k(counted, "column_name", [F.col("longer").asc(), F.col("rest").asc()], TIED, ["longer"])
        upto = F.sum("n").over(Window.partitionBy("column_name").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
        need = tied.select("column_name", "need").distinct()
        kept = first.withColumn("before", F.coalesce(upto, F.lit(0))).join(F.broadcast(need), "column_name").where(F.col("before") < F.col("need"))
        kept = kept.select("column_name", "longer", "rest")
        cut = placed.join(F.broadcast(kept), ["column_name", "longer", "rest"]).select(*tied.columns)       # at most TIED rows per column
        tied = stage(tied.where(~mine).unionByName(cut), "tied-values")
        size *= 8
        crowded = tied.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TIED)
        names = [r["column_name"] for r in crowded.collect()]            # one row per column
    return tied


def chosen(values: DataFrame, counts: DataFrame, k: int, by_count: bool = True) -> DataFrame:
    """(column_name, rank, value, count): the ``k`` most frequent values of each column (ties by
    value), or the ``k`` smallest. ``counts`` is :func:`counted` of ``values``."""
    picked = _candidates(counts, k, by_count)
    told = picked.groupBy("column_name").agg(F.count_if("tied").alias("tied"), F.count_if(~F.col("tied")).alias("certain"),
                                             F.count("digest").alias("long")).collect()            # one row per column
    crowded = {r["column_name"]: k - r["certain"] for r in told if r["tied"] > TIED}
    if crowded:
        need = values.sparkSession.createDataFrame(list(crowded.items()), "column_name string, need long")
        much = F.col("tied") & F.col("column_name").isin(list(crowded))
        tied = stage(picked.where(much).select(*KEYS, "count").join(F.broadcast(need), "column_name"), "tied-values")
        picked = stage(picked.where(~much).select(*KEYS, "count").unionByName(_narrowed(values, tied, list(crowded)).drop("need")), "chosen-values")
    texts = F.lit(None).cast("string")
    if any(r["long"] for r in told):
        wanted = picked.where(F.col("digest").isNotNull()).select("column_name", "digest")          # at most k + TIED rows per column
        read = keyed(values).where(F.col("digest").isNotNull()).join(F.broadcast(wanted), ["column_name", "digest"])
        whole = read.groupBy("column_name", "digest").agg(F.first("value").alias("text"))
        picked, texts = picked.join(whole, ["column_name", "digest"], "left"), F.col("text")
    named = picked.select("column_name", F.when(F.col("digest").isNull(), F.col("head")).otherwise(texts).alias("value"), "count")
    order = [F.col("count").desc(), F.col("value").asc()] if by_count else [F.col("value").asc()]
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(*order)).cast("bigint")
    return named.select("column_name", rank.alias("rank"), "value", F.col("count").cast("bigint").alias("count")).where(F.col("rank") <= k)
