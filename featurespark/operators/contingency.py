"""Chi-square of feature × target cross tables (P8, P18), Cramér's V and purity.

Every categorical feature is unpivoted to ``(column_name, value, target)`` and
counted in ONE partial-aggregated group-by.  The statistic is then assembled
from the observed cells and the two marginals only:

    chi2 = sum_observed (O - E)^2 / E  +  (N - sum_observed E)

because a cell that was never observed contributes (0 - E)^2 / E = E, and
all expected counts add up to N.  So no cross product of values × classes is
ever materialised.  With one degree of freedom (2×2) Yates' correction is
applied like scipy's default; that table has exactly four cells, so its zero
cells are enumerated explicitly from the two-row marginals.

Values and classes over 32 characters travel as digests.  A value's total is a window over
its own cells; the class totals, a small table of known size, are joined under a salt, so
two classes are not two shuffle keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_text, col_of, short_key
from ..session import stage
from ..stats import present

#: copies of the class totals, should they be too many to broadcast
SALTS = 8


def crosstab_counts(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(column_name, value, tvalue, n) — rows whose feature or target is missing dropped;
    long texts as digests."""
    key = lambda c: short_key(as_text(present(df, c), df.schema[c].dataType))
    t = key(target)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), key(c).alias("value")) for c in features])
    long = df.select(F.inline(pairs), t.alias("tvalue"))
    return (long.where(F.col("value").isNotNull() & F.col("tvalue").isNotNull())
            .groupBy("column_name", "value", "tvalue").agg(F.count(F.lit(1)).alias("n")))


def chi2_scores(df: DataFrame, features: list[str], target: str, correction: bool = True) -> DataFrame:
    """(column_name, chi2, chi2_uncorrected, dof, n, cramers_v, purity,
    rows_per_value) per feature: one cross-tab, staged once and read by every branch."""
    features = [c for c in features if c != target]
    cells = stage(crosstab_counts(df, features, target), "cells")
    rows = cells.groupBy("column_name", "value").agg(F.sum("n").alias("rn"), F.max("n").alias("rmax"))
    cols = stage(cells.groupBy("column_name", "tvalue").agg(F.sum("n").alias("cn")), "class-totals")
    tot = cells.groupBy("column_name").agg(F.sum("n").alias("tot_n"))
    shape = (rows.groupBy("column_name").agg(F.count(F.lit(1)).alias("r"),
                                             (F.sum("rmax") / F.sum("rn")).alias("purity"))
             .join(cols.groupBy("column_name").agg(F.count(F.lit(1)).alias("c")), "column_name")
             .join(tot, "column_name"))
    shape, tot = F.broadcast(shape), F.broadcast(tot)                 # one row per feature
    own = F.sum("n").over(Window.partitionBy("column_name", "value"))
    salted = cols.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    obs = (cells.withColumn("rn", own).withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int"))
           .join(salted, ["column_name", "tvalue", "salt"]).join(shape, "column_name")
           .withColumn("E", F.col("rn") * F.col("cn") / F.col("tot_n")))
    d = F.abs(F.col("n") - F.col("E"))
    per_col = obs.groupBy("column_name").agg(
        F.sum(d * d / F.col("E")).alias("obs_term"),
        F.sum(F.pow(F.greatest(d - 0.5, F.lit(0.0)), 2) / F.col("E")).alias("obs_term_yates"),
        F.sum("E").alias("obs_E"),
        F.count(F.lit(1)).alias("n_cells"))
    # zero cells of 2x2 tables (at most 4 cells each): enumerate from marginals
    two = shape.where((F.col("r") == 2) & (F.col("c") == 2)).select("column_name")
    grid = (rows.drop("rmax").join(two, "column_name").join(cols.join(two, "column_name"), "column_name")
            .join(tot, "column_name")
            .join(cells.join(two, "column_name").select("column_name", "value", "tvalue"), ["column_name", "value", "tvalue"], "left_anti")
            .withColumn("E", F.col("rn") * F.col("cn") / F.col("tot_n")))
    zero_yates = grid.groupBy("column_name").agg(
        F.sum(F.pow(F.greatest(F.col("E") - 0.5, F.lit(0.0)), 2) / F.col("E")).alias("zero_yates"))
    out = (shape.join(per_col, "column_name").join(zero_yates, "column_name", "left")
           .withColumn("dof", (F.col("r") - 1) * (F.col("c") - 1))
           .withColumn("chi2_raw", F.col("obs_term") + (F.col("tot_n") - F.col("obs_E"))))
    yates = F.col("obs_term_yates") + F.coalesce(F.col("zero_yates"), F.lit(0.0))
    chi2 = F.when(F.col("dof") == 0, F.lit(0.0))
    chi2 = chi2.when(F.col("dof") == 1, yates) if correction else chi2
    chi2 = chi2.otherwise(F.col("chi2_raw"))
    k = F.least(F.col("r"), F.col("c")) - 1
    return out.select(
        "column_name",
        chi2.alias("chi2"),
        F.when(F.col("dof") == 0, F.lit(0.0)).otherwise(F.col("chi2_raw")).alias("chi2_uncorrected"),
        F.col("dof").cast("bigint").alias("dof"),
        F.col("tot_n").cast("bigint").alias("n"),
        F.when(k > 0, F.sqrt(F.col("chi2_raw") / (F.col("tot_n") * k))).otherwise(F.lit(0.0)).alias("cramers_v"),
        "purity", (F.col("tot_n") / F.col("r")).alias("rows_per_value"))


def chi2_with_missing(df: DataFrame, features: list[str], target: str, correction: bool = True) -> DataFrame:
    """Every feature gets a row; failures / empty tables score 0.0 (reference rule)."""
    features = [c for c in features if c != target]
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in features], "column_name string")
    scores = chi2_scores(df, features, target, correction)
    return (names.join(scores, "column_name", "left")
            .select("column_name", F.coalesce("chi2", F.lit(0.0)).alias("chi2"),
                    F.coalesce("cramers_v", F.lit(0.0)).alias("cramers_v")))


def purity(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(column_name, purity, rows_per_value): share of rows whose target equals the
    most frequent target of their feature value (1.0 = value determines target)."""
    cells = crosstab_counts(df, features, target)
    best = cells.groupBy("column_name", "value").agg(F.max("n").alias("m"), F.sum("n").alias("s"))
    return best.groupBy("column_name").agg(
        (F.sum("m") / F.sum("s")).alias("purity"),
        (F.sum("s") / F.count(F.lit(1))).alias("rows_per_value"))
