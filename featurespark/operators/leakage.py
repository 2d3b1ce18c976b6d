"""Target-leakage flags (L1–L4) computed from full-table statistics.

The reference fixes the risk categories and the report shape; the numbers
here are aggregates (thresholds are ours and parameters):

* numeric feature, numeric target: |corr| ≥ high → high, ≥ medium → medium,
  ≥ low → low;
* any other feature (or any feature against a categorical target): purity —
  share of rows whose target equals the most frequent target of their
  feature value — ≥ high → high; Cramér's V ≥ medium_v → medium; both only with
  at least ``min_rows_per_value`` rows per value (a near-unique column determines
  any target);
* identifier (distinct = rows) → low, without a cross-tab;
* ``time_columns`` vs ``event_time``: any row whose feature time is after the
  event time → high ("comes from future data").

A numeric target is cut into quartile bins for the purity / Cramér's V
tests.  One correlation aggregate, one staged cross-tab, one distinct pass in total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col_of, is_numeric, is_temporal, unused
from ..session import stage
from ..stats import present
from . import contingency
from .balance import qcut_bin, qcut_edges
from .profile import cardinality

def leakage_report(df: DataFrame, target: str, features: list[str] | None = None, event_time: str | None = None,
                   time_columns: list[str] | None = None, corr_high: float = 0.98, corr_medium: float = 0.8,
                   corr_low: float = 0.5, purity_high: float = 0.98, min_rows_per_value: float = 5.0,
                   v_medium: float = 0.6) -> DataFrame:
    """(feature, risk, metric, value, reason): the highest risk of each flagged feature."""
    spark = df.sparkSession
    feats = [c for c in (features or df.columns) if c != target and c != event_time]
    tdt = df.schema[target].dataType
    numeric_target = is_numeric(tdt) and not isinstance(tdt, T.BooleanType)
    num = [c for c in feats if is_numeric(df.schema[c].dataType)
           and not isinstance(df.schema[c].dataType, T.BooleanType)] if numeric_target else []
    ids = [c for c in feats if not is_temporal(df.schema[c].dataType)]
    card = stage(cardinality(df, ids), "cardinality") if ids else None            # one row per feature
    unique = {r["column_name"] for r in card.where("id_like").collect()} if ids else set()
    # an identifier determines every target; it has its own rule and is not cross-tabulated
    other = [c for c in feats if c not in num and c not in unique and not is_temporal(df.schema[c].dataType)]
    parts = []
    if num:
        y = present(df, target).cast("double")
        one = df.agg(*[F.corr(present(df, c).cast("double"), y).alias(f"c{i}") for i, c in enumerate(num)])
        corr = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.col(f"c{i}")).alias("value"))
                                             for i, c in enumerate(num)])))
        risk = (F.when(F.col("value") >= corr_high, "high").when(F.col("value") >= corr_medium, "medium")
                .when(F.col("value") >= corr_low, "low"))
        parts.append(corr.select("feature", risk.alias("risk"), F.lit("abs_corr").alias("metric"), "value"))
    if other:
        base = df
        tcol = target
        if numeric_target:
            edges = qcut_edges(df, target, 4)
            tcol = unused(df.columns, "target_bin")
            base = df.withColumn(tcol, qcut_bin(col_of(target).cast("double"), edges))
        j = contingency.chi2_scores(base, other, tcol, correction=False).select(
            "column_name", "cramers_v", "purity", "rows_per_value")
        high = (F.col("purity") >= purity_high) & (F.col("rows_per_value") >= min_rows_per_value)
        medium = (F.coalesce(F.col("cramers_v"), F.lit(0.0)) >= v_medium) & (F.col("rows_per_value") >= min_rows_per_value)
        parts.append(j.select(F.col("column_name").alias("feature"),
                              F.when(high, "high").when(medium, "medium").alias("risk"),
                              F.when(high, "purity").otherwise("cramers_v").alias("metric"),
                              F.when(high, F.col("purity")).otherwise(F.col("cramers_v")).alias("value")))
    if ids:
        parts.append(card.where("id_like").select(F.col("column_name").alias("feature"), F.lit("low").alias("risk"),
                                                  F.lit("id_like").alias("metric"), F.lit(1.0).alias("value")))
    if event_time and time_columns:
        et = col_of(event_time)
        one = df.agg(*[F.avg((col_of(c) > et).cast("double")).alias(f"t{i}") for i, c in enumerate(time_columns)])
        fut = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"t{i}").alias("value"))
                                            for i, c in enumerate(time_columns)])))
        parts.append(fut.select("feature", F.when(F.col("value") > 0, "high").alias("risk"),
                                F.lit("future_share").alias("metric"), "value"))
    if not parts:
        return spark.createDataFrame([], "feature string, risk string, metric string, value double, reason string")
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    flagged = allp.where(F.col("risk").isNotNull())
    order = F.when(F.col("risk") == "high", 3).when(F.col("risk") == "medium", 2).otherwise(1)
    best = flagged.groupBy("feature").agg(F.max_by(F.struct("risk", "metric", "value"),
                                                   F.struct(order, F.col("value"), F.col("metric"))).alias("b"))
    out = best.select("feature", "b.risk", "b.metric", "b.value")
    reason = (F.when(F.col("metric") == "abs_corr", F.format_string("|correlation| with target = %.3f", "value"))
              .when(F.col("metric") == "purity", F.format_string("value determines target for %.1f%% of rows",
                                                                 F.col("value") * 100))
              .when(F.col("metric") == "cramers_v", F.format_string("Cramer's V with target = %.3f", "value"))
              .when(F.col("metric") == "id_like", F.lit("unique per row (identifier)"))
              .otherwise(F.format_string("%.1f%% of rows are later than the event time", F.col("value") * 100)))
    return out.withColumn("reason", reason)


def leakage_summary(report: DataFrame) -> DataFrame:
    """L4: one row — counts per risk and three array<struct<feature, reason>>."""
    item = F.struct(F.col("feature"), F.col("reason"))
    return report.agg(
        F.count_if(F.col("risk") == "high").cast("int").alias("high_risk"),
        F.count_if(F.col("risk") == "medium").cast("int").alias("medium_risk"),
        F.count_if(F.col("risk") == "low").cast("int").alias("low_risk"),
        F.array_sort(F.collect_list(F.when(F.col("risk") == "high", item))).alias("high_risk_features"),
        F.array_sort(F.collect_list(F.when(F.col("risk") == "medium", item))).alias("medium_risk_features"),
        F.array_sort(F.collect_list(F.when(F.col("risk") == "low", item))).alias("low_risk_features"))
