"""Per-column transform recommendations (F1) and the consolidated column
report (F2).  The reference asks an LLM; here deterministic rules run over the
profile DataFrames (one row per column), and every recommended technique is
a registry name, so the output feeds the chained transforms directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import distinct_counts, numeric_columns


def recommendations(df: DataFrame, target: str | None = None, quantiles: str | None = None,
                    skew_log: float = 1.0, missing_flag_pct: float = 5.0, one_hot_max: int = 10,
                    freq_max: int = 1000, summary: DataFrame | None = None) -> DataFrame:
    """(column_name, category, technique, reason) — several rows per column.

    Rules (ours): missing → impute (median if skewed, else mean; mode for
    text) and a missing flag above ``missing_flag_pct``; numeric → log when
    skewed and non-negative, IQR clip when outliers exist, else
    standardization; categorical → one-hot (≤ one_hot_max values),
    frequency (≤ freq_max) or hash encoding; dates → date parts; id-like or
    constant columns → drop.  An empty table tells nothing about its values: only the
    rules on types apply."""
    info = summary if summary is not None else column_summary(df, quantiles)
    if target:
        info = info.where(F.col("column_name") != target)
    c = F.col
    t = c("feature_type")
    rules = [
        ((c("id_like") | (c("n_unique") <= 1)) & (c("rows") > 0), "drop", "drop",
         F.when(c("id_like"), "identifier: unique per row").otherwise("constant column")),
        ((c("missing_count") > 0) & (t == "numerical"), "missing",
         F.when(F.abs(F.coalesce(c("skewness"), F.lit(0.0))) > skew_log, "impute_median").otherwise("impute_mean"),
         F.format_string("%.2f%% missing", c("missing_pct"))),
        ((c("missing_count") > 0) & (t != "numerical"), "missing", F.lit("impute_mode"),
         F.format_string("%.2f%% missing", c("missing_pct"))),
        (c("missing_pct") > missing_flag_pct, "create", F.lit("missing_indicator"),
         F.lit("missingness may carry signal")),
        ((t == "numerical") & (F.abs(F.coalesce(c("skewness"), F.lit(0.0))) > skew_log) & (c("min") >= 0),
         "transform", F.lit("log_transformation"), F.format_string("skewness %.2f", c("skewness"))),
        ((t == "numerical") & (F.coalesce(c("outlier_count"), F.lit(0)) > 0), "transform", F.lit("clip_iqr"),
         F.format_string("%d IQR outliers", c("outlier_count"))),
        ((t == "numerical") & ~c("id_like"), "scale", F.lit("standardization"), F.lit("put on a common scale")),
        (t.isin("categorical", "boolean") & (c("n_unique") <= one_hot_max) & (c("n_unique") > 1), "encode",
         F.lit("one_hot_encoding"), F.format_string("%d categories", c("n_unique"))),
        ((t.isin("categorical", "high_cardinality")) & (c("n_unique") > one_hot_max) & (c("n_unique") <= freq_max)
         & ~c("id_like"), "encode", F.lit("frequency_encoding"), F.format_string("%d categories", c("n_unique"))),
        ((t.isin("categorical", "high_cardinality")) & (c("n_unique") > freq_max) & ~c("id_like"), "encode",
         F.lit("hash_encoding"), F.format_string("%d categories", c("n_unique"))),
        (t == "datetime", "create", F.lit("extract_date_parts"), F.lit("calendar parts")),
    ]
    # every rule is one optional struct; one pass over the per-column table
    hits = F.array(*[F.when(cond, F.struct(F.lit(cat).alias("category"),
                                           (tech if not isinstance(tech, str) else F.lit(tech)).alias("technique"),
                                           reason.alias("reason")))
                     for cond, cat, tech, reason in rules])
    return (info.select("column_name", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
            .select("column_name", "h.category", "h.technique", "h.reason"))


def column_summary(df: DataFrame, quantiles: str | None = None, text_min_avg_len: int = 50,
                   high_share: float = 0.5) -> DataFrame:
    """One row per column: feature_type, missing_count / pct, n_unique, id_like,
    and for numeric columns min, skewness, q1, q3, outlier_count.

    The StatsPlan (moments + quartiles) for the numeric columns, ONE aggregate for
    NULL counts, text lengths and IQR outlier counts with the fitted bounds as
    literals, and one narrow distinct pass."""
    from ..functions.columns import col_of, is_numeric, is_temporal
    from ..stats import StatsPlan, present
    from pyspark.sql import types as T
    import math
    spark = df.sparkSession
    nums = numeric_columns(df)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    plan = StatsPlan(quantile_method=quantiles)
    for c in nums:
        for k in ("min", "max", "skew", "count"):
            plan.need(k, c)
        plan.need_qdisc(c, 0.25), plan.need_qdisc(c, 0.75)
    st = plan.fit(df) if nums else None
    bounds = {}
    for c in nums:
        q1, q3 = st[("qd", c, 0.25)], st[("qd", c, 0.75)]
        if q1 is not None:
            bounds[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(present(df, c).isNull()).alias(f"m{i}"))
        if c in strings:
            aggs.append(F.avg(F.char_length(col_of(c))).alias(f"l{i}"))
        if c in bounds:
            lo, hi = bounds[c]
            x = present(df, c).cast("double")
            aggs.append(F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"o{i}"))
    row = df.agg(*aggs).collect()[0]
    distinct = {r["column_name"]: r["n_unique"] for r in distinct_counts(df, df.columns).collect()}    # one row per column
    n = row["__n"]
    rows = []
    for i, f in enumerate(df.schema.fields):
        c, dt = f.name, f.dataType
        nu = distinct[c]
        if isinstance(dt, T.BooleanType):
            kind = "boolean"
        elif is_numeric(dt):
            kind = "numerical"
        elif is_temporal(dt):
            kind = "datetime"
        elif c in strings:
            kind = ("text" if (row[f"l{i}"] or 0) >= text_min_avg_len
                    else "high_cardinality" if nu > high_share * n else "categorical")
        else:
            kind = "other"
        m = row[f"m{i}"]
        sk, cnt = (st[("skew", c)], st[("count", c)]) if c in nums else (None, None)
        adj = sk * math.sqrt(cnt * (cnt - 1)) / (cnt - 2) if (sk is not None and cnt and cnt > 2) else None
        num = c in nums
        rows.append((c, kind, int(m), round(100.0 * m / n, 2) if n else 0.0, int(nu), n > 0 and nu == n,
                     float(st[("min", c)]) if num and st[("min", c)] is not None else None,
                     float(st[("max", c)]) if num and st[("max", c)] is not None else None, adj,
                     float(st[("qd", c, 0.25)]) if c in bounds else None,
                     float(st[("qd", c, 0.75)]) if c in bounds else None,
                     int(row[f"o{i}"]) if c in bounds else None, int(n)))
    return spark.createDataFrame(rows, "column_name string, feature_type string, missing_count bigint, "
                                       "missing_pct double, n_unique bigint, id_like boolean, min double, "
                                       "max double, skewness double, q1 double, q3 double, outlier_count bigint, "
                                       "rows bigint")


def recommendations_to_specs(rec: DataFrame) -> list[dict]:
    """Recommendations (one small row set per column) → transform specs."""
    rows = rec.where(F.col("category") != "drop").select("column_name", "technique").collect()
    return [{"column_name": r["column_name"], "fe_method": r["technique"]} for r in rows]


def column_report(df: DataFrame, rec: DataFrame | None = None, leakage: DataFrame | None = None,
                  lineage: list[dict] | None = None, summary: DataFrame | None = None) -> DataFrame:
    """one row per column with eda / fe / leakage / transform details
    (full outer joins on column_name of small per-column tables)."""
    spark = df.sparkSession
    eda = (summary if summary is not None else column_summary(df)).select(
        "column_name", F.format_string("%s, %.2f%% missing, %d distinct", "feature_type", "missing_pct",
                                       "n_unique").alias("eda_details"))
    out = eda
    if rec is not None:
        fe = rec.groupBy("column_name").agg(F.array_join(F.array_sort(F.collect_list("technique")), ", ")
                                            .alias("fe_details"))
        out = out.join(fe, "column_name", "full_outer")
    if leakage is not None:
        lk = leakage.select(F.col("feature").alias("column_name"),
                            F.concat_ws(": ", "risk", "reason").alias("leakage_details"))
        out = out.join(lk, "column_name", "full_outer")
    if lineage:
        ln = spark.createDataFrame([(l["original_column"], l["output_column"], ", ".join(l["transformations"]))
                                    for l in lineage], "column_name string, output_column string, steps string")
        out = out.join(ln.select("column_name", F.concat_ws(" <- ", "output_column", "steps").alias("dag_details")),
                       "column_name", "full_outer")
    return out
