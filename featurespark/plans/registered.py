"""Registered queries: every operator run over whole driver tables, each with
an equivalent DuckDB SQL oracle (where one exists).

Conventions shared by both sides: integers are cast to BIGINT, doubles are
rounded to 6 places (engines sum in different orders), NULLs are injected by
the same CASE expression on both sides because the fixtures have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.transforms import apply_transforms, one_hot_columns
from ..plans.chain import build_chain, chain_lineage
from ..session import read_table, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def R(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def L(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("bigint")


# -- derived inputs (same expression in Spark and in the SQL) ----------------
def lineitem_nulls(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.withColumn("l_quantity", F.when(F.col("l_linenumber") == 3, F.lit(None))
                         .otherwise(F.col("l_quantity")))


LI_NULLS = ("li AS (SELECT * REPLACE (CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END "
            "AS l_quantity) FROM lineitem)")


def orders_nulls(spark, sf):
    o = read_table(spark, sf, "orders")
    return (o.withColumn("o_totalprice", F.when(F.col("o_custkey") % 7 == 0, F.lit(None))
                         .otherwise(F.col("o_totalprice")))
             .withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 11 == 0, F.lit(None))
                         .otherwise(F.col("o_orderpriority"))))


O_NULLS = ("o AS (SELECT * REPLACE (CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice END "
           "AS o_totalprice, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END "
           "AS o_orderpriority) FROM orders)")


def events_nulls(spark, sf):
    e = read_table(spark, sf, "events")
    return e.withColumn("value", F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("value")))


E_NULLS = "e AS (SELECT * REPLACE (CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value) FROM events)"


def _one(df: DataFrame, spec: dict, keys: list[str], out: str, cast=R, **kw) -> DataFrame:
    res = apply_transforms(df, [spec], **kw)
    return res.df.select(*[L(k).alias(k) for k in keys], cast(out).alias(out))


# ---------------------------------------------------------------------------
# N*: numeric transforms
# ---------------------------------------------------------------------------
@register("standardize", f"""
WITH {LI_NULLS}
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round((l_quantity - avg(l_quantity) OVER ()) / nullif(stddev_samp(l_quantity) OVER (), 0), 6)
    AS l_quantity_standardized
FROM li""")
def q_standardize(spark, sf):
    return _one(lineitem_nulls(spark, sf), {"column_name": "l_quantity", "fe_method": "standardization"},
                ["l_orderkey", "l_linenumber"], "l_quantity_standardized")


@register("normalize", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round((l_extendedprice - min(l_extendedprice) OVER ())
        / nullif(max(l_extendedprice) OVER () - min(l_extendedprice) OVER (), 0), 6) AS l_extendedprice_normalized
FROM lineitem""")
def q_normalize(spark, sf):
    return _one(read_table(spark, sf, "lineitem"), {"column_name": "l_extendedprice", "fe_method": "min-max scaling"},
                ["l_orderkey", "l_linenumber"], "l_extendedprice_normalized")


@register("robust_scale", """
WITH s AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round((l_extendedprice - q2) / nullif(q3 - q1, 0), 6) AS l_extendedprice_robust_scaled
FROM lineitem, s""")
def q_robust_scale(spark, sf):
    return _one(read_table(spark, sf, "lineitem"), {"column_name": "l_extendedprice", "fe_method": "robust_scaling"},
                ["l_orderkey", "l_linenumber"], "l_extendedprice_robust_scaled")


@register("log1p", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round(CASE WHEN l_extendedprice + 1 > 0 THEN ln(l_extendedprice + 1) END, 6) AS l_extendedprice_log
FROM lineitem""")
def q_log1p(spark, sf):
    return _one(read_table(spark, sf, "lineitem"), {"column_name": "l_extendedprice", "fe_method": "log transform"},
                ["l_orderkey", "l_linenumber"], "l_extendedprice_log")


@register("sqrt_abs", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(sqrt(abs(l_tax)), 6) AS l_tax_sqrt
FROM lineitem""")
def q_sqrt_abs(spark, sf):
    return _one(read_table(spark, sf, "lineitem"), {"column_name": "l_tax", "fe_method": "sqrt_transformation"},
                ["l_orderkey", "l_linenumber"], "l_tax_sqrt")


@register("power", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(pow(l_discount, 0.5), 6) AS l_discount_power
FROM lineitem""")
def q_power(spark, sf):
    return _one(read_table(spark, sf, "lineitem"), {"column_name": "l_discount", "fe_method": "box-cox transformation"},
                ["l_orderkey", "l_linenumber"], "l_discount_power")


@register("ntile_bin", f"""
WITH {O_NULLS}
SELECT o_orderkey, ntile(4) OVER (ORDER BY o_totalprice NULLS FIRST, o_orderkey) AS o_totalprice_bin FROM o""")
def q_ntile_bin(spark, sf):
    return _one(orders_nulls(spark, sf), {"column_name": "o_totalprice", "fe_method": "binning",
                                          "order_key": "o_orderkey"},
                ["o_orderkey"], "o_totalprice_bin", cast=L)


@register("custom_bin", f"""
WITH {O_NULLS}
SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 200000 THEN 'medium'
  WHEN o_totalprice < 300000 THEN 'high' ELSE 'very_high' END AS o_totalprice_binned FROM o""")
def q_custom_bin(spark, sf):
    return _one(orders_nulls(spark, sf), {"column_name": "o_totalprice", "fe_method": "custom_binning",
                                          "bin1": 100000, "bin2": 200000, "bin3": 300000},
                ["o_orderkey"], "o_totalprice_binned", cast=lambda c: F.col(c))


# ---------------------------------------------------------------------------
# C*: categorical encodings
# ---------------------------------------------------------------------------
@register("label_encode", f"""
WITH {O_NULLS}
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY coalesce(o_orderpriority, '')) - 1 AS BIGINT)
  AS o_orderpriority_encoded FROM o""")
def q_label_encode(spark, sf):
    return _one(orders_nulls(spark, sf), {"column_name": "o_orderpriority", "fe_method": "label_encoding"},
                ["o_orderkey"], "o_orderpriority_encoded", cast=L)


@register("freq_encode", f"""
WITH {O_NULLS}
SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) AS o_orderpriority_freq FROM o""")
def q_freq_encode(spark, sf):
    return _one(orders_nulls(spark, sf), {"column_name": "o_orderpriority", "fe_method": "count encoding"},
                ["o_orderkey"], "o_orderpriority_freq", cast=L)


@register("target_encode", """
SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS c_mktsegment_target_encoded
FROM customer""")
def q_target_encode(spark, sf):
    return _one(read_table(spark, sf, "customer"), {"column_name": "c_mktsegment", "fe_method": "target_encoding",
                                                    "target_column": "c_acctbal"},
                ["c_custkey"], "c_mktsegment_target_encoded")


@register("binary_encode", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CAST(CASE WHEN CAST(l_discount > 0.05 AS VARCHAR) IN ('Yes','yes','YES','true','True','TRUE','1')
       THEN 1 ELSE 0 END AS BIGINT) AS discounted_binary
FROM lineitem""")
def q_binary_encode(spark, sf):
    li = read_table(spark, sf, "lineitem").withColumn("discounted", F.col("l_discount") > 0.05)
    return _one(li, {"column_name": "discounted", "fe_method": "binary_encoding"},
                ["l_orderkey", "l_linenumber"], "discounted_binary", cast=L)


@register("hash_encode", """
SELECT c_custkey, CAST('0x' || substr(md5(c_mktsegment), 1, 8) AS BIGINT) % 100 AS c_mktsegment_hash
FROM customer""")
def q_hash_encode(spark, sf):
    return _one(read_table(spark, sf, "customer"), {"column_name": "c_mktsegment", "fe_method": "hashing"},
                ["c_custkey"], "c_mktsegment_hash", cast=L)


@register("one_hot_hash", f"""
WITH {O_NULLS}
SELECT o_orderkey, CAST('0x' || substr(md5(o_orderpriority), 1, 8) AS BIGINT) % 50 AS o_orderpriority_hash FROM o""")
def q_one_hot_hash(spark, sf):
    return _one(orders_nulls(spark, sf), {"column_name": "o_orderpriority", "fe_method": "one-hot encoding"},
                ["o_orderkey"], "o_orderpriority_hash", cast=L)


@register("one_hot", """
SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS o_orderstatus_F,
  CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS o_orderstatus_O,
  CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS o_orderstatus_P
FROM orders""")
def q_one_hot(spark, sf):
    o = read_table(spark, sf, "orders")
    res = one_hot_columns(o, "o_orderstatus")
    return res.select("o_orderkey", *[F.col(c) for c in res.columns if c.startswith("o_orderstatus_")])


# ---------------------------------------------------------------------------
# T*: string transforms
# ---------------------------------------------------------------------------
@register("str_lower", "SELECT p_partkey, lower(p_name) AS p_name_lower FROM part")
def q_str_lower(spark, sf):
    return _one(read_table(spark, sf, "part"), {"column_name": "p_name", "fe_method": "lower"},
                ["p_partkey"], "p_name_lower", cast=F.col)


@register("str_upper", "SELECT p_partkey, upper(p_type) AS p_type_upper FROM part")
def q_str_upper(spark, sf):
    return _one(read_table(spark, sf, "part"), {"column_name": "p_type", "fe_method": "uppercase"},
                ["p_partkey"], "p_type_upper", cast=F.col)


@register("str_trim", """
SELECT p_partkey,
  trim(' ' || chr(9) || p_brand || chr(10) || ' ', ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))
    AS padded_trimmed
FROM part""")
def q_str_trim(spark, sf):
    p = read_table(spark, sf, "part").withColumn("padded", F.concat(F.lit(" \t"), F.col("p_brand"), F.lit("\n ")))
    return _one(p, {"column_name": "padded", "fe_method": "trim"}, ["p_partkey"], "padded_trimmed", cast=F.col)


@register("str_length", "SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS p_name_length FROM part")
def q_str_length(spark, sf):
    return _one(read_table(spark, sf, "part"), {"column_name": "p_name", "fe_method": "string_length"},
                ["p_partkey"], "p_name_length", cast=L)


@register("extract_number", """
SELECT c_custkey, TRY_CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS c_name_number FROM customer""")
def q_extract_number(spark, sf):
    return _one(read_table(spark, sf, "customer"), {"column_name": "c_name", "fe_method": "extract_numbers"},
                ["c_custkey"], "c_name_number", cast=L)


# ---------------------------------------------------------------------------
# V*: missing values
# ---------------------------------------------------------------------------
@register("impute_mean", f"""
WITH {LI_NULLS}
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round(coalesce(l_quantity, avg(l_quantity) OVER ()), 6) AS l_quantity_imputed FROM li""")
def q_impute_mean(spark, sf):
    return _one(lineitem_nulls(spark, sf), {"column_name": "l_quantity", "fe_method": "mean imputation"},
                ["l_orderkey", "l_linenumber"], "l_quantity_imputed")


@register("impute_median", f"""
WITH {LI_NULLS}, s AS (SELECT quantile_cont(l_quantity, 0.5) AS med FROM li)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round(coalesce(l_quantity, med), 6) AS l_quantity_imputed FROM li, s""")
def q_impute_median(spark, sf):
    return _one(lineitem_nulls(spark, sf), {"column_name": "l_quantity", "fe_method": "fill_median"},
                ["l_orderkey", "l_linenumber"], "l_quantity_imputed")


@register("impute_mode", f"""
WITH {LI_NULLS},
m AS (SELECT l_quantity AS mode_v FROM li WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round(coalesce(l_quantity, mode_v), 6) AS l_quantity_imputed FROM li, m""")
def q_impute_mode(spark, sf):
    return _one(lineitem_nulls(spark, sf), {"column_name": "l_quantity", "fe_method": "impute_mode"},
                ["l_orderkey", "l_linenumber"], "l_quantity_imputed")


@register("impute_const", f"""
WITH {LI_NULLS}
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round(coalesce(l_quantity, 0), 6) AS l_quantity_imputed FROM li""")
def q_impute_const(spark, sf):
    return _one(lineitem_nulls(spark, sf), {"column_name": "l_quantity", "fe_method": "fillna"},
                ["l_orderkey", "l_linenumber"], "l_quantity_imputed")


@register("missing_flag", f"""
WITH {LI_NULLS}
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CAST(CASE WHEN l_quantity IS NULL THEN 1 ELSE 0 END AS BIGINT) AS l_quantity_is_missing FROM li""")
def q_missing_flag(spark, sf):
    return _one(lineitem_nulls(spark, sf), {"column_name": "l_quantity", "fe_method": "is_missing"},
                ["l_orderkey", "l_linenumber"], "l_quantity_is_missing", cast=L)


# ---------------------------------------------------------------------------
# O*: outliers (events.value is right-skewed)
# ---------------------------------------------------------------------------
@register("clip_bounds", f"""
WITH {E_NULLS}
SELECT event_id, round(CASE WHEN value IS NULL THEN NULL ELSE greatest(least(value, 100), 1) END, 6) AS value_clipped
FROM e""")
def q_clip_bounds(spark, sf):
    return _one(events_nulls(spark, sf), {"column_name": "value", "fe_method": "clip", "lower_bound": 1,
                                          "upper_bound": 100}, ["event_id"], "value_clipped")


@register("clip_iqr", f"""
WITH {E_NULLS}, s AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e)
SELECT event_id, round(CASE WHEN value IS NULL THEN NULL
  ELSE greatest(least(value, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)) END, 6) AS value_clipped
FROM e, s""")
def q_clip_iqr(spark, sf):
    return _one(events_nulls(spark, sf), {"column_name": "value", "fe_method": "outlier clipping"},
                ["event_id"], "value_clipped")


@register("winsorize", f"""
WITH {E_NULLS}, s AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM e)
SELECT event_id, round(CASE WHEN value IS NULL THEN NULL ELSE greatest(least(value, hi), lo) END, 6)
  AS value_winsorized
FROM e, s""")
def q_winsorize(spark, sf):
    return _one(events_nulls(spark, sf), {"column_name": "value", "fe_method": "capping"},
                ["event_id"], "value_winsorized")


# ---------------------------------------------------------------------------
# I*, D*: interactions and dates
# ---------------------------------------------------------------------------
@register("square", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(pow(l_quantity, 2), 6) AS l_quantity_squared
FROM lineitem""")
def q_square(spark, sf):
    return _one(read_table(spark, sf, "lineitem"), {"column_name": "l_quantity", "fe_method": "square"},
                ["l_orderkey", "l_linenumber"], "l_quantity_squared")


@register("interaction", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round(l_quantity * l_discount, 6) AS l_quantity_x_l_discount FROM lineitem""")
def q_interaction(spark, sf):
    return _one(read_table(spark, sf, "lineitem"), {"column_name": "l_quantity", "fe_method": "multiply",
                                                    "column1": "l_quantity", "column2": "l_discount"},
                ["l_orderkey", "l_linenumber"], "l_quantity_x_l_discount")


@register("ratio", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round(l_extendedprice / nullif(l_discount, 0), 6) AS l_extendedprice_div_l_discount FROM lineitem""")
def q_ratio(spark, sf):
    return _one(read_table(spark, sf, "lineitem"), {"column_name": "l_extendedprice", "fe_method": "ratio",
                                                    "column1": "l_extendedprice", "column2": "l_discount"},
                ["l_orderkey", "l_linenumber"], "l_extendedprice_div_l_discount")


@register("date_parts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS o_orderdate_year,
  CAST(month(o_orderdate) AS BIGINT) AS o_orderdate_month, CAST(day(o_orderdate) AS BIGINT) AS o_orderdate_day,
  CAST(dayofweek(o_orderdate) + 1 AS BIGINT) AS o_orderdate_dayofweek
FROM orders""")
def q_date_parts(spark, sf):
    res = apply_transforms(read_table(spark, sf, "orders"),
                           [{"column_name": "o_orderdate", "fe_method": "date_features"}])
    parts = ["o_orderdate_year", "o_orderdate_month", "o_orderdate_day", "o_orderdate_dayofweek"]
    return res.df.select("o_orderkey", *[L(p).alias(p) for p in parts])


@register("days_since", """
SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS BIGINT)
  AS o_orderdate_days_ago FROM orders""")
def q_days_since(spark, sf):
    return _one(read_table(spark, sf, "orders"), {"column_name": "o_orderdate", "fe_method": "days_since",
                                                  "reference_date": "2000-01-01"},
                ["o_orderkey"], "o_orderdate_days_ago", cast=L)


# ---------------------------------------------------------------------------
# X*: chained, model-ready table
# ---------------------------------------------------------------------------
CHAIN_FEATURE_SPECS = [
    {"column_name": "l_quantity", "fe_method": "standardization"},
    {"column_name": "l_quantity", "fe_method": "impute_mean"},
    {"column_name": "l_extendedprice", "fe_method": "log_transformation"},
    {"column_name": "l_discount", "fe_method": "winsorize"},
    {"column_name": "l_returnflag", "fe_method": "label_encoding"},
    {"column_name": "l_linestatus", "fe_method": "frequency_encoding"},
    {"column_name": "l_tax", "fe_method": "normalization"},
    {"column_name": "l_tax", "fe_method": "clip_iqr"},
]


@register("chain_features", f"""
WITH {LI_NULLS},
s AS (SELECT avg(l_quantity) AS qa, stddev_samp(l_quantity) AS qs,
             quantile_cont(l_discount, 0.05) AS d05, quantile_cont(l_discount, 0.95) AS d95,
             min(l_tax) AS tmin, max(l_tax) AS tmax,
             quantile_cont(l_tax, 0.25) AS t1, quantile_cont(l_tax, 0.75) AS t3 FROM li),
x AS (SELECT li.*, s.*, (l_tax - tmin) / nullif(tmax - tmin, 0) AS tn FROM li, s)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round((coalesce(l_quantity, qa) - qa) / nullif(qs, 0), 6) AS l_quantity_imputed_scaled,
  round(ln(l_extendedprice + 1), 6) AS l_extendedprice_log,
  round(CASE WHEN l_discount IS NULL THEN NULL ELSE greatest(least(l_discount, d95), d05) END, 6)
    AS l_discount_winsorized,
  CAST(dense_rank() OVER (ORDER BY coalesce(l_returnflag, '')) - 1 AS BIGINT) AS l_returnflag_encoded,
  count(*) OVER (PARTITION BY l_linestatus) AS l_linestatus_freq,
  round(CASE WHEN tn IS NULL THEN NULL ELSE greatest(least(tn, t3 + 1.5 * (t3 - t1)), t1 - 1.5 * (t3 - t1)) END, 6)
    AS l_tax_normalized_clipped
FROM x""")
def q_chain_features(spark, sf):
    res = build_chain(lineitem_nulls(spark, sf), CHAIN_FEATURE_SPECS, keep_columns=["l_orderkey", "l_linenumber"])
    d = res.df
    return d.select(L("l_orderkey").alias("l_orderkey"), L("l_linenumber").alias("l_linenumber"),
                    R("l_quantity_imputed_scaled").alias("l_quantity_imputed_scaled"),
                    R("l_extendedprice_log").alias("l_extendedprice_log"),
                    R("l_discount_winsorized").alias("l_discount_winsorized"),
                    L("l_returnflag_encoded").alias("l_returnflag_encoded"),
                    L("l_linestatus_freq").alias("l_linestatus_freq"),
                    R("l_tax_normalized_clipped").alias("l_tax_normalized_clipped"))


CHAIN_TARGET_SPECS = [
    {"column_name": "o_orderpriority", "fe_method": "label_encoding"},
    {"column_name": "o_orderpriority", "fe_method": "mode imputation"},
    {"column_name": "o_totalprice", "fe_method": "median_imputation"},
    {"column_name": "o_totalprice", "fe_method": "normalization"},
    {"column_name": "o_custkey", "fe_method": "binning", "num_bins": 10},
    {"column_name": "o_orderstatus", "fe_method": "label_encoding"},
]


@register("chain_target", f"""
WITH {O_NULLS},
m AS (SELECT o_orderpriority AS mode_p FROM o WHERE o_orderpriority IS NOT NULL
      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
s AS (SELECT quantile_cont(o_totalprice, 0.5) AS med, min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM o),
x AS (SELECT o.*, coalesce(o_orderpriority, mode_p) AS p_imp, s.* FROM o, m, s)
SELECT o_orderkey,
  CAST(dense_rank() OVER (ORDER BY coalesce(p_imp, '')) - 1 AS BIGINT) AS o_orderpriority_imputed_encoded,
  round((coalesce(o_totalprice, med) - mn) / nullif(mx - mn, 0), 6) AS o_totalprice_imputed_normalized,
  ntile(10) OVER (ORDER BY o_custkey NULLS FIRST, o_orderkey) AS o_custkey_bin,
  CAST(dense_rank() OVER (ORDER BY coalesce(o_orderstatus, '')) - 1 AS BIGINT) AS target
FROM x""")
def q_chain_target(spark, sf):
    res = build_chain(orders_nulls(spark, sf), CHAIN_TARGET_SPECS, target_column="o_orderstatus",
                      order_key="o_orderkey", keep_columns=["o_orderkey"])
    d = res.df
    return d.select(L("o_orderkey").alias("o_orderkey"),
                    L("o_orderpriority_imputed_encoded").alias("o_orderpriority_imputed_encoded"),
                    R("o_totalprice_imputed_normalized").alias("o_totalprice_imputed_normalized"),
                    L("o_custkey_bin").alias("o_custkey_bin"), L("target").alias("target"))


@register("chain_auto_target", """
SELECT o_orderkey, CAST(length(o_orderpriority) AS BIGINT) AS o_orderpriority_length,
  CASE WHEN CAST(o_orderstatus = 'F' AS VARCHAR) IN ('1','Yes','yes','YES','true','True','TRUE')
       THEN 1 ELSE 0 END AS target
FROM orders""")
def q_chain_auto_target(spark, sf):
    o = read_table(spark, sf, "orders").withColumn("is_final", F.col("o_orderstatus") == "F")
    res = build_chain(o, [{"column_name": "o_orderpriority", "fe_method": "string_length"}],
                      target_column="is_final", keep_columns=["o_orderkey"])
    return res.df.select("o_orderkey", L("o_orderpriority_length").alias("o_orderpriority_length"),
                         F.col("target").cast("int").alias("target"))


# ---------------------------------------------------------------------------
# P*: profiling
# ---------------------------------------------------------------------------
from ..operators import profile as P  # noqa: E402

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _round_cols(df: DataFrame, doubles: list[str]) -> DataFrame:
    return df.select(*[R(c).alias(c) if c in doubles else F.col(c) for c in df.columns])


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


@register("overview", 'SELECT count(*) AS "rows", CAST(11 AS BIGINT) AS "columns" FROM lineitem')
def q_overview(spark, sf):
    return P.overview(read_table(spark, sf, "lineitem"))


@register("missing_report", f"""
WITH {LI_NULLS}, s AS (SELECT count(*) AS n, {', '.join(f'count_if({c} IS NULL) AS m{i}' for i, c in enumerate(LI_ALL))} FROM li)
""" + _union([f"SELECT '{c}' AS column_name, CAST(m{i} AS BIGINT) AS missing_count, "
              f"round(CAST(m{i} AS DOUBLE) * 100.0 / n, 2) AS missing_pct FROM s" for i, c in enumerate(LI_ALL)]))
def q_missing_report(spark, sf):
    return P.missing_report(lineitem_nulls(spark, sf))


_IQR_COLS = ["value", "user_id"]


@register("iqr_outliers", "WITH q AS (SELECT count(*) AS n, " + ", ".join(
    f"quantile_disc(CAST({c} AS DOUBLE), 0.25) AS a{i}, quantile_disc(CAST({c} AS DOUBLE), 0.75) AS b{i}"
    for i, c in enumerate(_IQR_COLS)) + " FROM events),\nt AS (" + _union([
        f"SELECT '{c}' AS column_name, a{i} AS q1, b{i} AS q3, a{i} - 1.5 * (b{i} - a{i}) AS lo, "
        f"b{i} + 1.5 * (b{i} - a{i}) AS hi, n, (SELECT count(*) FROM events WHERE {c} < a{i} - 1.5 * (b{i} - a{i}) "
        f"OR {c} > b{i} + 1.5 * (b{i} - a{i})) AS cnt FROM q" for i, c in enumerate(_IQR_COLS)]) + """)
SELECT column_name, round(q1, 6) AS q1, round(q3, 6) AS q3, round(lo, 6) AS lower, round(hi, 6) AS upper,
  CAST(cnt AS BIGINT) AS outlier_count, round(CAST(cnt AS DOUBLE) * 100.0 / n, 2) AS outlier_percentage,
  'IQR' AS method
FROM t WHERE cnt > 0""")
def q_iqr_outliers(spark, sf):
    out = P.iqr_outliers(read_table(spark, sf, "events"), _IQR_COLS)
    return _round_cols(out, ["q1", "q3", "lower", "upper"])


@register("cardinality", "WITH s AS (SELECT count(*) AS n, " + ", ".join(
    f"count(DISTINCT {c}) AS d{i}" for i, c in enumerate(LI_ALL)) + " FROM lineitem)\n" + _union([
        f"SELECT '{c}' AS column_name, CAST(d{i} AS BIGINT) AS n_unique, d{i} <= 10 AS low_cardinality, "
        f"d{i} > n * 0.5 AS high_cardinality, d{i} = n AS id_like FROM s" for i, c in enumerate(LI_ALL)]))
def q_cardinality(spark, sf):
    return P.cardinality(read_table(spark, sf, "lineitem"))


_UNI_STATS = ["min", "max", "mean", "median", "std", "variance", "q1", "q3", "iqr", "skewness", "kurtosis"]


@register("uni_numeric", f"""
WITH {LI_NULLS}, f AS (SELECT * FROM li WHERE {' AND '.join(f'{c} IS NOT NULL' for c in LI_NUM)})
""" + _union([f"""SELECT '{c}' AS column_name, round(min({c}), 6) AS min, round(max({c}), 6) AS max,
  round(avg({c}), 6) AS mean, round(quantile_disc({c}, 0.5), 6) AS median, round(coalesce(stddev_samp({c}), 0), 6) AS std,
  round(var_pop({c}), 6) AS variance, round(quantile_disc({c}, 0.25), 6) AS q1, round(quantile_disc({c}, 0.75), 6) AS q3,
  round(quantile_disc({c}, 0.75) - quantile_disc({c}, 0.25), 6) AS iqr, round(coalesce(skewness({c}), 0), 6) AS skewness,
  round(coalesce(kurtosis_pop({c}), 0), 6) AS kurtosis FROM f""" for c in LI_NUM]))
def q_uni_numeric(spark, sf):
    out = P.univariate_numeric(lineitem_nulls(spark, sf), LI_NUM)
    return _round_cols(out, _UNI_STATS)


_CAT_O = ["o_orderstatus", "o_orderpriority"]
_LONG_O = _union([f"SELECT '{c}' AS column_name, {c} AS value FROM o" for c in _CAT_O])


@register("uni_categorical", f"""
WITH {O_NULLS}, long AS ({_LONG_O}),
c AS (SELECT column_name, value, count(*) AS cnt FROM long WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rk FROM c),
u AS (SELECT column_name, count(*) AS unique_count FROM c GROUP BY ALL),
m AS (SELECT column_name, value AS mode FROM r WHERE rk = 1)
SELECT r.column_name, CAST(u.unique_count AS BIGINT) AS unique_count, m.mode, CAST(rk AS BIGINT) AS "rank",
  r.value, CAST(cnt AS BIGINT) AS "count"
FROM r JOIN u USING (column_name) JOIN m USING (column_name) WHERE rk <= 5""")
def q_uni_categorical(spark, sf):
    out = P.univariate_categorical(orders_nulls(spark, sf), _CAT_O)
    return out.select("column_name", "unique_count", "mode",
                      F.posexplode("top_values").alias("pos", "tv")).select(
        "column_name", "unique_count", "mode", (F.col("pos") + 1).cast("bigint").alias("rank"),
        F.col("tv.value").alias("value"), F.col("tv.count").alias("count"))


@register("target_corr", f"""
WITH {LI_NULLS}, f AS (SELECT * FROM li WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL
                       AND l_discount IS NOT NULL AND l_tax IS NOT NULL)
""" + _union([f"SELECT '{c}' AS column_name, round(coalesce(corr({c}, l_extendedprice), 0), 6) AS correlation FROM f"
              for c in ["l_quantity", "l_discount", "l_tax"]]))
def q_target_corr(spark, sf):
    out = P.target_correlation(lineitem_nulls(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return _round_cols(out, ["correlation"])


@register("sorted_corr", f"""
WITH {LI_NULLS}, s AS (""" + _union([
    f"SELECT '{c}' AS column_name, coalesce(corr({c}, l_extendedprice), 0) AS c0 FROM li"
    for c in ["l_quantity", "l_discount", "l_tax"]]) + """)
SELECT column_name, round(c0, 6) AS correlation, CAST(row_number() OVER (ORDER BY c0, column_name) AS BIGINT) AS position
FROM s""")
def q_sorted_corr(spark, sf):
    out = P.sorted_correlations(lineitem_nulls(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return _round_cols(out, ["correlation"])


def _chi2_sql(long_sql: str, prefix: str = "", with_position: bool = False) -> str:
    pos = (", CAST(row_number() OVER (ORDER BY chi2, column_name) AS BIGINT) AS position" if with_position else "")
    return f"""
WITH {prefix}long AS ({long_sql}),
obs AS (SELECT column_name, value, t, count(*) AS n FROM long WHERE value IS NOT NULL AND t IS NOT NULL GROUP BY ALL),
rm AS (SELECT column_name, value, sum(n) AS rn FROM obs GROUP BY ALL),
cm AS (SELECT column_name, t, sum(n) AS cn FROM obs GROUP BY ALL),
tot AS (SELECT column_name, sum(n) AS nn, count(DISTINCT value) AS r, count(DISTINCT t) AS c FROM obs GROUP BY ALL),
grid AS (SELECT rm.column_name, CAST(rn AS DOUBLE) * cn / nn AS e, CAST(coalesce(obs.n, 0) AS DOUBLE) AS o,
                (r - 1) * (c - 1) AS dof, least(r, c) - 1 AS k, nn
         FROM rm JOIN cm USING (column_name) JOIN tot USING (column_name)
         LEFT JOIN obs ON obs.column_name = rm.column_name AND obs.value = rm.value AND obs.t = cm.t),
res AS (SELECT column_name,
  CASE WHEN max(dof) = 0 THEN 0.0 WHEN max(dof) = 1 THEN sum(pow(greatest(abs(o - e) - 0.5, 0), 2) / e)
       ELSE sum(pow(o - e, 2) / e) END AS chi2,
  CASE WHEN max(k) > 0 THEN sqrt(sum(pow(o - e, 2) / e) / (max(nn) * max(k))) ELSE 0.0 END AS cv
  FROM grid GROUP BY column_name)
SELECT column_name, round(chi2, 6) AS chi2, round(cv, 6) AS cramers_v{pos} FROM res"""


_CHI_LONG = _union(["SELECT 'o_orderpriority' AS column_name, o_orderpriority AS value, o_orderstatus AS t FROM o",
                    "SELECT 'o_year' AS column_name, CAST(year(o_orderdate) AS VARCHAR) AS value, o_orderstatus AS t FROM o"])


def _orders_chi(spark, sf):
    return orders_nulls(spark, sf).withColumn("o_year", F.year("o_orderdate").cast("string"))


@register("chi2_scores", _chi2_sql(_CHI_LONG, O_NULLS + ", "))
def q_chi2_scores(spark, sf):
    out = P.chi2_scores(_orders_chi(spark, sf), "o_orderstatus", ["o_orderpriority", "o_year"])
    return _round_cols(out, ["chi2", "cramers_v"])


@register("chi2_ranking", _chi2_sql(_CHI_LONG, O_NULLS + ", ", with_position=True))
def q_chi2_ranking(spark, sf):
    out = P.chi2_ranking(_orders_chi(spark, sf), "o_orderstatus", ["o_orderpriority", "o_year"])
    return _round_cols(out, ["chi2", "cramers_v"])


@register("chi2_yates", _chi2_sql(
    "SELECT 'urgent' AS column_name, CAST(o_orderpriority = '1-URGENT' AS VARCHAR) AS value, "
    "CAST(o_orderstatus = 'F' AS VARCHAR) AS t FROM orders"))
def q_chi2_yates(spark, sf):
    o = (read_table(spark, sf, "orders").withColumn("urgent", F.col("o_orderpriority") == "1-URGENT")
         .withColumn("is_f", F.col("o_orderstatus") == "F"))
    return _round_cols(P.chi2_scores(o, "is_f", ["urgent"]), ["chi2", "cramers_v"])


_CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


_CUST_DOUBLE = {"c_acctbal"}


def _canon_text(c: str) -> str:
    if c not in _CUST_DOUBLE:
        return f"CAST({c} AS VARCHAR)"
    return (f"CASE WHEN {c} = floor({c}) AND abs({c}) < 1e15 "
            f"THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END")


@register("column_metadata", _union([f"""SELECT '{c}' AS column_name,
  (SELECT CASE lower(typeof({c})) WHEN 'varchar' THEN 'string' WHEN 'integer' THEN 'int' ELSE lower(typeof({c})) END
   FROM customer LIMIT 1) AS dtype,
  (SELECT CAST(count(DISTINCT {c}) AS BIGINT) FROM customer) AS distinct_count,
  (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {_canon_text(c)} AS v FROM customer
     WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS sample_values""" for c in _CUST]))
def q_column_metadata(spark, sf):
    md = P.column_metadata(read_table(spark, sf, "customer"))
    return md.select("column_name", "dtype", "distinct_count", F.array_join("sample_values", "|").alias("sample_values"))


_HIST = [("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("events", "value")]


@register("histogram", _union([f"""SELECT '{c}' AS column_name, b AS bin, mn + (b - 1) * (mx - mn) / 30 AS lower,
  mn + b * (mx - mn) / 30 AS upper, cnt AS "count" FROM (
  SELECT CAST(least(floor(({c} - mn) / (mx - mn) * 30) + 1, 30) AS BIGINT) AS b, any_value(mn) AS mn,
         any_value(mx) AS mx, count(*) AS cnt
  FROM {t}, (SELECT min({c}) AS mn, max({c}) AS mx FROM {t}) GROUP BY 1)""" for t, c in _HIST]))
def q_histogram(spark, sf):
    parts = []
    for t, c in _HIST:
        parts.append(P.histogram(read_table(spark, sf, t), [c]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _round_cols(out, ["lower", "upper"])


@register("top10", f"""
WITH long AS ({_union(["SELECT 'p_brand' AS column_name, nullif(trim(p_brand), '') AS value FROM part",
                        "SELECT 'p_type' AS column_name, nullif(trim(p_type), '') AS value FROM part"])}),
c AS (SELECT column_name, value, count(*) AS cnt FROM long WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rk FROM c)
SELECT column_name, CAST(rk AS BIGINT) AS "rank", value, CAST(cnt AS BIGINT) AS "count" FROM r WHERE rk <= 10""")
def q_top10(spark, sf):
    return P.top_values(read_table(spark, sf, "part"), ["p_brand", "p_type"], k=10, clean=True)


@register("cat_mean", """
WITH long AS (SELECT 'c_mktsegment' AS column_name, c_mktsegment AS value, c_acctbal AS y FROM customer
              UNION ALL SELECT 'c_nation' AS column_name, CAST(c_nationkey AS VARCHAR), c_acctbal FROM customer)
SELECT column_name, value, round(avg(y), 6) AS mean_target, CAST(count(*) AS BIGINT) AS "count",
  round(stddev_samp(y), 6) AS std_target FROM long GROUP BY ALL""")
def q_cat_mean(spark, sf):
    c = read_table(spark, sf, "customer").withColumn("c_nation", F.col("c_nationkey").cast("string"))
    out = P.category_target_mean(c, "c_acctbal", ["c_mktsegment", "c_nation"])
    return _round_cols(out, ["mean_target", "std_target"])


@register("box_stats", """
WITH long AS (SELECT 'o_totalprice' AS column_name, o_orderstatus AS class, o_totalprice AS v FROM orders
              UNION ALL SELECT 'o_custkey', o_orderstatus, CAST(o_custkey AS DOUBLE) FROM orders),
q AS (SELECT column_name, class, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med,
             quantile_cont(v, 0.75) AS q3 FROM long GROUP BY ALL)
SELECT column_name, class, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END), 6) AS lower_whisker,
  round(max(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END), 6) AS upper_whisker,
  CAST(count_if(NOT (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS BIGINT) AS outlier_count,
  CAST(count(*) AS BIGINT) AS "count"
FROM long JOIN q USING (column_name, class) GROUP BY column_name, class, q1, med, q3""")
def q_box_stats(spark, sf):
    out = P.box_stats(read_table(spark, sf, "orders"), "o_orderstatus", ["o_totalprice", "o_custkey"])
    return _round_cols(out, ["q1", "median", "q3", "lower_whisker", "upper_whisker"])


_DOC_STR = ["text", "lang", "source"]


@register("feature_types", _union(
    ["SELECT 'doc_id' AS column_name, 'numerical' AS feature_type",
     "SELECT 'n_chars', 'numerical'"] +
    [f"SELECT '{c}', CASE WHEN avg(length({c})) >= 50 THEN 'text' WHEN count(DISTINCT {c}) > 0.5 * count(*) "
     f"THEN 'high_cardinality' ELSE 'categorical' END FROM documents" for c in _DOC_STR]))
def q_feature_types(spark, sf):
    return P.feature_types(read_table(spark, sf, "documents"))


@register("density", """
WITH s AS (SELECT min(value) AS mn, max(value) AS mx, stddev_samp(value) AS sd, count(value) AS n FROM events),
h AS (SELECT least(floor((value - mn) / (mx - mn) * 30) + 1, 30) AS b, count(*) AS k FROM events, s GROUP BY 1),
c AS (SELECT mn + (b - 1) * (mx - mn) / 30 AS lo_b, mn + b * (mx - mn) / 30 AS hi_b, k FROM h, s),
g AS (SELECT j, mn + (mx - mn) * j / 29 AS x, sd * pow(n, -0.2) AS bw, n FROM s, range(0, 30) t(j))
SELECT 'value' AS column_name, CAST(j AS BIGINT) AS point, round(x, 6) AS x,
  round(sum(k * exp(-0.5 * pow((x - (lo_b + hi_b) / 2) / bw, 2))) / sqrt(2 * pi()) / (n * bw), 9) AS density
FROM g, c GROUP BY j, x, bw, n""")
def q_density(spark, sf):
    """Gaussian kernel over the 30 histogram bins, 30 grid points."""
    out = P.density(read_table(spark, sf, "events"), ["value"])
    return out.select("column_name", "point", R("x").alias("x"), F.round("density", 9).alias("density"))


@register("target_suggestion", """
WITH m AS (SELECT 'doc_id' AS column_name, count(DISTINCT doc_id) AS distinct_count, 0 AS pos FROM labels
  UNION ALL SELECT 'quality', count(DISTINCT quality), 1 FROM labels UNION ALL SELECT 'toxic', count(DISTINCT toxic), 2 FROM labels),
s AS (SELECT column_name, distinct_count, CAST(CASE WHEN column_name IN ('quality', 'toxic') THEN 3 ELSE 0 END
        + CASE WHEN distinct_count BETWEEN 2 AND 20 THEN 2 ELSE 0 END + CASE WHEN pos = 2 THEN 1 ELSE 0 END
        - CASE WHEN column_name LIKE '%id' OR column_name LIKE '%key' THEN 5 ELSE 0 END AS INTEGER) AS score FROM m)
SELECT column_name, distinct_count, score, CAST(row_number() OVER (ORDER BY score DESC, column_name) AS INTEGER) AS rank FROM s""")
def q_target_suggestion(spark, sf):
    """P10 (ours: deterministic score instead of an LLM call)."""
    return P.suggest_target(read_table(spark, sf, "labels"))


def _long(section: str, key: str, value: str, number: str, source: str) -> str:
    return f"SELECT '{section}' AS section, {key} AS key, {value} AS value, round(CAST({number} AS DOUBLE), 6) AS number FROM {source}"


@register("profile_sections", """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders),
num AS (""" + _union([f"SELECT '{c}' AS c, CAST({c} AS DOUBLE) AS x FROM o" for c in ("o_orderkey", "o_custkey", "o_totalprice")]) + """),
cat AS (""" + _union([f"SELECT '{c}' AS c, {c} AS v FROM o" for c in ("o_orderstatus", "o_orderpriority")]) + """),
qs AS (SELECT c, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3, avg(x) AS mean FROM num GROUP BY c),
out AS (SELECT c, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS k FROM num JOIN qs USING (c) GROUP BY c),
vc AS (SELECT c, v, count(*) AS n FROM cat GROUP BY ALL),
top AS (SELECT c, arg_max(v, n) AS mode, count(*) AS u FROM vc GROUP BY c)
""" + " UNION ALL ".join([
    _long("overview", "'rows'", "NULL", "count(*)", "o"),
    _long("missing_values", "c", "NULL", "0", "(SELECT DISTINCT c FROM num UNION ALL SELECT DISTINCT c FROM cat)"),
    _long("cardinality", "c", "NULL", "count(DISTINCT x)", "num GROUP BY c"),
    _long("cardinality", "c", "NULL", "u", "top"),
    _long("outliers", "c", "NULL", "k", "out WHERE k > 0"),
    _long("univariate_numeric", "c", "NULL", "mean", "qs"),
    _long("univariate_categorical", "c", "mode", "u", "top"),
]))
def q_profile_sections(spark, sf):
    """Values of a full profile's sections, as (section, key, value, number)."""
    rep = P.profile(read_table(spark, sf, "orders").drop("o_orderdate"), target="o_orderstatus")
    text = F.lit(None).cast("string")
    parts = [rep["overview"].select(F.lit("overview").alias("section"), F.lit("rows").alias("key"), text.alias("value"), R("rows").alias("number"))]
    for section, value, number in (("missing_values", text, "missing_count"), ("cardinality", text, "n_unique"), ("outliers", text, "outlier_count"),
                                   ("univariate_numeric", text, "mean"), ("univariate_categorical", F.col("mode"), "unique_count")):
        parts.append(rep[section].select(F.lit(section).alias("section"), F.col("column_name").alias("key"), value.alias("value"), R(number).alias("number")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("density_constant", """
SELECT 'one' AS column_name, CAST(0 AS BIGINT) AS point, 1.0::DOUBLE AS x, CAST(NULL AS DOUBLE) AS density FROM (SELECT count(*) AS n FROM events) WHERE n > 0""")
def q_density_constant(spark, sf):
    """P13 on a constant column: one point, a point mass."""
    return P.density(read_table(spark, sf, "events").withColumn("one", F.lit(1.0)), ["one"]).select("column_name", "point", "x", "density")


_NAN_SQL = """n AS (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)"""


def _events_nan(spark, sf):
    """A third of the values are NaN, which counts as missing (the oracle has NULL there)."""
    e = read_table(spark, sf, "events")
    return e.withColumn("v", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")))


@register("nan_outliers", f"""
WITH {_NAN_SQL}, q AS (SELECT quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM n)
SELECT 'v' AS column_name, round(q1, 6) AS q1, round(q3, 6) AS q3,
  count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outlier_count FROM n, q GROUP BY q1, q3""")
def q_nan_outliers(spark, sf):
    out = P.iqr_outliers(_events_nan(spark, sf), ["v"], keep_zero=True)
    return _round_cols(out.select("column_name", "q1", "q3", "outlier_count"), ["q1", "q3"])


@register("nan_histogram", f"""
WITH {_NAN_SQL}, m AS (SELECT min(v) AS a, max(v) AS b FROM n)
SELECT 'v' AS column_name, CAST(least(floor((v - a) / (b - a) * 30) + 1, 30) AS BIGINT) AS bin, count(*) AS "count"
FROM n, m WHERE v IS NOT NULL GROUP BY 2""")
def q_nan_histogram(spark, sf):
    return P.histogram(_events_nan(spark, sf), ["v"]).select("column_name", "bin", "count")


@register("box_stats_many", """
WITH q AS (SELECT CAST(o_custkey AS VARCHAR) AS class, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q, count(*) AS n FROM orders GROUP BY 1)
SELECT class, round(q[1], 6) AS q1, round(q[2], 6) AS median, round(q[3], 6) AS q3, n AS "count" FROM q""")
def q_box_stats_many(spark, sf):
    """P17 with a class for every customer."""
    out = P.box_stats(read_table(spark, sf, "orders"), "o_custkey", ["o_totalprice"])
    return _round_cols(out.select("class", "q1", "median", "q3", "count"), ["q1", "median", "q3"])


# ---------------------------------------------------------------------------
# B*: imbalance, balancing, bias
# ---------------------------------------------------------------------------
from ..operators import balance as B  # noqa: E402
from ..operators.smoter import smoter  # noqa: E402


@register("class_dist", """
SELECT CAST(quality AS VARCHAR) AS class, count(*) AS "count", round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM labels GROUP BY 1""")
def q_class_dist(spark, sf):
    return _round_cols(B.class_distribution(read_table(spark, sf, "labels"), "quality"), ["share"])


@register("imbalance", """
WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT sum(n) AS tot FROM c)
SELECT count(*) AS n_classes, max(n) AS max_count, min(n) AS min_count, round(max(n) / min(n), 2) AS imbalance_ratio,
  CAST(count_if(n / tot < 0.15) AS BIGINT) AS rare_classes FROM c, t""")
def q_imbalance(spark, sf):
    dist = B.class_distribution(read_table(spark, sf, "labels"), "toxic")
    return B.imbalance_summary(dist, rare_threshold=0.15)


@register("qcut_bins", """
WITH e AS (SELECT quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1]) AS q FROM orders),
b AS (SELECT 1 + CAST(o_totalprice > q[2] AS INT) + CAST(o_totalprice > q[3] AS INT) + CAST(o_totalprice > q[4] AS INT)
        AS bin, q FROM orders, e)
SELECT CAST(bin AS BIGINT) AS bin, round(q[bin], 6) AS lower, round(q[bin + 1], 6) AS upper,
  CAST(count(*) AS BIGINT) AS "count" FROM b GROUP BY bin, q""")
def q_qcut_bins(spark, sf):
    return _round_cols(B.qcut_distribution(read_table(spark, sf, "orders"), "o_totalprice"), ["lower", "upper"])


@register("prepare_rows", f"""
WITH {O_NULLS}, s AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM o)
SELECT o_orderkey, round(coalesce(o_totalprice, m), 6) AS o_totalprice,
  coalesce(o_orderpriority, 'missing') AS o_orderpriority, o_orderstatus FROM o, s""")
def q_prepare_rows(spark, sf):
    p = B.prepare_rows(orders_nulls(spark, sf), "o_orderstatus")
    return p.select("o_orderkey", R("o_totalprice").alias("o_totalprice"), "o_orderpriority", "o_orderstatus")


@register("nan_prepare_rows", f"""
WITH {_NAN_SQL.replace("AS v FROM", "AS v, event_id, event_type FROM")}, s AS (SELECT quantile_cont(v, 0.5) AS m FROM n)
SELECT event_id, round(coalesce(v, m), 6) AS v FROM n, s""")
def q_nan_prepare_rows(spark, sf):
    out = B.prepare_rows(_events_nan(spark, sf).select("event_id", "event_type", "v"), "event_type")
    return out.select("event_id", R("v").alias("v"))


@register("nan_target_rows", f"""
WITH {_NAN_SQL.replace("AS v FROM", "AS v, event_id FROM")}
SELECT event_id, round(v, 6) AS v FROM n WHERE v IS NOT NULL""")
def q_nan_target_rows(spark, sf):
    out = B.prepare_rows(_events_nan(spark, sf).select("event_id", "v"), "v")
    return out.select("event_id", R("v").alias("v"))


@register("nan_impute_mode", """
WITH n AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 20 THEN NULL ELSE l_quantity END AS q FROM lineitem),
m AS (SELECT q AS mode FROM n WHERE q IS NOT NULL GROUP BY q ORDER BY count(*) DESC, q LIMIT 1)
SELECT l_orderkey, l_linenumber, coalesce(q, mode) AS q_imputed FROM n, m""")
def q_nan_impute_mode(spark, sf):
    """NaN is the most frequent value, and missing."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 20, F.col("l_quantity")).otherwise(float("nan")).alias("q"))
    out = apply_transforms(li, [{"column_name": "q", "fe_method": "impute_mode"}]).df
    return out.select("l_orderkey", "l_linenumber", "q_imputed")


@register("nan_smoter_gate", f"""
WITH {_NAN_SQL}
SELECT count(DISTINCT v) >= 10 AND abs(skewness(v)) >= 0.5 AS apply, count(DISTINCT v) AS distinct, round(skewness(v), 6) AS skewness FROM n""")
def q_nan_smoter_gate(spark, sf):
    return _round_cols(B.smoter_gate_frame(_events_nan(spark, sf), "v"), ["skewness"])


@register("long_value_counts", """
WITH v AS (SELECT text AS value, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT rank, value, "count" FROM (SELECT row_number() OVER (ORDER BY n DESC, value) AS rank, value, n AS "count" FROM v) WHERE rank <= 10""")
def q_long_value_counts(spark, sf):
    """P14 over whole documents, most of which occur once: ties by text."""
    return P.top_values(read_table(spark, sf, "documents"), ["text"], 10).select("rank", "value", "count")


@register("oversample_counts", """
WITH c AS (SELECT CAST(quality AS VARCHAR) AS class, count(*) AS n FROM labels GROUP BY 1)
SELECT class, (SELECT max(n) FROM c) AS "count" FROM c""")
def q_oversample_counts(spark, sf):
    out = B.random_oversample(read_table(spark, sf, "labels"), "quality", seed=42)
    return out.groupBy(F.col("quality").cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))


_DRAW = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"


@register("oversample_rows", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS idx FROM labels),
c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), m AS (SELECT max(n) AS most FROM c),
d AS (SELECT quality, n, unnest(range(most - n)) AS j FROM c, m),
p AS (SELECT quality, """ + _DRAW.format("quality || '|' || j || '|' || 42") + """ % n AS idx FROM d)
SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT l.doc_id, l.quality, l.toxic FROM p JOIN l ON l.quality = p.quality AND l.idx = p.idx""")
def q_oversample_rows(spark, sf):
    """B6 row for row: the draws are md5 values that SQL repeats."""
    return B.random_oversample(read_table(spark, sf, "labels"), "quality", seed=42, order_key="doc_id")


@register("shuffled_rows", """
SELECT doc_id, row_number() OVER (ORDER BY """ + _DRAW.format("doc_id || '|' || quality || '|' || toxic || '|' || 7") + """) AS position FROM labels""")
def q_shuffled_rows(spark, sf):
    """Every row with its position in the shuffled order."""
    from ..operators import rank
    labels = read_table(spark, sf, "labels")
    keyed = labels.withColumn("draw", B.row_draw(labels, 7))
    return rank.global_row_number(keyed, [rank.SortKey("draw")], out="position").select("doc_id", "position")


@register("balance_status", """
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), m AS (SELECT max(n) AS most FROM c),
d AS (SELECT quality, n, unnest(range(most - n)) AS j FROM c, m),
b AS (SELECT quality FROM labels UNION ALL SELECT quality FROM d), k AS (SELECT quality, count(*) AS n FROM b GROUP BY 1)
SELECT 'quality' AS target_column, 'categorical' AS target_type, count(*) AS n_classes,
  round(max(n) / greatest(min(n), 1), 2) AS imbalance_ratio,
  CASE WHEN max(n) / greatest(min(n), 1) <= 1.2 THEN 'Balanced' ELSE 'Imbalanced' END AS balance_status FROM k
UNION ALL
SELECT 'toxic', 'categorical', count(*), round(max(n) / greatest(min(n), 1), 2),
  CASE WHEN round(max(n) / greatest(min(n), 1), 2) <= 1.2 THEN 'Balanced' ELSE 'Imbalanced' END FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)""")
def q_balance_status(spark, sf):
    """B10 after balancing, and on a table that is not balanced."""
    labels = read_table(spark, sf, "labels")
    return B.balance_report(B.random_oversample(labels, "quality", seed=42), "quality").unionByName(B.balance_report(labels, "toxic"))


@register("imbalance_record", """
WITH c AS (SELECT CAST(toxic AS VARCHAR) AS class, count(*) AS n FROM labels GROUP BY 1),
a AS (SELECT arg_max(class, n) AS majority_class, max(n) AS majority_count, arg_min(class, n) AS minority_class,
             min(n) AS minority_count FROM c)
SELECT 'toxic' AS target_column, 'categorical' AS target_type, majority_class, majority_count, minority_class,
  minority_count, round(majority_count / greatest(minority_count, 1), 2) AS imbalance_ratio,
  round(majority_count / greatest(minority_count, 1), 2) > 1.2 AS is_imbalanced,
  CASE WHEN round(majority_count / greatest(minority_count, 1), 2) <= 1.2 THEN 'none'
       WHEN round(majority_count / greatest(minority_count, 1), 2) <= 3 THEN 'mild'
       WHEN round(majority_count / greatest(minority_count, 1), 2) <= 10 THEN 'moderate' ELSE 'severe' END AS severity,
  'random_oversampling' AS recommended_method FROM a""")
def q_imbalance_record(spark, sf):
    return B.imbalance_analysis(read_table(spark, sf, "labels"), "toxic")


def _cust_country(spark, sf):
    c = read_table(spark, sf, "customer")
    n = read_table(spark, sf, "nation")          # fixed 25-row dimension: bounded broadcast
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
            .select("c_custkey", F.col("n_name").alias("country"), (F.col("c_acctbal") > 0).alias("positive")))


_BIAS_SQL = """WITH d AS (SELECT n_name AS country, CAST(c_acctbal > 0 AS DOUBLE) AS y
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT 'country' AS feature, country AS "group", count(*) AS n, avg(y) AS outcome FROM d GROUP BY 1, 2)"""


@register("bias_groups", _BIAS_SQL + """
SELECT feature, "group", n, round(n / sum(n) OVER (PARTITION BY feature), 6) AS share, round(outcome, 6) AS outcome
FROM g""")
def q_bias_groups(spark, sf):
    out = B.group_outcomes(_cust_country(spark, sf), "positive", ["country"])
    return _round_cols(out, ["share", "outcome"])


@register("bias_report", _BIAS_SQL + """,
s AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS share, outcome, "group" FROM g),
p AS (SELECT feature, min(outcome) AS omin, max(outcome) AS omax, min(share) AS smin, max(share) AS smax,
             arg_min("group", (outcome, "group")) AS lo, arg_max("group", (outcome, "group")) AS hi FROM s GROUP BY 1),
r AS (SELECT feature, 'outcome' AS bias_type, CASE WHEN omax > 0 AND omin / omax < 0.8 THEN 'high'
        WHEN omax > 0 AND omin / omax < 0.9 THEN 'medium' ELSE 'low' END AS risk,
        printf('outcome ratio %.3f (group %s vs %s)', coalesce(CASE WHEN omax > 0 THEN omin / omax END, 1.0), lo, hi) AS evidence FROM p
      UNION ALL
      SELECT feature, 'representation', CASE WHEN smax / smin > 10 THEN 'high' WHEN smax / smin > 3 THEN 'medium'
        ELSE 'low' END, printf('largest/smallest group share %.3f', smax / smin) FROM p),
f AS (SELECT * FROM r WHERE risk <> 'low')
SELECT * FROM f UNION ALL SELECT NULL, 'none', 'low', 'no significant bias' WHERE (SELECT count(*) FROM f) = 0""")
def q_bias_report(spark, sf):
    return B.bias_report(B.group_outcomes(_cust_country(spark, sf), "positive", ["country"]))


@register("smoter_gate", """
SELECT count(DISTINCT value) >= 10 AND abs(skewness(value)) >= 0.5 AS apply, count(DISTINCT value) AS distinct,
  round(skewness(value), 6) AS skewness FROM events""")
def q_smoter_gate(spark, sf):
    return _round_cols(B.smoter_gate_frame(read_table(spark, sf, "events"), "value"), ["skewness"])


def _smoter_sql() -> str:
    """SMOTER for events with the true 5 nearest of all rows of a bump over (user_id, hour)."""
    z = ["(user_id - ua) / (ub - ua)", "(hour - ha) / (hb - ha)"]
    draw = [_DRAW.format(f"bump || '|' || j || '|' || 42 || '|' || {i}") for i in (1, 2, 3)]
    return f"""
WITH e AS (SELECT event_id, user_id, CAST(hour(ts) AS INTEGER) AS hour, event_type, value FROM events),
s AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3, min(value) AS a, max(value) AS b,
             CAST(min(user_id) AS DOUBLE) AS ua, CAST(max(user_id) AS DOUBLE) AS ub, CAST(min(hour) AS DOUBLE) AS ha, CAST(max(hour) AS DOUBLE) AS hb FROM e),
w AS (SELECT *, greatest(a, q1 - 1.5 * (q3 - q1)) AS lower, least(b, q3 + 1.5 * (q3 - q1)) AS upper FROM s),
t AS (SELECT e.*, w.*, least(greatest(CASE WHEN value >= med THEN (value - med) / (upper - med) ELSE (med - value) / (med - lower) END, 0.0), 1.0) AS t FROM e, w),
r AS (SELECT *, CASE WHEN 3 * t * t - 2 * t * t * t >= 0.5 THEN CASE WHEN value < med THEN 'low' ELSE 'high' END ELSE 'normal' END AS bump FROM t),
sizes AS (SELECT bump, count(*) AS n FROM r GROUP BY 1),
goal AS (SELECT sum(n)::BIGINT // count(*) AS goal FROM sizes),
ranked AS (SELECT bump, event_id, user_id, hour, event_type, value, value AS y, {z[0]} AS z0, {z[1]} AS z1,
  row_number() OVER (PARTITION BY bump ORDER BY value, event_id) AS pos FROM r WHERE bump <> 'normal'),
nbrs AS (SELECT * FROM (SELECT a.bump, a.pos, b.pos AS npos, row_number() OVER (PARTITION BY a.bump, a.pos
  ORDER BY 0.0 + (a.z0 - b.z0) * (a.z0 - b.z0) + (a.z1 - b.z1) * (a.z1 - b.z1), b.pos) AS m
  FROM ranked a JOIN ranked b ON a.bump = b.bump AND a.pos <> b.pos) WHERE m <= 5),
k AS (SELECT bump, pos, max(m) AS k FROM nbrs GROUP BY ALL),
d AS (SELECT bump, n, unnest(range(goal - n)) AS j FROM sizes, goal WHERE bump <> 'normal' AND n < goal),
ids AS (SELECT bump, j % n + 1 AS pos, {draw[0]} AS r1, ({draw[1]} % 1000000) / 1000000.0::DOUBLE AS u, {draw[2]} % 2 AS side FROM d),
picked AS (SELECT ids.*, nbrs.npos FROM ids JOIN k USING (bump, pos) JOIN nbrs ON nbrs.bump = ids.bump AND nbrs.pos = ids.pos AND nbrs.m = ids.r1 % k + 1),
made AS (SELECT CAST(NULL AS BIGINT) AS event_id,
  CAST(round(s.user_id + u * (CAST(o.user_id AS DOUBLE) - s.user_id)) AS BIGINT) AS user_id,
  CAST(round(s.hour + u * (CAST(o.hour AS DOUBLE) - s.hour)) AS INTEGER) AS hour,
  CASE WHEN side = 0 THEN s.event_type ELSE o.event_type END AS event_type, s.value + u * (o.value - s.value) AS value
  FROM picked JOIN ranked s ON s.bump = picked.bump AND s.pos = picked.pos JOIN ranked o ON o.bump = picked.bump AND o.pos = picked.npos)
SELECT event_id, user_id, hour, event_type, round(value, 6) AS value FROM (SELECT * FROM e UNION ALL SELECT * FROM made)"""


@register("smoter_rows", _smoter_sql())
def q_smoter_rows(spark, sf):
    """Original rows plus interpolated rare-bump rows, row for row; SQL finds the
    neighbours by brute force."""
    e = read_table(spark, sf, "events").select("event_id", "user_id", F.hour("ts").alias("hour"), "event_type", "value")
    out, _ = smoter(e, "value", order_key="event_id", exact=True)
    return out.select("event_id", "user_id", "hour", "event_type", R("value").alias("value"))


# ---------------------------------------------------------------------------
# L*: leakage; F*: recommendations and column report
# ---------------------------------------------------------------------------
from ..operators import leakage as LK  # noqa: E402
from ..operators import recommend as RC  # noqa: E402

_LK_NUM = ["l_quantity", "l_discount", "l_tax", "l_leak"]
_LK_CAT = ["l_returnflag", "l_linestatus"]


def _leak_input(spark, sf):
    """With a leaking column and an identifier, which must come out low."""
    return read_table(spark, sf, "lineitem").withColumn("l_leak", F.col("l_extendedprice") * 2 + 1) \
        .withColumn("l_line", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")) \
        .select("l_extendedprice", *_LK_NUM, *_LK_CAT, "l_line")


_LEAK_CTE = """WITH d AS (SELECT l_extendedprice, l_quantity, l_discount, l_tax, l_extendedprice * 2 + 1 AS l_leak,
                  l_returnflag, l_linestatus FROM lineitem),
e AS (SELECT quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1]) AS q FROM d),
b AS (SELECT d.*, CAST(1 + CAST(l_extendedprice > q[2] AS INT) + CAST(l_extendedprice > q[3] AS INT)
                 + CAST(l_extendedprice > q[4] AS INT) AS VARCHAR) AS t FROM d, e),
nums AS (""" + _union([f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS v FROM d" for c in _LK_NUM]) + """),
long AS (""" + _union([f"SELECT '{c}' AS column_name, {c} AS value, t FROM b" for c in _LK_CAT]) + """),
obs AS (SELECT column_name, value, t, count(*) AS n FROM long GROUP BY ALL),
rm AS (SELECT column_name, value, sum(n) AS rn, max(n) AS mx FROM obs GROUP BY ALL),
cm AS (SELECT column_name, t, sum(n) AS cn FROM obs GROUP BY ALL),
tot AS (SELECT column_name, sum(n) AS nn, count(DISTINCT value) AS r, count(DISTINCT t) AS c FROM obs GROUP BY ALL),
grid AS (SELECT rm.column_name, CAST(rn AS DOUBLE) * cn / nn AS ex, CAST(coalesce(obs.n, 0) AS DOUBLE) AS o,
                least(r, c) - 1 AS k, nn
         FROM rm JOIN cm USING (column_name) JOIN tot USING (column_name)
         LEFT JOIN obs ON obs.column_name = rm.column_name AND obs.value = rm.value AND obs.t = cm.t),
cv AS (SELECT column_name, CASE WHEN max(k) > 0 THEN sqrt(sum(pow(o - ex, 2) / ex) / (max(nn) * max(k))) ELSE 0 END
       AS v FROM grid GROUP BY 1),
pur AS (SELECT column_name, sum(mx) / sum(rn) AS p, sum(rn) / count(*) AS rpv FROM rm GROUP BY 1),
flags AS (
  SELECT feature, CASE WHEN v >= 0.98 THEN 'high' WHEN v >= 0.8 THEN 'medium' WHEN v >= 0.5 THEN 'low' END AS risk,
         'abs_corr' AS metric, v AS value FROM nums
  UNION ALL
  SELECT pur.column_name, CASE WHEN p >= 0.98 AND rpv >= 5 THEN 'high' WHEN cv.v >= 0.6 AND rpv >= 5 THEN 'medium' END,
         CASE WHEN p >= 0.98 AND rpv >= 5 THEN 'purity' ELSE 'cramers_v' END,
         CASE WHEN p >= 0.98 AND rpv >= 5 THEN p ELSE cv.v END
  FROM pur JOIN cv USING (column_name)
  UNION ALL
  SELECT 'l_line', 'low', 'id_like', 1.0 FROM (SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity)) AS u FROM lineitem) WHERE n = u),
best AS (SELECT feature, arg_max(risk, (CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) * 10 + value)
           AS risk, arg_max(metric, (CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) * 10 + value)
           AS metric, arg_max(value, (CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) * 10 + value)
           AS value FROM flags WHERE risk IS NOT NULL GROUP BY 1)"""


_REASON_SQL = """CASE metric WHEN 'abs_corr' THEN printf('|correlation| with target = %.3f', value)
  WHEN 'purity' THEN printf('value determines target for %.1f%% of rows', value * 100)
  WHEN 'cramers_v' THEN printf('Cramer''s V with target = %.3f', value) ELSE 'unique per row (identifier)' END"""


@register("leakage_report", _LEAK_CTE + f"\nSELECT feature, risk, metric, round(value, 6) AS value, {_REASON_SQL} AS reason FROM best")
def q_leakage_report(spark, sf):
    return _round_cols(LK.leakage_report(_leak_input(spark, sf), "l_extendedprice"), ["value"])


@register("leakage_identifier", """
SELECT 'o_orderkey' AS feature, 'low' AS risk, 'id_like' AS metric FROM (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS u FROM orders) WHERE n = u""")
def q_leakage_identifier(spark, sf):
    """An identifier against a categorical target: low, never medium."""
    return LK.leakage_report(read_table(spark, sf, "orders"), "o_orderstatus", features=["o_orderkey"]).select("feature", "risk", "metric")


def _features_sql(risk: str) -> str:
    return f"coalesce(string_agg(feature || ': ' || {_REASON_SQL}, '; ' ORDER BY feature) FILTER (risk = '{risk}'), '') AS {risk}_risk_features"


@register("leakage_summary", _LEAK_CTE + f"""
SELECT CAST(count_if(risk = 'high') AS INTEGER) AS high_risk, CAST(count_if(risk = 'medium') AS INTEGER) AS medium_risk,
  CAST(count_if(risk = 'low') AS INTEGER) AS low_risk, {_features_sql('high')}, {_features_sql('medium')}, {_features_sql('low')} FROM best""")
def q_leakage_summary(spark, sf):
    """L4, the three lists of (feature, reason) as text."""
    out = LK.leakage_summary(LK.leakage_report(_leak_input(spark, sf), "l_extendedprice"))
    lists = [f"{risk}_risk_features" for risk in ("high", "medium", "low")]
    return out.select("high_risk", "medium_risk", "low_risk", *[
        F.array_join(F.transform(c, lambda x: F.concat_ws(": ", x["feature"], x["reason"])), "; ").alias(c) for c in lists])


@register("leakage_temporal", """
SELECT 't_feature' AS feature, 'high' AS risk, 'future_share' AS metric,
  round(avg(CAST(CASE WHEN event_type = 'purchase' THEN ts + INTERVAL 1 HOUR ELSE ts - INTERVAL 1 HOUR END > ts
            AS DOUBLE)), 6) AS value
FROM events""")
def q_leakage_temporal(spark, sf):
    ev = read_table(spark, sf, "events").withColumn(
        "t_feature", F.when(F.col("event_type") == "purchase", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
        .otherwise(F.col("ts") - F.expr("INTERVAL 1 HOUR")))
    rep = LK.leakage_report(ev, "value", features=["t_feature"], event_time="ts", time_columns=["t_feature"])
    return _round_cols(rep.select("feature", "risk", "metric", "value"), ["value"])


_SUMMARY_SQL = f"""{O_NULLS},
num AS ({_union([f"SELECT '{c}' AS c, CAST({c} AS DOUBLE) AS x FROM o" for c in ("o_orderkey", "o_custkey", "o_totalprice")])}),
oth AS ({_union([f"SELECT '{c}' AS c, '{k}' AS t, CAST({c} AS VARCHAR) AS v FROM o" for c, k in (("o_orderstatus", "categorical"), ("o_orderdate", "datetime"), ("o_orderpriority", "categorical"))])}),
q AS (SELECT c, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3 FROM num GROUP BY c),
ou AS (SELECT c, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers FROM num JOIN q USING (c) GROUP BY c),
sm AS (SELECT c, 'numerical' AS t, count(*) AS n, count(*) - count(x) AS miss, count(DISTINCT x) AS nu, skewness(x) AS sk, min(x) AS mn, max(outliers) AS outliers
       FROM num JOIN ou USING (c) GROUP BY c
       UNION ALL SELECT c, t, count(*), count(*) - count(v), count(DISTINCT v), NULL, NULL, NULL FROM oth GROUP BY c, t),
st AS (SELECT *, round(100.0 * miss / n, 2) AS pct, nu = n AS id FROM sm)"""
_RULES_SQL = """rules AS (
  SELECT c, 'drop' AS category, 'drop' AS technique, CASE WHEN id THEN 'identifier: unique per row' ELSE 'constant column' END AS reason FROM st WHERE id OR nu <= 1
  UNION ALL SELECT c, 'missing', CASE WHEN abs(coalesce(sk, 0)) > 1 THEN 'impute_median' ELSE 'impute_mean' END, printf('%.2f%% missing', pct) FROM st WHERE miss > 0 AND t = 'numerical'
  UNION ALL SELECT c, 'missing', 'impute_mode', printf('%.2f%% missing', pct) FROM st WHERE miss > 0 AND t <> 'numerical'
  UNION ALL SELECT c, 'create', 'missing_indicator', 'missingness may carry signal' FROM st WHERE pct > 5
  UNION ALL SELECT c, 'transform', 'log_transformation', printf('skewness %.2f', sk) FROM st WHERE t = 'numerical' AND abs(coalesce(sk, 0)) > 1 AND mn >= 0
  UNION ALL SELECT c, 'transform', 'clip_iqr', printf('%d IQR outliers', outliers) FROM st WHERE t = 'numerical' AND outliers > 0
  UNION ALL SELECT c, 'scale', 'standardization', 'put on a common scale' FROM st WHERE t = 'numerical' AND NOT id
  UNION ALL SELECT c, 'encode', 'one_hot_encoding', printf('%d categories', nu) FROM st WHERE t = 'categorical' AND nu BETWEEN 2 AND 10
  UNION ALL SELECT c, 'encode', 'frequency_encoding', printf('%d categories', nu) FROM st WHERE t = 'categorical' AND nu > 10 AND nu <= 1000 AND NOT id
  UNION ALL SELECT c, 'encode', 'hash_encoding', printf('%d categories', nu) FROM st WHERE t = 'categorical' AND nu > 1000 AND NOT id
  UNION ALL SELECT c, 'create', 'extract_date_parts', 'calendar parts' FROM st WHERE t = 'datetime')"""


@register("recommendations", f"WITH {_SUMMARY_SQL}, {_RULES_SQL} SELECT c AS column_name, category, technique, reason FROM rules WHERE c <> 'o_orderstatus'")
def q_recommendations(spark, sf):
    """F1 (rules of ours over the profile)."""
    return RC.recommendations(orders_nulls(spark, sf), target="o_orderstatus")


def _lineage_sql() -> str:
    """Lineage depends on the specs alone, so it is a constant table on both sides."""
    rows = chain_lineage(CHAIN_TARGET_SPECS, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "o_orderstatus")
    return "(VALUES " + ", ".join(f"('{l['original_column']}', '{l['output_column']} <- {', '.join(l['transformations'])}')" for l in rows) + ") AS l(c, dag_details)"


@register("column_report", f"""
WITH {_SUMMARY_SQL}, {_RULES_SQL},
fe AS (SELECT c, string_agg(technique, ', ' ORDER BY technique) AS fe_details FROM rules WHERE c <> 'o_orderstatus' GROUP BY c),
dag AS (SELECT * FROM {_lineage_sql()})
SELECT st.c AS column_name, printf('%s, %.2f%% missing, %d distinct', t, pct, nu) AS eda_details, fe_details, dag_details
FROM st LEFT JOIN fe USING (c) LEFT JOIN dag USING (c)""")
def q_column_report(spark, sf):
    """per-column eda / fe / transform details (the leakage column is leakage_report's)."""
    o = orders_nulls(spark, sf)
    summary = RC.column_summary(o)
    rec = RC.recommendations(o, target="o_orderstatus", summary=summary)
    return RC.column_report(o, rec, None, chain_lineage(CHAIN_TARGET_SPECS, o.columns, "o_orderstatus"), summary=summary)


# ---------------------------------------------------------------------------
# R*: run history (derived from events: user = table, event type = phase);
# S*: scans and sinks
# ---------------------------------------------------------------------------
from ..sources import history as H  # noqa: E402
from ..sources import io as IO  # noqa: E402

_PHASES_EV = ["click", "error", "purchase", "signup", "view"]


def _status_log(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select(F.concat(F.lit("table_"), F.col("user_id").cast("string")).alias("table_name"),
                    F.col("event_type").alias("phase"),
                    F.when(F.col("value") > 50, "completed").otherwise("in_progress").alias("status"),
                    "ts", "event_id", "value")


@register("workspace_merge", """
WITH ex AS (SELECT DISTINCT 'table_' || user_id AS table_name FROM events WHERE event_type = 'click'),
inc AS (SELECT DISTINCT trim(x) AS table_name FROM (
          SELECT unnest(string_split('table_' || user_id || ', table_' || (user_id + 1) || ', ', ',')) AS x
          FROM events WHERE event_type = 'view') WHERE trim(x) <> '')
SELECT table_name, CASE WHEN table_name IN (SELECT table_name FROM ex) THEN 'duplicate' ELSE 'added' END AS status
FROM inc""")
def q_workspace_merge(spark, sf):
    e = read_table(spark, sf, "events")
    existing = e.where(F.col("event_type") == "click").select(
        F.concat(F.lit("table_"), F.col("user_id").cast("string")).alias("table_name"))
    lists = e.where(F.col("event_type") == "view").select(
        F.concat(F.lit("table_"), F.col("user_id").cast("string"), F.lit(", table_"),
                 (F.col("user_id") + 1).cast("string"), F.lit(", ")).alias("table_list"))
    return H.add_workspaces(existing, lists)


_STATE_SQL = """WITH s AS (SELECT 'table_' || user_id AS table_name, event_type AS phase,
  CASE WHEN value > 50 THEN 'completed' ELSE 'in_progress' END AS status, ts FROM events),
l AS (SELECT table_name, phase, arg_max(status, ts) AS st, max(ts) AS mts FROM s GROUP BY ALL),
w AS (SELECT table_name, """ + ", ".join(f"max(CASE WHEN phase = '{p}' THEN st END) AS {p}" for p in _PHASES_EV) + \
    """, max(mts) AS last_updated FROM l GROUP BY table_name)"""


@register("phase_state", _STATE_SQL + "\nSELECT * FROM w")
def q_phase_state(spark, sf):
    return H.phase_state(_status_log(spark, sf), "table_name", "phase", "status", "ts", _PHASES_EV, "event_id")


@register("workspace_list", _STATE_SQL + """,
a AS (SELECT table_name, last_updated, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_updated)) // 1000000
        AS s, """ + ", ".join(_PHASES_EV) + """ FROM w)
SELECT table_name, CASE WHEN """ + " AND ".join(f"coalesce({p} = 'completed', false)" for p in _PHASES_EV) + """ THEN 'completed'
  WHEN """ + " AND ".join(f"{p} IS NULL" for p in _PHASES_EV) + """ THEN 'pending' ELSE 'in_progress' END AS status, last_updated, CASE
  WHEN s < 60 THEN s || ' seconds ago'
  WHEN s < 3600 THEN (s // 60) || ' minute' || CASE WHEN s // 60 <> 1 THEN 's' ELSE '' END || ' ago'
  WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 <> 1 THEN 's' ELSE '' END || ' ago'
  WHEN s < 604800 THEN (s // 86400) || ' day' || CASE WHEN s // 86400 <> 1 THEN 's' ELSE '' END || ' ago'
  ELSE strftime(last_updated, '%Y-%m-%d') END AS age
FROM a""")
def q_workspace_list(spark, sf):
    st = H.phase_state(_status_log(spark, sf), "table_name", "phase", "status", "ts", _PHASES_EV, "event_id")
    import datetime as _dt
    return H.list_workspaces(st, _dt.datetime(2024, 1, 31), phases=_PHASES_EV)


@register("latest_analysis", _STATE_SQL + """,
v AS (SELECT 'table_' || user_id AS table_name, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value,
             max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT v.table_name, v.event_id, v.value, v.ts FROM v JOIN w ON v.table_name = w.table_name WHERE w.signup = 'completed'""")
def q_latest_analysis(spark, sf):
    log = _status_log(spark, sf)
    st = H.phase_state(log, "table_name", "phase", "status", "ts", _PHASES_EV, "event_id")
    views = log.where(F.col("phase") == "view").select("table_name", "event_id", "value", "ts")
    return H.latest_completed(views, st, "table_name", "ts", "signup", "event_id").select("table_name", "event_id", "value", "ts")


@register("latest_run", """
WITH r AS (SELECT user_id, max(date_trunc('day', ts)) AS run FROM events GROUP BY 1)
SELECT e.event_id, e.user_id, CAST(date_trunc('day', e.ts) AS TIMESTAMP) AS run
FROM events e JOIN r ON e.user_id = r.user_id AND date_trunc('day', e.ts) = r.run""")
def q_latest_run(spark, sf):
    e = read_table(spark, sf, "events").withColumn("run", F.date_trunc("day", F.col("ts")).cast("timestamp_ntz"))
    return H.latest_run_rows(e, ["user_id"], "run", "ts").select("event_id", "user_id", "run")


@register("preview", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 3""")
def q_preview(spark, sf):
    from ..operators.profile import preview
    return preview(read_table(spark, sf, "orders"), 3, ["o_orderkey"])


@register("keyed_lookup", """
SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1""")
def q_keyed_lookup(spark, sf):
    return IO.keyed_lookup(read_table(spark, sf, "orders"), "o_orderpriority", "1-URGENT",
                           order_by=["o_orderdate", "o_orderkey"])


@register("outside_bounds", "SELECT * FROM events WHERE value < 1 OR value > 400")
def q_outside_bounds(spark, sf):
    return IO.outside_bounds(read_table(spark, sf, "events"), "value", 1, 400)


@register("sample_scan", """
SELECT * FROM lineitem WHERE """ + _DRAW.format("l_orderkey || '|' || l_linenumber || '|' || 42") + """ < CAST(0.1 * 1152921504606846976 AS BIGINT)""")
def q_sample_scan(spark, sf):
    """A reproducible sample by md5."""
    return IO.sample_scan(read_table(spark, sf, "lineitem"), 0.1, key=["l_orderkey", "l_linenumber"])


@register("multi_transform", f"""
WITH {LI_NULLS}
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round(ln(l_extendedprice + 1), 6) AS l_extendedprice_log,
  CAST(CASE WHEN l_quantity IS NULL THEN 1 ELSE 0 END AS BIGINT) AS l_quantity_is_missing,
  round(coalesce(l_quantity, avg(l_quantity) OVER ()), 6) AS l_quantity_imputed,
  lower(l_returnflag) AS l_returnflag_lower
FROM li""")
def q_multi_transform(spark, sf):
    """Several independent transforms in one projection over one scan."""
    res = apply_transforms(lineitem_nulls(spark, sf), [
        {"column_name": "l_extendedprice", "fe_method": "log_transformation"},
        {"column_name": "l_quantity", "fe_method": "missing_indicator"},
        {"column_name": "l_quantity", "fe_method": "impute_mean"},
        {"column_name": "l_returnflag", "fe_method": "lowercase"},
        {"column_name": "l_returnflag", "fe_method": "no_such_method"}])
    d = res.df
    assert res.skipped and res.skipped[0]["method"] == "no_such_method"
    return d.select(L("l_orderkey").alias("l_orderkey"), L("l_linenumber").alias("l_linenumber"),
                    R("l_extendedprice_log").alias("l_extendedprice_log"),
                    L("l_quantity_is_missing").alias("l_quantity_is_missing"),
                    R("l_quantity_imputed").alias("l_quantity_imputed"), F.col("l_returnflag_lower"))


# ---------------------------------------------------------------------------
# flagship: chained model-ready table over lineitem ⨝ orders with a target
# ---------------------------------------------------------------------------
JOINED_SPECS = [
    {"column_name": "l_quantity", "fe_method": "standardization"},
    {"column_name": "l_extendedprice", "fe_method": "log_transformation"},
    {"column_name": "l_discount", "fe_method": "winsorize"},
    {"column_name": "o_orderpriority", "fe_method": "label_encoding"},
    {"column_name": "l_returnflag", "fe_method": "frequency_encoding"},
    {"column_name": "o_totalprice", "fe_method": "robust_scaling"},
    {"column_name": "o_orderstatus", "fe_method": "label_encoding"},
]


def lineitem_orders(spark, sf):
    """Both sides grow with the data: no broadcast hint, Spark plans the join
    (sort-merge on the order key, or broadcast under its own size threshold)."""
    li = read_table(spark, sf, "lineitem")
    o = read_table(spark, sf, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
        "o_orderpriority", "o_totalprice", "o_orderstatus")


@register("chain_joined", """
WITH j AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, o_orderpriority,
                  o_totalprice, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT avg(l_quantity) AS qa, stddev_samp(l_quantity) AS qs, quantile_cont(l_discount, 0.05) AS d05,
             quantile_cont(l_discount, 0.95) AS d95, quantile_cont(o_totalprice, 0.25) AS t1,
             quantile_cont(o_totalprice, 0.5) AS t2, quantile_cont(o_totalprice, 0.75) AS t3 FROM j)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round((l_quantity - qa) / nullif(qs, 0), 6) AS l_quantity_scaled,
  round(ln(l_extendedprice + 1), 6) AS l_extendedprice_log,
  round(CASE WHEN l_discount IS NULL THEN NULL ELSE greatest(least(l_discount, d95), d05) END, 6) AS l_discount_winsorized,
  CAST(dense_rank() OVER (ORDER BY coalesce(o_orderpriority, '')) - 1 AS BIGINT) AS o_orderpriority_encoded,
  count(*) OVER (PARTITION BY l_returnflag) AS l_returnflag_freq,
  round((o_totalprice - t2) / nullif(t3 - t1, 0), 6) AS o_totalprice_robust_scaled,
  CAST(dense_rank() OVER (ORDER BY coalesce(o_orderstatus, '')) - 1 AS BIGINT) AS target
FROM j, s""")
def q_chain_joined(spark, sf):
    # the joined input feeds the statistics pass, the shared dictionary, the count
    # and the output: checkpoint its needed columns once (spark.checkpoint.dir)
    res = build_chain(lineitem_orders(spark, sf), JOINED_SPECS, target_column="o_orderstatus",
                      keep_columns=["l_orderkey", "l_linenumber"], stage_input=True)
    d = res.df
    return d.select(L("l_orderkey").alias("l_orderkey"), L("l_linenumber").alias("l_linenumber"),
                    R("l_quantity_scaled").alias("l_quantity_scaled"),
                    R("l_extendedprice_log").alias("l_extendedprice_log"),
                    R("l_discount_winsorized").alias("l_discount_winsorized"),
                    L("o_orderpriority_encoded").alias("o_orderpriority_encoded"),
                    L("l_returnflag_freq").alias("l_returnflag_freq"),
                    R("o_totalprice_robust_scaled").alias("o_totalprice_robust_scaled"),
                    L("target").alias("target"))


@register("sample_rows", """
SELECT * FROM lineitem ORDER BY """ + _DRAW.format("l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || 42") + """ LIMIT 1500""")
def q_sample_rows(spark, sf):
    """S2 with a row budget: 1,500 rows chosen by hash (the sampling is the feature)."""
    return IO.sample_rows(read_table(spark, sf, "lineitem"), 1500, key=["l_orderkey", "l_linenumber", "l_partkey"])


# ---------------------------------------------------------------------------
# Written to the shared folder and read back
# ---------------------------------------------------------------------------
_SECTIONS = {"click": "eda", "view": "fe", "error": "leakage", "purchase": "transform"}
_HISTORY_SQL = "h AS (SELECT CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SECTIONS.items()) + \
    """ END AS section, 'ds' AS dataset, 't' || user_id % 7 || CASE WHEN event_type = 'purchase' THEN '_transformed' ELSE '' END AS table_name,
  'run' || lpad(CAST(event_id // 20 AS VARCHAR), 8, '0') AS run_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS created_at, event_id
  FROM events WHERE event_type <> 'signup')"""


def _history(spark, sf):
    e = read_table(spark, sf, "events").where(F.col("event_type") != "signup")
    section = F.create_map(*[F.lit(x) for kv in _SECTIONS.items() for x in kv])[F.col("event_type")]
    table = F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string"), F.when(F.col("event_type") == "purchase", "_transformed").otherwise(""))
    return e.select(section.alias("section"), F.lit("ds").alias("dataset"), table.alias("table_name"),
                    F.concat(F.lit("run"), F.lpad(F.floor(F.col("event_id") / 20).cast("string"), 8, "0")).alias("run_id"),
                    F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("created_at"), "event_id")


@register("consolidated_report", f"""
WITH {_HISTORY_SQL}, m AS (SELECT * FROM h WHERE table_name = CASE WHEN section = 'transform' THEN 't3_transformed' ELSE 't3' END),
r AS (SELECT section, arg_max(run_id, (created_at, run_id)) AS run_id FROM m GROUP BY 1)
SELECT m.section, m.run_id, m.created_at,
  '{{"dataset":"ds","table_name":"' || table_name || '","event_id":' || event_id || '}}' AS record FROM m JOIN r USING (section, run_id)""")
def q_consolidated_report(spark, sf):
    """R11 over a history derived from events."""
    return H.consolidated(_history(spark, sf), "ds", "t3")


@register("run_rows", """
SELECT 'ds' AS dataset, 'orders' AS table_name, o_orderpriority AS feature_name, 'frequency_encoding' AS technique, CAST(count(*) AS VARCHAR) AS reason,
  'r1' AS run_id, TIMESTAMP '2024-05-01 12:00:00' AS created_at, 'fe' AS section, DATE '2024-05-01' AS run_date FROM orders GROUP BY 3""")
def q_run_rows(spark, sf):
    """One run's rows, appended to a history in the shared folder and read back."""
    import datetime as _dt
    import uuid
    rows = read_table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("feature_name")).agg(F.count(F.lit(1)).cast("string").alias("reason")) \
        .select(F.lit("ds").alias("dataset"), F.lit("orders").alias("table_name"), "feature_name", F.lit("frequency_encoding").alias("technique"), "reason")
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    H.append_run(path, "fe", rows, "r1", _dt.datetime(2024, 5, 1, 12))
    return H.read_history(spark, path, "fe").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@register("latest_columns", f"""
WITH {_HISTORY_SQL}, m AS (SELECT run_id, created_at, ['c' || event_id % 5, 'd' || event_id % 3] AS cols, event_id FROM h WHERE section = 'eda' AND table_name = 't2'),
b AS (SELECT arg_max(cols, (created_at, event_id)) AS cols FROM m)
SELECT CAST(unnest(range(2)) AS INTEGER) AS position, unnest(cols) AS column_name FROM b""")
def q_latest_columns(spark, sf):
    """R13 over a history derived from events."""
    cols = F.array(F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string")), F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")))
    eda = _history(spark, sf).where(F.col("section") == "eda").withColumn("columns", cols).withColumn("run_id", F.lpad(F.col("event_id").cast("string"), 12, "0"))
    return H.columns_of_latest(eda, "ds", "t2")


@register("chain_written", """
WITH s AS (SELECT avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS d FROM orders)
SELECT round((o_totalprice - a) / d, 6) AS o_totalprice_scaled,
  CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS o_orderpriority_encoded,
  CAST(count(*) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS o_orderstatus_freq FROM orders, s""")
def q_chain_written(spark, sf):
    """A chain written as a table and read back."""
    import uuid
    from .chain import apply_and_write
    path = f"{shared_dir(spark)}/orders_transformed-{uuid.uuid4().hex}"
    apply_and_write(read_table(spark, sf, "orders"), [
        {"column_name": "o_totalprice", "fe_method": "standardization"}, {"column_name": "o_orderpriority", "fe_method": "label_encoding"},
        {"column_name": "o_orderstatus", "fe_method": "frequency_encoding"}], None, path)
    out = IO.scan(spark, path)
    return out.select(R("o_totalprice_scaled").alias("o_totalprice_scaled"), L("o_orderpriority_encoded").alias("o_orderpriority_encoded"),
                      L("o_orderstatus_freq").alias("o_orderstatus_freq"))


@register("freq_encode_many", """
SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS o_orderstatus_freq,
  CAST(count(*) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS o_orderpriority_freq,
  CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS o_custkey_freq FROM orders""")
def q_freq_encode_many(spark, sf):
    """C2 on three columns: one staged count."""
    cols = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    out = apply_transforms(read_table(spark, sf, "orders"), [{"column_name": c, "fe_method": "frequency_encoding"} for c in cols]).df
    return out.select("o_orderkey", *[L(f"{c}_freq").alias(f"{c}_freq") for c in cols])


@register("target_encode_many", """
SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderstatus), 6) AS o_orderstatus_target_encoded,
  round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 6) AS o_orderpriority_target_encoded FROM orders""")
def q_target_encode_many(spark, sf):
    """C3 on two columns: one staged mean."""
    cols = ["o_orderstatus", "o_orderpriority"]
    out = apply_transforms(read_table(spark, sf, "orders"), [{"column_name": c, "fe_method": "target_encoding", "target_column": "o_totalprice"} for c in cols]).df
    return out.select("o_orderkey", *[R(f"{c}_target_encoded").alias(f"{c}_target_encoded") for c in cols])


@register("one_hot_collisions", """
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS k_a_b, CAST(o_orderstatus = 'O' AS INTEGER) AS k_a_b_2 FROM orders""")
def q_one_hot_collisions(spark, sf):
    """C6 on values whose column names collide ('a b' and 'a-b')."""
    o = read_table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "a b").when(F.col("o_orderstatus") == "O", "a-b").alias("k"))
    return one_hot_columns(o, "k", drop_original=True)
