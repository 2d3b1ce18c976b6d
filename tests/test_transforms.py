import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from featurespark import specs as S
from featurespark.operators.transforms import apply_transforms, fit_transforms, one_hot_columns

AGES = [35, 28, 45, None, 62, 31, 29, 55]
INCOME = [75000.0, 52000.0, 120000.0, 48000.0, 95000.0, None, 68000.0, 250000.0]


def _by_id(df, col):
    return {r["customer_id"]: r[col] for r in df.select("customer_id", col).collect()}


def test_reference_single_transforms(customers):
    specs = [{"column_name": "age", "fe_method": "standardization"},
             {"column_name": "income", "fe_method": "log_transformation"},
             {"column_name": "category", "fe_method": "label_encoding"},
             {"column_name": "age", "fe_method": "impute_mean"},
             {"column_name": "income", "fe_method": "missing_indicator"},
             {"column_name": "purchase_count", "fe_method": "binning", "num_bins": 4,
              "order_key": "customer_id"}]
    out = apply_transforms(customers, specs).df
    ages = pd.Series(AGES, dtype="float")
    z = _by_id(out, "age_standardized")
    assert z[4] is None
    assert z[1] == pytest.approx((35 - ages.mean()) / ages.std())
    assert _by_id(out, "income_log")[6] is None
    assert _by_id(out, "income_log")[1] == pytest.approx(math.log(75001))
    assert _by_id(out, "category_encoded") == {1: 1, 2: 2, 3: 1, 4: 0, 5: 1, 6: 2, 7: 2, 8: 1}
    assert _by_id(out, "age_imputed")[4] == pytest.approx(ages.mean())
    assert _by_id(out, "income_is_missing") == {i: int(i == 6) for i in range(1, 9)}
    # purchase counts 2,5,8,12,15,25,45,100 → two per tile
    assert _by_id(out, "purchase_count_bin") == {4: 1, 2: 1, 6: 2, 1: 2, 7: 3, 3: 3, 5: 4, 8: 4}


def test_null_semantics(customers):
    out = apply_transforms(customers, [
        {"column_name": "age", "fe_method": "custom_binning"},
        {"column_name": "age", "fe_method": "clip", "lower_bound": 30, "upper_bound": 50},
        {"column_name": "age", "fe_method": "normalization"},
        {"column_name": "category", "fe_method": "frequency_encoding"},
        {"column_name": "name", "fe_method": "extract_numbers"},
        {"column_name": "gender", "fe_method": "binary_encoding"}]).df
    assert _by_id(out, "age_binned")[4] == "very_high"      # NULL falls to ELSE
    clipped = _by_id(out, "age_clipped")
    assert clipped[4] is None and clipped[2] == 30 and clipped[5] == 50
    norm = [v for v in _by_id(out, "age_normalized").values() if v is not None]
    assert min(norm) == 0.0 and max(norm) == 1.0
    assert _by_id(out, "category_freq")[1] == 4
    assert set(_by_id(out, "name_number").values()) == {None}
    assert set(_by_id(out, "gender_binary").values()) == {0}


def test_impute_mode_smallest_on_tie(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, 1.0), (4, 1.0), (5, None)], "id long, x double")
    out = apply_transforms(df, [{"column_name": "x", "fe_method": "impute_mode"}]).df
    assert {r["id"]: r["x_imputed"] for r in out.collect()}[5] == 1.0


def test_date_parts_and_diff(customers):
    out = apply_transforms(customers, [
        {"column_name": "signup_date", "fe_method": "date_features"},
        {"column_name": "signup_date", "fe_method": "days_since", "reference_date": "2024-01-15"}]).df
    r = out.where("customer_id = 1").first()
    assert (r["signup_date_year"], r["signup_date_month"], r["signup_date_day"]) == (2023, 1, 15)
    assert r["signup_date_dayofweek"] == 1            # Sunday = 1
    assert r["signup_date_days_ago"] == 365


def test_interaction_ratio(customers):
    out = apply_transforms(customers, [
        {"column_name": "age", "fe_method": "interaction", "column1": "age", "column2": "purchase_count"},
        {"column_name": "income", "fe_method": "ratio", "column1": "income", "column2": "age"}]).df
    r = out.where("customer_id = 2").first()
    assert r["age_x_purchase_count"] == 140
    assert r["income_div_age"] == pytest.approx(52000 / 28)


@pytest.mark.parametrize("canonical", sorted(S.METHOD_NAMES))
def test_aliases_give_same_result(spark, customers, canonical):
    column = {"extract_date_parts": "signup_date", "date_diff": "signup_date", "lowercase": "name",
              "uppercase": "name", "trim": "name", "string_length": "name", "extract_numbers": "name",
              "label_encoding": "category", "frequency_encoding": "category", "hash_encoding": "category",
              "one_hot_encoding": "category", "binary_encoding": "gender", "impute_mode": "age"}.get(canonical, "age")
    extra = {"target_encoding": {"target_column": "income"}, "interaction": {"column2": "purchase_count"},
             "ratio": {"column2": "purchase_count"}, "binning": {"order_key": "customer_id"},
             "date_diff": {"reference_date": "2024-01-01"}}.get(canonical, {})
    results = []
    for name in S.METHOD_NAMES[canonical]:
        res = apply_transforms(customers, [{"column_name": column, "fe_method": name, **extra}],
                               include_original=False).df
        results.append(sorted(tuple(map(str, r)) for r in res.collect()))
    assert all(r == results[0] for r in results)


def test_one_hot_columns(customers):
    out = one_hot_columns(customers, "category")
    assert {"category_Basic", "category_Premium", "category_Standard"} <= set(out.columns)
    assert out.agg(F.sum("category_Premium")).first()[0] == 4
    with pytest.raises(ValueError):
        one_hot_columns(customers, "name", max_values=3)


def test_fitted_on_new_rows(spark, customers):
    fitted = fit_transforms(customers, [{"column_name": "age", "fe_method": "standardization"},
                                        {"column_name": "category", "fe_method": "label_encoding"}])
    new = spark.createDataFrame([(9, 40, "Premium"), (10, None, "Gold")], "customer_id long, age int, category string")
    out = {r["customer_id"]: r for r in fitted.transform(new).df.collect()}
    assert out[9]["category_encoded"] == 1 and out[10]["category_encoded"] is None
    assert out[10]["age_standardized"] is None


def test_modes_of_many_columns(spark):
    from featurespark.stats import modes_of
    df = spark.createDataFrame([(1, 5, "b"), (1, 6, "a"), (2, 6, "a"), (2, 5, None), (None, 7, "b")],
                               "x int, y int, s string")
    assert modes_of(df, ["x", "y", "s"]) == {"x": 1, "y": 5, "s": "a"}


def test_properties_on_events(spark):
    """Row count kept by every transform; clips stay inside their bounds and
    keep NULLs; min-max output in [0, 1]."""
    from tests.conftest import SF01
    ev = spark.read.parquet(f"{SF01}/events.parquet").withColumn(
        "value", F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("value")))
    n = ev.count()
    specs = [{"column_name": "value", "fe_method": m} for m in
             ("standardization", "normalization", "log_transformation", "sqrt_transformation", "robust_scaling",
              "impute_median", "clip_iqr", "winsorize", "polynomial_features", "missing_indicator")]
    specs += [{"column_name": "value", "fe_method": "clip", "lower_bound": 5, "upper_bound": 50},
              {"column_name": "value", "fe_method": "binning", "order_key": "event_id"},
              {"column_name": "event_type", "fe_method": "label_encoding"},
              {"column_name": "event_type", "fe_method": "frequency_encoding"}]
    out = apply_transforms(ev, specs).df
    assert out.count() == n
    # two clip specs: clip_iqr → value_clipped, fixed bounds → value_clipped_2
    r = out.agg(F.min("value_normalized"), F.max("value_normalized"), F.min("value_clipped_2"),
                F.max("value_clipped_2"), F.count_if(F.col("value").isNull() & F.col("value_clipped").isNotNull()),
                F.count_if(F.col("value").isNull() & F.col("value_winsorized").isNotNull())).first()
    assert r[0] == 0.0 and r[1] == 1.0
    assert 5 <= r[2] and r[3] <= 50 and r[4] == 0 and r[5] == 0
    sizes = [x["count"] for x in out.groupBy("value_bin").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_many_label_encodings_share_one_dictionary(spark):
    import duckdb
    from tests.conftest import SF01
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    cols = ["l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_quantity"]
    out = apply_transforms(li, [{"column_name": c, "fe_method": "label_encoding"} for c in cols],
                           include_original=False, rows_per_bucket=7).df
    got = sorted(map(tuple, out.collect()))
    def text(c):
        if c.startswith("l_return") or c.startswith("l_line"):
            return c
        return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
    sql = ", ".join(f"CAST(dense_rank() OVER (ORDER BY coalesce({text(c)}, '')) - 1 AS BIGINT)" for c in cols)
    ref = sorted(duckdb.sql(f"SELECT {sql} FROM '{SF01}/lineitem.parquet'").fetchall())
    assert got == ref


def test_many_frequency_encodings_share_one_count(spark, customers):
    out = apply_transforms(customers, [{"column_name": c, "fe_method": "frequency_encoding"}
                                       for c in ("category", "gender", "age")]).df
    r = {x["customer_id"]: x for x in out.collect()}
    assert r[1]["category_freq"] == 4 and r[1]["gender_freq"] == 4 and r[4]["age_freq"] == 1
    assert r[4]["age"] is None


def test_target_encodings_share_one_mean(spark, customers):
    specs = [{"column_name": c, "fe_method": "target_encoding", "target_column": "income"}
             for c in ("category", "gender", "age")]
    out = {r["customer_id"]: r for r in apply_transforms(customers, specs).df.collect()}
    premium = [75000.0, 120000.0, 95000.0, 250000.0]
    assert out[1]["category_target_encoded"] == pytest.approx(sum(premium) / 4)
    assert out[6]["gender_target_encoded"] == pytest.approx((52000 + 48000 + 250000) / 3)   # NULL income skipped
    assert out[4]["age_target_encoded"] == pytest.approx(48000.0)                          # NULL age group
    single = {r["customer_id"]: r for r in apply_transforms(customers, specs[:1]).df.collect()}
    assert all(single[i]["category_target_encoded"] == out[i]["category_target_encoded"] for i in single)
