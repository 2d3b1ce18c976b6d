import math

import pandas as pd
import pytest

from featurespark.plans.chain import assert_no_nulls, build_chain


def test_reference_chain_scenario(customers):
    """The reference test's chained spec list (two of its steps were silently
    dropped there; here every step applies)."""
    specs = [{"column_name": "age", "fe_method": "standardization"},
             {"column_name": "income", "fe_method": "log_transformation"},
             {"column_name": "category", "fe_method": "label_encoding"},
             {"column_name": "age", "fe_method": "impute_mean"},
             {"column_name": "income", "fe_method": "missing_indicator"},
             {"column_name": "signup_date", "fe_method": "extract_date_parts"}]
    res = build_chain(customers, specs, target_column="category", keep_columns=["customer_id"])
    cols = res.df.columns
    assert "age_imputed_scaled" in cols and "income_log_is_missing" in cols and "target" in cols
    assert "signup_date_year" in cols and "category_encoded" not in cols
    out = {r["customer_id"]: r for r in res.df.collect()}
    ages = pd.Series([35, 28, 45, None, 62, 31, 29, 55], dtype="float")
    # scale uses raw-column stats: imputed row → (mean - mean)/std = 0
    assert out[4]["age_imputed_scaled"] == pytest.approx(0.0)
    assert out[1]["age_imputed_scaled"] == pytest.approx((35 - ages.mean()) / ages.std())
    # log then missing flag of the logged value
    assert out[6]["income_log_is_missing"] == 1 and out[1]["income_log_is_missing"] == 0
    assert out[1]["target"] == 1 and out[4]["target"] == 0
    lineage = {l["output_column"]: l["transformations"] for l in res.lineage}
    assert lineage["age_imputed_scaled"] == ["impute_mean", "standardization"]


def test_auto_binary_target_and_suffix_dedupe(customers):
    specs = [{"column_name": "income", "fe_method": "median imputation"},
             {"column_name": "income", "fe_method": "clip_outliers"},
             {"column_name": "income", "fe_method": "outlier removal"}]
    res = build_chain(customers, specs, target_column="gender")
    assert res.df.columns == ["income_imputed_clipped", "target"]
    assert {r["target"] for r in res.df.collect()} == {0}


def test_chain_hash_default_50(customers):
    res = build_chain(customers, [{"column_name": "category", "fe_method": "hash_encoding"}])
    assert res.df.columns == ["category_encoded"]
    assert all(0 <= r[0] < 50 for r in res.df.collect())


def test_chain_stage_dependent_encodings(customers):
    res = build_chain(customers, [{"column_name": "age", "fe_method": "impute_mode"},
                                  {"column_name": "age", "fe_method": "frequency_encoding"}],
                      keep_columns=["customer_id"])
    out = {r["customer_id"]: r["age_imputed_freq"] for r in res.df.collect()}
    # all ages distinct; mode = smallest (28) → NULL becomes 28 → count 2
    assert out[4] == 2 and out[2] == 2 and out[1] == 1


def test_assert_no_nulls(customers):
    assert assert_no_nulls(customers) == {"age": 1, "income": 1}


def test_odd_column_name(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, `user-name` string")
    res = build_chain(df, [{"column_name": "user-name", "fe_method": "uppercase"}])
    assert res.df.columns == ["user_name_upper"]
    assert sorted(r[0] for r in res.df.collect()) == ["A", "B"]


def test_chain_with_staged_input_matches(spark):
    from featurespark.plans.registered import JOINED_SPECS, lineitem_orders
    from tests.conftest import SF001
    df = lineitem_orders(spark, SF001)
    a = build_chain(df, JOINED_SPECS, target_column="o_orderstatus", keep_columns=["l_orderkey", "l_linenumber"]).df
    b = build_chain(df, JOINED_SPECS, target_column="o_orderstatus", keep_columns=["l_orderkey", "l_linenumber"],
                    stage_input=True).df
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_lineage_from_specs_alone(spark, customers):
    from featurespark.plans.chain import chain_lineage
    specs = [{"column_name": "age", "fe_method": "impute_mean"}, {"column_name": "category", "fe_method": "label_encoding"},
             {"column_name": "age", "fe_method": "standardization"}]
    assert chain_lineage(specs, customers.columns, "gender") == build_chain(customers, specs, target_column="gender").lineage


def test_constant_fill_changes_the_type(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    res = build_chain(df, [{"column_name": "x", "fe_method": "impute_constant", "fill_value": 0.5}, {"column_name": "x", "fe_method": "label_encoding"}])
    assert sorted(r[0] for r in res.df.collect()) == [0, 1]


def test_staged_tables_are_dropped(spark, tmp_path, monkeypatch):
    import os
    from featurespark import session
    monkeypatch.setattr(session, "_STAGED", {})          # leave other tests' tables alone
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    session.stage(spark.range(5), "x").count()
    assert [d for d in os.listdir(tmp_path) if d.startswith("x-")]
    assert session.drop_staged(spark) == 1
    assert not [d for d in os.listdir(tmp_path) if d.startswith("x-")]
