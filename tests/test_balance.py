from pyspark.sql import functions as F

from featurespark.operators import balance as B
from featurespark.operators.smoter import smoter
from tests.conftest import SF01


def test_oversample_exact_counts_and_original_rows(spark):
    df = spark.range(0, 1000).select("id", F.when(F.col("id") < 700, "a").when(F.col("id") < 950, "b")
                                     .otherwise("c").alias("cls"), (F.col("id") * 3).alias("v"))
    out = B.random_oversample(df, "cls", seed=7, rows_per_bucket=40)
    counts = {r["cls"]: r["count"] for r in out.groupBy("cls").count().collect()}
    assert counts == {"a": 700, "b": 700, "c": 700}
    # every drawn row is an original row of its class
    assert out.join(df, ["id", "cls", "v"], "left_anti").count() == 0
    again = B.random_oversample(df, "cls", seed=7, rows_per_bucket=40)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_qcut_matches_pandas(spark):
    import pandas as pd
    vals = [1, 1, 1, 2, 3, 3, 4, 10, 10, 50, 51, 52]
    df = spark.createDataFrame([(float(v),) for v in vals], "y double")
    got = [r["count"] for r in B.qcut_distribution(df, "y").orderBy("bin").collect()]
    ref = pd.qcut(pd.Series(vals, dtype=float), 4, duplicates="drop").value_counts(sort=False).tolist()
    assert got == ref


def test_imbalance_and_bias(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rec = B.imbalance_analysis(labels, "toxic").first()
    assert rec["majority_class"] == "0" and rec["is_imbalanced"] and rec["recommended_method"] == "random_oversampling"
    df = spark.createDataFrame([("m", 1)] * 50 + [("f", 1)] * 10 + [("f", 0)] * 40, "gender string, y int")
    rep = B.bias_report(B.group_outcomes(df, "y")).collect()
    assert {(r["feature"], r["bias_type"], r["risk"]) for r in rep} == {("gender", "outcome", "high")}


def test_prepare_rows(spark):
    df = spark.createDataFrame([(1, None, None, True), (None, 2.0, "x", None), (3, 4.0, None, False)],
                               "t int, a double, s string, b boolean")
    out = B.prepare_rows(df, "t").orderBy("t").collect()
    assert len(out) == 2 and out[0]["a"] == 4.0 and out[0]["s"] == "missing" and out[1]["s"] == "missing"


def test_smoter_properties(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet").select("event_id", "user_id", "event_type", "value")
    out, info = smoter(ev, "value", rows_per_bucket=500)
    assert info["gate"]["apply"]
    n_syn = sum(info["synthetic"].values())
    assert out.count() == ev.count() + n_syn
    lo, med, hi = info["relevance_points"]
    syn = out.join(ev, ["event_id", "user_id", "event_type", "value"], "left_anti")
    # synthetic targets stay inside the rare bumps' range of the data
    mm = syn.agg(F.min("value"), F.max("value")).first()
    full = ev.agg(F.min("value"), F.max("value")).first()
    assert mm[0] >= full[0] and mm[1] <= full[1]
    assert syn.where((F.col("value") > lo) & (F.col("value") < hi) & (F.abs(F.col("value") - med) < 1e-9)).count() == 0


def test_smoter_gate_refuses_symmetric(spark):
    df = spark.range(0, 100).select(F.col("id").cast("double").alias("y"))
    out, info = smoter(df, "y")
    assert not info["gate"]["apply"] and out.count() == 100


def test_balance_table_flow(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    res = B.balance_table(labels, "quality")
    assert res["post_summary"].first()["balance_status"] == "Balanced"
    assert res["pre_summary"].first()["imbalance_ratio"] > 5
    assert res["preview"].count() == 100
    ev = spark.read.parquet(f"{SF01}/events.parquet").select("user_id", "value")
    res = B.balance_table(ev, "value", target_type="continuous")
    assert res["balanced"].count() >= ev.count() and res["smoter"]["gate"]["apply"]


def test_shuffle_rows_keeps_rows(spark):
    df = spark.range(0, 500)
    out = B.shuffle_rows(df, seed=3)
    assert sorted(r[0] for r in out.collect()) == list(range(500))
    assert [r[0] for r in out.limit(5).collect()] != [0, 1, 2, 3, 4]
