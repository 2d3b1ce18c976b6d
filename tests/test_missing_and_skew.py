"""NaN, empty tables, long texts and hot groups."""
import os

import pytest
from pyspark.sql import functions as F

from featurespark import session
from featurespark.operators import balance as B, contingency, frequent, profile as P, recommend as RC
from featurespark.operators.leakage import leakage_report
from featurespark.stats import StatsPlan, modes_of


def test_nan_is_missing_to_modes_rows_and_gate(spark):
    df = spark.createDataFrame([(float("nan") if i % 3 else float(i % 12), float(i % 5), "ab"[i % 2]) for i in range(300)], "x double, y double, s string")
    assert modes_of(df, ["x"])["x"] == 0.0 and modes_of(df, ["x", "y"]) == {"x": 0.0, "y": 0.0}
    assert B.prepare_rows(df, "s").where("isnan(x)").count() == 0
    assert B.prepare_rows(df, "x").count() == 100
    symmetric = spark.createDataFrame([(float(i - 50),) for i in range(101)] + [(float("nan"),)] * 20, "y double")
    gate = B.smoter_gate(symmetric, "y")
    assert not gate["apply"] and gate["distinct"] == 101 and abs(gate["skewness"]) < 1e-9
    assert not B.smoter_gate(spark.createDataFrame([(float(i),) for i in range(20)] + [(float("inf"),)], "y double"), "y")["apply"]


def test_empty_tables_flag_nothing(spark):
    none = spark.createDataFrame([], "id long, city string, y double")
    assert P.cardinality(none).where("id_like").count() == 0
    assert P.cardinality(none, exact=False).where("id_like").count() == 0
    assert RC.recommendations(none).where("category = 'drop'").count() == 0
    assert leakage_report(none, "y").collect() == []
    assert P.top_values(none, ["city"], 3).collect() == [] and P.column_metadata(none).count() == 3


def test_no_statistics_no_job(spark):
    assert StatsPlan().fit(spark.range(5).select(F.raise_error(F.lit("read")).alias("x"))).values == {}


def test_top_values_of_long_texts(spark, monkeypatch):
    """Long texts that share their first characters and their count: the texts decide, in bounded sets."""
    monkeypatch.setattr(frequent, "TIED", 7)
    head = "the same beginning of every text, for more than thirty-two characters "
    texts = [head + "x" * (i % 5) * 100 + f"{i:04d}" for i in range(400)] + ["short", "short", head, head + "often", head + "often", head + "often"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").repartition(5)
    counts = {t: texts.count(t) for t in texts}
    want = sorted(counts, key=lambda t: (-counts[t], t))[:9]
    assert [(r["rank"], r["value"], r["count"]) for r in P.top_values(df, ["t"], 9).orderBy("rank").collect()] == [(i + 1, t, counts[t]) for i, t in enumerate(want)]
    assert P.column_metadata(df, 6).first()["sample_values"] == sorted(counts)[:6]
    assert P.column_metadata(df).first()["distinct_count"] == len(counts)


def _staged_bytes(spark, before):
    return sum(os.path.getsize(os.path.join(d, f)) for p in session._staged(spark)[before:] for d, _, fs in os.walk(p) for f in fs if f.endswith(".parquet"))


def test_staged_bytes_do_not_follow_text_length(spark):
    sizes = []
    for n in (100, 4000):
        df = spark.range(0, 500).select(F.concat(F.repeat(F.md5(F.col("id").cast("string")), n // 32 + 1), F.col("id").cast("string")).alias("t"), (F.col("id") % 2).alias("label"))
        before = len(session._staged(spark))
        counts = frequent.counted(P.text_values(df, ["t"]))
        contingency.chi2_scores(df, ["t"], "label").collect()
        sizes.append(_staged_bytes(spark, before))
        assert counts.count() == 500
    assert abs(sizes[1] - sizes[0]) < 0.05 * sizes[0]


def test_profile_without_a_target_stages_no_text(spark):
    df = spark.range(0, 400).select("id", F.repeat(F.md5(F.col("id").cast("string")), 200).alias("t"))
    before = len(session._staged(spark))
    report = P.profile(df)
    assert "missing_values" in report and _staged_bytes(spark, before) < 400 * 6400 / 8


def test_chi_square_joins_no_two_key_exchange(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("y", F.col("doc_id") % 2)
    plan = contingency.chi2_scores(df, ["text", "lang"], "y")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(column_name" in plan and not any("hashpartitioning(column_name" in x and "tvalue" in x and "salt" not in x and "value#" not in x.replace("tvalue#", "") for x in plan.splitlines())


def test_a_one_row_class_drawn_many_times(spark):
    """Its draws spread over copies of the row: no task has over twice the median."""
    rows = [(0, "tiny")] + [(i, "large") for i in range(1, 3000)] + [(i, "most") for i in range(3000, 203_000)]
    df = spark.createDataFrame(rows, "id long, c string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = B.random_oversample(df, "c", order_key="id")
        assert {r["c"]: r["count"] for r in out.groupBy("c").count().collect()} == {"tiny": 200_000, "large": 200_000, "most": 200_000}
        sizes = [r["count"] for r in out.where("c <> 'most'").groupBy(F.spark_partition_id()).count().orderBy("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    busy = [s for s in sizes if s > 5000]
    assert len(busy) >= 8 and max(busy) <= 2 * busy[len(busy) // 2]


@pytest.mark.parametrize("name", ["cls", "row", "at", "idx", "salt", "n"])
def test_oversampling_with_clashing_names(spark, name):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(40)], f"{name} long, y string")
    assert B.random_oversample(df, "y").groupBy("y").count().where("count <> 30").count() == 0
