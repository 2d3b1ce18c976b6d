"""Skewed shapes: one key on a third of the rows, tiny classes, constant columns —
results must stay whole and exact on both the broadcast and the shuffle path."""
from pyspark.sql import functions as F

from featurespark.operators import balance as B
from featurespark.operators import rank
from featurespark.operators.transforms import apply_transforms


def _skewed(spark, n=3000):
    return spark.range(0, n).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                    .otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"),
                                    (F.col("id") % 11).cast("double").alias("y"))


def test_hot_key_encodings_shuffle_path(spark):
    df = _skewed(spark)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    specs = [{"column_name": "k", "fe_method": "frequency_encoding"},
             {"column_name": "k", "fe_method": "label_encoding"},
             {"column_name": "k", "fe_method": "target_encoding", "target_column": "y"}]
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        a = apply_transforms(df, specs, rows_per_bucket=10).df   # shuffle joins
        # the only broadcasts left are of partition offsets, one row each
        assert "SortMergeJoin" in a._jdf.queryExecution().executedPlan().toString()
        assert a.count() == df.count()
        ra = sorted(map(tuple, a.collect()))
        hot = a.where("k = 'hot'").select("k_freq").distinct().collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    b = apply_transforms(df, specs).df                                            # broadcast joins
    rb = sorted(map(tuple, b.collect()))
    assert ra == rb
    assert [r[0] for r in hot] == [1000]


def test_tiny_class_many_draws(spark, monkeypatch):
    df = spark.range(0, 5003).select("id", F.when(F.col("id") < 5000, "big").otherwise("tiny").alias("c"))
    for block in (100, 100_000):                    # draws in many blocks and in one
        monkeypatch.setattr(B, "DRAW_BLOCK", block)
        out = B.random_oversample(df, "c", seed=1, rows_per_bucket=100)
        counts = {r["c"]: r["count"] for r in out.groupBy("c").count().collect()}
        assert counts == {"big": 5000, "tiny": 5000}
        assert {r[0] for r in out.where("c = 'tiny'").select("id").distinct().collect()} == {5000, 5001, 5002}


def test_constant_column_ntile(spark):
    df = spark.range(0, 2000).withColumn("x", F.lit(1.0))
    out = rank.global_ntile(df, "x", 4, "id", 2000, "b", rows_per_bucket=50)
    sizes = {r["b"]: r["count"] for r in out.groupBy("b").count().collect()}
    assert sizes == {1: 500, 2: 500, 3: 500, 4: 500}
    first = {r["id"] for r in out.where("b = 1").collect()}
    assert first == set(range(500))
