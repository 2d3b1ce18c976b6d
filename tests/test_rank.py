import duckdb
import pandas as pd
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from featurespark import stats
from featurespark.operators import quantiles, rank
from featurespark.operators.selection import Selection


def _duck_ntile(pdf, k):
    return duckdb.sql(f"SELECT id, ntile({k}) OVER (ORDER BY x NULLS FIRST, id) AS b FROM pdf").df()


def test_ntile_many_buckets_with_skew_and_nulls(spark):
    # a third of the rows share one value; some NULLs
    rows = [(i, 7.0 if i % 3 == 0 else (None if i % 17 == 0 else float(i % 101))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double")
    out = rank.global_ntile(df, "x", 7, "id", 3000, "b", rows_per_bucket=100)
    got = out.toPandas().set_index("id")["b"]
    ref = _duck_ntile(pd.DataFrame(rows, columns=["id", "x"]), 7).set_index("id")["b"]
    assert (got.sort_index() == ref.sort_index()).all()
    sizes = got.value_counts()
    assert sizes.max() - sizes.min() <= 1


def test_hot_value_spreads_over_partitions(spark):
    rows = [(i, 1.0 if i < 1000 else float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double")
    p = rank.placed(df, [rank.SortKey("x"), rank.SortKey("id")], 3000, 100)
    assert p.rows.where("x = 1.0").select(p.part).distinct().count() >= 5     # split by the tie-break key


def test_equal_rows_spread_and_get_distinct_numbers(spark):
    df = spark.range(0, 4000).select(F.lit(1.0).alias("x"))
    p = rank.placed(df, [rank.SortKey("x")], 4000, 200)
    assert p.rows.select(p.part).distinct().count() >= 5
    out = rank.global_row_number(df, [rank.SortKey("x")], 4000, rows_per_bucket=200)
    assert sorted(r["__rn"] for r in out.collect()) == list(range(1, 4001))


def test_plan_does_not_grow_with_partitions(spark):
    df = spark.range(0, 20_000).withColumn("x", F.col("id") % 997)
    keys = [rank.SortKey("x"), rank.SortKey("id")]
    sizes = []
    for per in (1000, 10):
        out = rank.global_row_number(df, keys, 20_000, rows_per_bucket=per)
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        assert out.agg(F.max("__rn"), F.count_distinct("__rn")).first() == (20_000, 20_000)
    assert abs(sizes[0] - sizes[1]) < 200


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=60), st.integers(1, 9))
def test_ntile_property(spark, xs, k):
    rows = [(i, None if v is None else float(v)) for i, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "id long, x double")
    got = rank.global_ntile(df, "x", k, "id", len(rows), "b", rows_per_bucket=7).toPandas().set_index("id")["b"]
    ref = _duck_ntile(pd.DataFrame(rows, columns=["id", "x"]), k).set_index("id")["b"]
    assert (got.sort_index() == ref.sort_index()).all()


def test_dense_rank_dictionary(spark):
    df = spark.createDataFrame([(s,) for s in ["b", "a", "c", "a", "", "b", "z"] * 20], "v string")
    d = rank.dense_rank_dictionary(df, "v", rows_per_bucket=2)
    assert {r["v"]: r["code"] for r in d.collect()} == {"": 0, "a": 1, "b": 2, "c": 3, "z": 4}


def test_no_single_partition_window(spark):
    df = spark.range(0, 5000).withColumn("x", F.col("id") % 13)
    out = rank.global_ntile(df, "x", 4, "id", 5000, "b", rows_per_bucket=500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_dictionary_of_many_partitions(spark):
    d = spark.createDataFrame([(s,) for s in [f"v{i:03d}" for i in range(300)] + [""] * 5], "v string")
    codes = {r["v"]: r["code"] for r in rank.dense_rank_dictionary(d, "v", rows_per_bucket=3).collect()}
    assert codes[""] == 0 and codes["v000"] == 1 and codes["v299"] == 300


def test_names_of_helpers_do_not_clash(spark):
    df = spark.range(0, 300).select("id", *[F.lit(1.0).alias(c) for c in ("__rn", "at", "part", "place", "before", "any", "which", "number", "key", "k0", "__tie")])
    out = rank.global_ntile(df, "id", 3, None, None, "tile")
    assert out.columns == [*df.columns, "tile"] and out.groupBy("tile").count().where("count <> 100").count() == 0
    numbered = rank.global_row_number(df, [rank.SortKey("id")], 300, "row", rows_per_bucket=50)
    assert numbered.columns == [*df.columns, "row"] and numbered.where("row <> id + 1").count() == 0


def test_ntile_neither_sorts_nor_writes(spark):
    from featurespark import session
    from featurespark.plans.inspect import plan_summary
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    before = list(session._staged(spark))
    out = rank.global_ntile(orders, "o_totalprice", 4, "o_orderkey", None, "tile")
    assert plan_summary(out).shuffles == 0
    out.collect()
    assert session._staged(spark) == before


def test_ntile_of_equal_rows_and_other_types(spark):
    same = spark.range(0, 1000).select(F.when(F.col("id") < 600, F.lit("a")).otherwise("b").alias("x"))
    got = {(r["x"], r["tile"]): r["count"] for r in rank.global_ntile(same, "x", 7, None, None, "tile").groupBy("x", "tile").count().collect()}
    want = duckdb.sql("SELECT x, tile, count(*) FROM (SELECT x, ntile(7) OVER (ORDER BY x) AS tile FROM (SELECT CASE WHEN range < 600 THEN 'a' ELSE 'b' END AS x FROM range(1000))) GROUP BY ALL").fetchall()
    assert got == {(x, t): n for x, t, n in want}
    typed = spark.range(0, 40).select("id", F.timestamp_seconds(F.col("id") * 86_400 * 5).alias("ts"), F.timestamp_seconds(F.col("id") * 7).cast("timestamp_ntz").alias("tn"),
                                      F.col("id").cast("decimal(20,3)").alias("d"), F.when(F.col("id") % 9 == 0, F.lit(None)).when(F.col("id") == 5, float("nan")).otherwise(-F.col("id")).cast("double").alias("x"),
                                      F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.col("id").cast("string").alias("s"))
    for c in typed.columns[1:]:
        out = rank.global_ntile(typed, c, 6, "id", None, "tile")
        w = Window.orderBy(F.col(c).asc_nulls_first(), "id")
        assert out.withColumn("want", F.ntile(6).over(w)).where("tile <> want").count() == 0, c
    assert rank.global_ntile(typed.limit(0), "x", 3, "id", None, "tile").count() == 0
    assert sorted(r["tile"] for r in rank.global_ntile(typed.limit(2), "id", 5, "id", None, "tile").collect()) == [1, 2]


def test_selection_narrows_in_bounded_samples(spark, monkeypatch):
    """A small sample: many rounds, a hot value, and ranks at both ends."""
    df = spark.range(0, 50_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 50_000).cast("double")).alias("x"), "id")
    chosen = Selection(df, [F.col("x"), F.col("id")], sample_rows=1)
    ranks = [1, 2, 16_000, 25_000, 49_999, 50_000]
    rows = sorted(tuple(r) for r in df.select("x", "id").collect())
    assert chosen.at(ranks, 50_000) == [rows[r - 1] for r in ranks]
    assert Selection(df, [F.col("x")], sample_rows=1).at([100, 12_000], 50_000) == [(rows[99][0],), (7.0,)]


def test_a_missed_bracket_is_narrowed(spark, monkeypatch):
    """Sketches that are always wrong: the quantiles are still right, and no task orders more
    than a small part of a column."""
    df = spark.range(0, 60_000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 60_000).cast("double").alias("x"))
    requests = [("cont", 0.25), ("disc", 0.5), ("cont", 0.9)]
    wrong = lambda x, requests: F.array(*[F.lit(v) for _ in requests for v in (-2.0, -1.0)])
    monkeypatch.setattr(quantiles, "sketch", wrong)
    monkeypatch.setattr(stats, "sketch", wrong)
    ordered = []
    ranked = quantiles._ranked

    def watched(inside, keys, ranks):
        ordered.append(inside.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
        return ranked(inside, keys, ranks)

    monkeypatch.setattr(quantiles, "_ranked", watched)
    plan = stats.StatsPlan()
    plan.need_q("x", 0.25), plan.need_qdisc("x", 0.5), plan.need_q("x", 0.9)
    got = plan.fit(df)
    assert (got.q("x", 0.25), got[("qd", "x", 0.5)], got.q("x", 0.9)) == (14_999.75, 29_999.0, 53_999.1)
    rows = quantiles.grouped_quantiles(df, ["g"], "x", requests).orderBy("g").collect()
    want = duckdb.sql("SELECT g, quantile_cont(x, 0.25), quantile_disc(x, 0.5), quantile_cont(x, 0.9) FROM (SELECT range % 2 AS g, ((range * 7919) % 60000)::DOUBLE AS x FROM range(60000)) GROUP BY g ORDER BY g").fetchall()
    assert [(r["g"], round(r["q0"], 6), r["q1"], round(r["q2"], 6)) for r in rows] == [(g, round(a, 6), b, round(c, 6)) for g, a, b, c in want]
    assert max(ordered) <= 1000
