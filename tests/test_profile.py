import numpy as np
import pytest
from pyspark.sql import functions as F

from featurespark.operators import contingency
from featurespark.operators import profile as P


def _chi2_brute(table, correction=True):
    """scipy.stats.chi2_contingency's statistic, written out with numpy."""
    obs = np.asarray(table, dtype=float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    dof = (obs.shape[0] - 1) * (obs.shape[1] - 1)
    if dof == 0:
        return 0.0
    if dof == 1 and correction:
        d = exp - obs
        obs = obs + np.sign(d) * np.minimum(0.5, np.abs(d))
    return float(((obs - exp) ** 2 / exp).sum())


@pytest.mark.parametrize("rows", [
    [("a", "x")] * 10 + [("a", "y")] * 3 + [("b", "x")] * 2 + [("b", "y")] * 9,     # 2x2, Yates
    [("a", "x")] * 10 + [("b", "y")] * 9,                                          # 2x2 with zero cells
    [("a", "x")] * 4 + [("b", "y")] * 5 + [("c", "x")] * 2 + [("c", "z")] * 7,      # 3x3 with zero cells
    [("a", "x")] * 4 + [("a", "y")] * 5,                                           # one row → 0
])
def test_chi2_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "f string, t string")
    got = contingency.chi2_with_missing(df, ["f"], "t").first()["chi2"]
    fs, ts = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    table = [[sum(1 for r in rows if r == (f, t)) for t in ts] for f in fs]
    assert got == pytest.approx(_chi2_brute(table), rel=1e-9, abs=1e-12)


def test_missing_and_outliers(customers):
    m = {r["column_name"]: (r["missing_count"], r["missing_pct"]) for r in P.missing_report(customers).collect()}
    assert m["age"] == (1, 12.5) and m["name"] == (0, 0.0)
    o = {r["column_name"]: r["outlier_count"] for r in P.iqr_outliers(customers, ["purchase_count", "income"]).collect()}
    assert o.get("purchase_count") == 1


def test_top_k_with_hot_value(spark):
    rows = [("hot",)] * 500 + [(f"v{i % 40}",) for i in range(400)]
    df = spark.createDataFrame(rows, "c string")
    top = P.top_values(df, ["c"], k=3).orderBy("rank").collect()
    assert [r["value"] for r in top] == ["hot", "v0", "v1"]
    assert top[0]["count"] == 500


def test_univariate_categorical_skips_all_null(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", None)], "c string, d string")
    out = P.univariate_categorical(df, ["c", "d"]).collect()
    assert len(out) == 1 and out[0]["mode"] == "a" and out[0]["unique_count"] == 2


def test_histogram_matches_numpy(spark):
    xs = [float(v) for v in np.random.default_rng(1).gamma(2.0, 3.0, 500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    h = {r["bin"]: r["count"] for r in P.histogram(df, ["x"]).collect()}
    ref, _ = np.histogram(xs, bins=30)
    assert [h.get(i + 1, 0) for i in range(30)] == list(ref)


def test_univariate_numeric_skew_matches_pandas(customers):
    r = {x["column_name"]: x for x in P.univariate_numeric(customers, ["purchase_count"], "per_column").collect()}
    import pandas as pd
    s = pd.Series([12, 5, 25, 2, 45, 8, 15, 100], dtype=float)
    assert r["purchase_count"]["skewness"] == pytest.approx(s.skew())
    assert r["purchase_count"]["kurtosis"] == pytest.approx(((s - s.mean()) ** 4).mean() / s.var(ddof=0) ** 2 - 3)


def test_profile_composes(customers):
    rep = P.profile(customers, target="category")
    assert {"overview", "missing_values", "chi2", "box_stats", "feature_types"} <= set(rep)
    assert rep["overview"].first()["rows"] == 8


def _quantiles(df, columns, requests, **kw):
    from featurespark.operators import quantiles as Q
    aggs = [a for i, c in enumerate(columns) for a in (F.count(c).alias(f"n{i}"), Q.sketch(F.col(c).cast("double"), requests).alias(f"s{i}"))]
    row = df.agg(*aggs).first()
    return Q.column_quantiles(df, {c: requests for c in columns}, {c: row[f"n{i}"] for i, c in enumerate(columns)},
                              {c: kw.get("sketches", row[f"s{i}"]) for i, c in enumerate(columns)})


REQUESTS = [(k, p) for k in ("cont", "disc") for p in (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)]


def _duck_quantile(kind, c, p, where=""):
    import duckdb
    from tests.conftest import SF01
    return duckdb.sql(f"SELECT quantile_{kind}({c}, {p}) FROM '{SF01}/lineitem.parquet' {where}").fetchall()[0][0]


@pytest.mark.parametrize("whole", [0, 1_000_000])
def test_quantiles_match_duckdb(spark, monkeypatch, whole):
    """With brackets from the sketch, and with everything ordered."""
    from featurespark.operators import quantiles as Q
    from tests.conftest import SF01
    monkeypatch.setattr(Q, "WHOLE", whole)
    df = spark.read.parquet(f"{SF01}/lineitem.parquet")
    columns = ["l_extendedprice", "l_quantity", "l_discount"]
    for (k, c, p), v in _quantiles(df, columns, REQUESTS).items():
        assert v == pytest.approx(_duck_quantile(k, c, p), rel=1e-12, abs=1e-9), (k, c, p)


def test_quantiles_survive_a_wrong_bracket(spark, monkeypatch):
    from featurespark.operators import quantiles as Q
    from tests.conftest import SF01
    monkeypatch.setattr(Q, "WHOLE", 0)
    df = spark.read.parquet(f"{SF01}/lineitem.parquet")
    got = _quantiles(df, ["l_extendedprice"], [("cont", 0.5)], sketches=[1e9, 2e9])
    assert got[("cont", "l_extendedprice", 0.5)] == pytest.approx(_duck_quantile("cont", "l_extendedprice", 0.5), rel=1e-12)


def test_grouped_quantiles(spark, monkeypatch):
    from featurespark.operators import quantiles as Q
    from tests.conftest import SF01
    monkeypatch.setattr(Q, "WHOLE", 3000)       # some groups with brackets, some without
    df = spark.read.parquet(f"{SF01}/lineitem.parquet").where("l_quantity < 30 or l_quantity = 33")
    got = Q.grouped_quantiles(df, ["l_returnflag", "l_linenumber"], "l_extendedprice", [("cont", 0.25), ("disc", 0.9)]).collect()
    assert len(got) > 10
    for r in got[:12]:
        where = f"WHERE (l_quantity < 30 or l_quantity = 33) AND l_returnflag = '{r['l_returnflag']}' AND l_linenumber = {r['l_linenumber']}"
        assert r["q0"] == pytest.approx(_duck_quantile("cont", "l_extendedprice", 0.25, where), rel=1e-12)
        assert r["q1"] == pytest.approx(_duck_quantile("disc", "l_extendedprice", 0.9, where), rel=1e-12)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan") if i % 3 == 0 else float(i),) for i in range(90)], "x double")
    clean = df.where("not isnan(x)")
    a, b = P.univariate_numeric(df, ["x"]).first(), P.univariate_numeric(clean, ["x"]).first()
    assert a == b and P.missing_report(df).first()["missing_count"] == 30
    assert [tuple(r) for r in P.histogram(df, ["x"]).orderBy("bin").collect()] == [tuple(r) for r in P.histogram(clean, ["x"]).orderBy("bin").collect()]
    from featurespark.operators.transforms import apply_transforms
    filled = apply_transforms(df, [{"column_name": "x", "fe_method": "impute_median"}], include_original=False).df
    assert filled.where("isnan(x_imputed) or x_imputed is null").count() == 0


def test_suggest_target_rules(spark):
    df = spark.createDataFrame([(i, i % 3, "x" if i % 2 else "y", i % 2) for i in range(50)],
                               "customer_id long, segment int, city string, churn int")
    ranked = [r["column_name"] for r in P.suggest_target(df).orderBy("rank").collect()]
    assert ranked[0] == "churn" and ranked[-1] == "customer_id"


def test_profile_finds_its_target(spark):
    df = spark.createDataFrame([(i, i * 1.5, "x" if i % 2 else "y", i % 2) for i in range(50)], "id long, v double, city string, churn int")
    rep = P.profile(df)
    assert any(k.startswith("correlation") or "target" in k for k in rep) or "chi2" in rep
    assert set(P.profile(df, find_target=False)) < set(rep)


def test_density_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(20)], "c double, x double")
    got = P.density(df, ["c", "x"]).collect()
    assert [(r["point"], r["x"], r["density"]) for r in got if r["column_name"] == "c"] == [(0, 1.0, None)]
    assert len([r for r in got if r["column_name"] == "x" and r["density"] > 0]) == 30


def test_profile_sections_equal_standalone_operators(spark):
    from tests.conftest import SF01
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    rep = P.profile(o, target="o_orderstatus")
    def rows(d):
        return sorted(map(tuple, d.collect()))
    assert rows(rep["missing_values"]) == rows(P.missing_report(o))
    assert rows(rep["cardinality"]) == rows(P.cardinality(o))
    assert rows(rep["outliers"]) == rows(P.iqr_outliers(o))
    assert rows(rep["histogram"]) == rows(P.histogram(o))
    assert rows(rep["feature_types"]) == rows(P.feature_types(o))
