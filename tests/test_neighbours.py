"""Neighbour search of the oversampler against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from featurespark.operators import neighbours
from featurespark.operators.smoter import smoter


def brute(z, k):
    apart = np.zeros((len(z), len(z)))
    for f in range(z.shape[1]):
        d = z[:, f, None] - z[None, :, f]
        apart += d * d
    np.fill_diagonal(apart, np.inf)
    return [sorted(range(len(z)), key=lambda j: (apart[i, j], j))[:k] for i in range(len(z))]


def frame(spark, groups):
    rows = [(g, i, [float(x) for x in v]) for g, z in groups.items() for i, v in enumerate(z)]
    return spark.createDataFrame(rows, "grp string, id long, z array<double>").repartition(6)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["grp"], r["id"], r["m"])):
        out.setdefault((r["grp"], r["id"]), []).append(r["other"])
    return out


@pytest.mark.parametrize("features", [2, 5, 10, 20])
def test_recall_of_uniform_points(spark, features):
    z = np.random.default_rng(features).random((4000, features))
    got, want = found(neighbours.nearest(frame(spark, {"a": z}), 5)), brute(z, 5)
    assert len(got) == len(z) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[("a", i)]) & set(w)) / 5 for i, w in enumerate(want)]) >= 0.9


@pytest.mark.parametrize("features", [1, 3, 12])
def test_exact_search(spark, features, monkeypatch):
    """Two groups, small pieces, grid points with ties and copies."""
    monkeypatch.setattr(neighbours, "PIECE_ROWS", 40)
    rng = np.random.default_rng(features)
    groups = {"low": np.round(rng.random((900, features)) * 6) / 6, "high": rng.random((400, features))}
    got = found(neighbours.nearest(frame(spark, groups), 4, exact=True))
    for g, z in groups.items():
        assert [got[(g, i)] for i in range(len(z))] == brute(z, 4)


def test_a_hot_vector_is_searched_once(spark):
    """A third of all rows share a vector: no cell holds them, and each still has its neighbours."""
    rng = np.random.default_rng(1)
    z = rng.random((3000, 4))
    z[:1000] = z[0]
    vectors = neighbours.distinct_vectors(frame(spark, {"a": z}), 6)
    assert vectors.count() == 2001 and vectors.agg(F.max(F.size("ids"))).first()[0] == 6
    got = found(neighbours.nearest(frame(spark, {"a": z}), 5, exact=True))
    assert [got[("a", i)] for i in range(len(z))] == brute(z, 5)


def test_tiny_groups(spark):
    groups = {"one": np.zeros((1, 2)), "two": np.array([[0.0, 0.0], [1.0, 1.0]])}
    assert found(neighbours.nearest(frame(spark, groups), 3)) == {("two", 0): [1], ("two", 1): [0]}
    assert neighbours.nearest(frame(spark, {}), 3).collect() == []


def test_synthetic_rows_have_no_key_and_names_do_not_matter(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    events = events.select("event_id", "user_id", F.col("user_id").alias("pos"), F.lit("x").alias("grp"), F.lit(1.0).alias("z"), F.lit(2).alias("row"), "value")
    out, info = smoter(events, "value", order_key="event_id")
    made = out.where("event_id is null")
    assert made.count() == sum(info["synthetic"].values()) > 0
    assert out.columns == events.columns and out.where("event_id is not null").count() == events.count()
    assert made.where("pos <> user_id or grp <> 'x' or z <> 1 or row <> 2").count() == 0


@pytest.mark.parametrize("features", [1, 3])
def test_exact_search_over_many_cells(spark, features, monkeypatch):
    """Small cells, cut from a small sample and into pieces: ties, copies and a group of one row."""
    for name, value in {"CELL_ROWS": 40, "CELL_SAMPLE": 4, "PIECE_ROWS": 25}.items():
        monkeypatch.setattr(neighbours, name, value, raising=False)
    rng = np.random.default_rng(features)
    groups = {"low": np.round(rng.random((500, features)) * 6) / 6, "high": rng.normal(size=(400, features)) ** 3, "one": rng.random((1, features))}
    got = found(neighbours.nearest(frame(spark, groups), 4, exact=True))
    for g, z in groups.items():
        assert [got.get((g, i), []) for i in range(len(z))] == (brute(z, 4) if len(z) > 1 else [[]])


def test_an_exact_search_meets_few_cells(spark, monkeypatch):
    """A vector is compared with its own cell, and only those near a border with others."""
    asked, met = [], neighbours._met
    monkeypatch.setattr(neighbours, "_met", lambda dealt, asking, k: asked.append(asking.count()) or met(dealt, asking, k))
    z = np.random.default_rng(0).random((10_000, 2))
    got = found(neighbours.nearest(frame(spark, {"a": z}), 5, exact=True))
    assert 0 < sum(asked) < len(z)
    for i in range(0, len(z), 100):
        apart = ((z - z[i]) ** 2).sum(1)
        assert got[("a", i)] == np.argsort(apart)[1:6].tolist()
