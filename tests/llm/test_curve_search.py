"""Neighbour search against brute force."""
import numpy as np
from pyspark.sql import functions as F

from featurespark.llm import curve_search

SCHEMA = "vec_id long, embedding array<float>, label int"


def is_query():
    return F.col("vec_id") % 20 == 0


def brute(rows, k=10):
    """{query id: [(distance, id)]} over the rows that take part."""
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        out[int(ids[i])] = sorted((float(d[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[i])[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({i for _, i in got.get(q, [])} & {i for _, i in near}) / max(len(near), 1) for q, near in want.items()])


def test_recall_of_registered_query(spark):
    from featurespark.llm import queries
    got = found(queries.op11_curve_neighbours(spark, "/root/testdata/sf0.1"))
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    want = {q: near for q, near in brute([(r["vec_id"], np.array(r["embedding"], np.float32)) for r in table]).items() if q % 100 == 0}
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_narrow_windows_widen_until_the_sample_is_found(spark, monkeypatch):
    """Clustered vectors in blocks of 32: windows start at a hundredth of the curve."""
    monkeypatch.setattr(curve_search, "BLOCK", 32)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    v = (centres[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 24))).astype(np.float32)
    rows = list(enumerate(v.tolist()))
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)
    got, want = found(curve_search.nearest(df, is_query())), brute([(i, np.array(x, np.float32)) for i, x in rows])
    assert recall(got, want) >= 0.9
    assert all(abs(d - dict((i, s) for s, i in want[q])[i]) < 1e-9 for q, near in got.items() for d, i in near if i in dict((i, s) for s, i in want[q]))


def test_copies_ties_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 5)).astype(np.float32)
    v[100:220] = v[0]                                  # a hot vector: ids of its copies decide
    v[230] = -v[231]
    rows = [(i, x) for i, x in enumerate(v.tolist())]
    odd = [(400, None), (420, [0.0] * 5), (440, [1.0, None, 0.0, 0.0, 0.0]), (460, [float("nan")] + [1.0] * 4), (480, [float("inf")] + [1.0] * 4),
           (500, [1.0, 2.0]), (520, []), (None, [1.0] * 5)]
    again = rows[40:60]                                # repeated rows are one
    df = spark.createDataFrame([(i, x, 0) for i, x in rows + odd + again], SCHEMA)
    for name in ("query", "rep", "block", "score", "rank", "v", "digest", "ids"):
        df = df.withColumn(name, F.lit("x"))
    got, want = found(curve_search.nearest(df.repartition(5), is_query())), brute([(i, np.array(x, np.float32)) for i, x in rows])
    assert set(got) == set(want)                       # few rows: the windows hold the whole curve
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], atol=1e-12)


def test_few_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert curve_search.nearest(none, is_query()).collect() == []
    one = spark.createDataFrame([(20, [1.0, 2.0], 0)], SCHEMA)
    assert curve_search.nearest(one, is_query()).collect() == []
    two = spark.createDataFrame([(20, [1.0, 2.0], 0), (21, [1.0, 5.0], 0)], SCHEMA)
    assert [tuple(r) for r in curve_search.nearest(two, is_query()).collect()] == [(20, 1, 21, 3.0)]


def test_hilbert_neighbours_differ_in_one_step():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = cells[np.argsort(curve_search.hilbert(cells, 3))]
    assert sorted(curve_search.hilbert(cells, 3).tolist()) == list(range(side ** 3))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
