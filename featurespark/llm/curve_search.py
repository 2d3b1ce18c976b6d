"""Nearest neighbours by shifted space-filling curves.

Equal vectors are one representative. ORDERINGS random projections to DIMENSIONS axes, each with
a shift of its own, put the representatives on Hilbert curves. Every ordering is dealt by range
and cut into blocks of BLOCK consecutive keys; a query meets the blocks around its own, the
windows of all orderings merge, and the best by one-byte sketches are ranked again by the
original vectors. Windows double until a bounded sample of queries, held against brute force,
has the wanted recall, so the work follows the data's geometry and not a fixed guess.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from featurespark.llm.ranks import numbered
from featurespark.llm.shared import stage

NEIGHBOURS = 10
ORDERINGS, DIMENSIONS, BITS, BLOCK = 16, 8, 7, 1024
#: candidates of a query that are ranked by their original vectors
RERANK = 48
#: recall that the sample must reach, and the queries in it
RECALL, SAMPLE = 0.94, 128
#: copies of a query's answer, so that many rows with one vector do not meet in a task
SALTS = 16


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each cell (a row of coordinates below 2**bits) on the Hilbert curve, after
    Skilling's transform of coordinates into the transposed index."""
    x, top = cells.astype(np.int64).T.copy(), 1 << (bits - 1)
    axes = len(x)
    q = top
    while q > 1:
        low = q - 1
        for i in range(axes):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.int64), top
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


class Projections:
    """Random axes of each ordering and its shift: fixed by the number of components."""

    def __init__(self, components: int, orderings: int = ORDERINGS, dimensions: int = DIMENSIONS):
        rng = np.random.default_rng(components)
        self.dimensions = min(dimensions, components)
        self.axes = np.concatenate([np.linalg.qr(rng.normal(size=(components, self.dimensions)))[0] for _ in range(orderings)], 1)
        self.shift = rng.random(self.axes.shape[1])
        self.middle, self.spread = np.zeros(self.axes.shape[1]), np.ones(self.axes.shape[1])

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """A row of keys for each ordering."""
        z = (vectors @ self.axes - self.middle) / self.spread
        # a smooth squeeze spreads a bell-shaped axis evenly; half of each axis is room for the shift
        cells = ((1 / (1 + np.exp(-1.702 * np.clip(z, -30, 30))) + self.shift) / 2 * (1 << BITS)).astype(np.int64)
        cells = np.clip(cells, 0, (1 << BITS) - 1)
        return np.stack([hilbert(cells[:, i:i + self.dimensions]) for i in range(0, cells.shape[1], self.dimensions)])


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _digests(column: pd.Series) -> pd.Series:
    return pd.Series([hashlib.blake2b((np.asarray(v, np.float64) + 0.0).tobytes(), digest_size=16).digest() for v in column])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector that is not zero, without null or non-finite
    components, of the table's most frequent length (the larger on ties)."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return rows.where(F.size("v") == (lengths["size"] if lengths else 0))


def representatives(rows: DataFrame, is_query: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(rep, v, ids, asked), the distinct vectors with the ``most`` smallest ids that have them,
    and (vec_id, rep) of the queries. A representative is named by its smallest id."""
    digest = F.pandas_udf(_digests, T.BinaryType())
    keyed = stage(rows.withColumn("digest", digest("v")), "curve-vectors")
    ids = keyed.select("digest", "vec_id").distinct()
    smallest = ids.withColumn("rank", F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))).where(F.col("rank") <= most)
    held = smallest.groupBy("digest").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0])
    queries = keyed.where(is_query).select("vec_id", "digest").distinct()
    asked = queries.select("digest").distinct().withColumn("asked", F.lit(True))
    vectors = keyed.groupBy("digest").agg(F.first("v").alias("v"))
    reps = stage(held.join(vectors, "digest").join(asked, "digest", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "curve-reps")
    return reps, stage(queries.join(reps.where("asked").select("digest", "rep"), "digest").select("vec_id", "rep"), "curve-queries")


def _fitted(reps: DataFrame, components: int) -> Projections:
    """Projections scaled by the mean and spread of all representatives on each axis."""
    axes = Projections(components)

    def sums(batches):
        total = 0
        for batch in batches:
            y = _matrix(batch.column(0)) @ axes.axes
            total = total + np.concatenate([[[len(y)] * y.shape[1]], [y.sum(0)], [(y * y).sum(0)]])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1])), *[pa.array(t, pa.float64()) for t in total]], ["axis", "n", "s", "ss"])

    told = reps.select("v").mapInArrow(sums, "axis long, n double, s double, ss double").groupBy("axis").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    for r in told.collect():                     # one row for each axis
        axes.middle[r["axis"]] = r["s"] / r["n"]
        axes.spread[r["axis"]] = max(r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2, 0) ** 0.5 or 1.0
    return axes


def ordered(reps: DataFrame, axes: Projections) -> DataFrame:
    """(ordering, block, rep, asked, sketch, scale): the index, a row for each representative and
    ordering; a sketch has a byte for each component, in units of ``scale``."""
    def place(batches):
        for batch in batches:
            v = _matrix(batch.column(2))
            keys = axes.keys(v)
            scale = np.abs(v).max(1) / 127
            sketch = pa.array([row.tobytes() for row in np.round(v / scale[:, None]).astype(np.int8)], pa.binary())
            for ordering, key in enumerate(keys):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), ordering, np.int32)), pa.array(key), batch.column(0), batch.column(1), sketch, pa.array(scale)],
                                                 ["ordering", "key", "rep", "asked", "sketch", "scale"])

    rows = reps.select("rep", "asked", "v").mapInArrow(place, "ordering int, key long, rep long, asked boolean, sketch binary, scale double")
    rows = numbered(rows, "ordering", [F.col("key"), F.col("rep")], "curve-order")
    return stage(rows.select("ordering", F.floor(F.col("idx") / BLOCK).alias("block"), "rep", "asked", "sketch", "scale", "n"), "curve-index")


def _search(index: DataFrame, inner: int, outer: int, keep: int) -> DataFrame:
    """(query, rep, apart): candidates of each query representative in the blocks more than
    ``inner`` and at most ``outer`` away from its own, the best ``keep`` of each block."""
    # a block's distance on either side; -1 stands for none yet, so its own block is included
    steps = [d for d in range(-outer, outer + 1) if abs(d) > inner]
    queries = index.where("asked").select("ordering", F.explode(F.lit(steps)).alias("step"), "block", "rep", "sketch", "scale", "n").withColumn("block", F.col("block") + F.col("step")).where(
        (F.col("block") >= 0) & (F.col("block") * BLOCK < F.col("n"))).drop("step", "n")

    def vectors(table: pa.Table) -> np.ndarray:
        whole = table.column("sketch").combine_chunks()
        raw = np.frombuffer(b"".join(whole.to_pylist()), np.int8).reshape(len(whole), -1)
        return raw.astype(np.float32) * table.column("scale").to_numpy()[:, None].astype(np.float32)

    def meet(block: pa.Table, asking: pa.Table) -> pa.Table:
        if not asking.num_rows or not block.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "apart": pa.array([], pa.float32())})
        here, there = vectors(block), vectors(asking)
        names, asked = block.column("rep").to_numpy(), asking.column("rep").to_numpy()
        size, found = (here * here).sum(1), []
        for i in range(0, len(there), 512):
            apart = size[None] - 2 * there[i:i + 512] @ here.T + (there[i:i + 512] ** 2).sum(1)[:, None]
            apart[asked[i:i + 512, None] == names[None]] = np.inf
            k = min(keep, apart.shape[1])
            best = np.argpartition(apart, k - 1, 1)[:, :k]
            found.append((np.repeat(asked[i:i + 512], k), names[best].ravel(), np.take_along_axis(apart, best, 1).ravel()))
        query, rep, apart = (np.concatenate(x) for x in zip(*found))
        real = np.isfinite(apart)
        return pa.table({"query": query[real], "rep": rep[real], "apart": apart[real].astype(np.float32)})

    by = ("ordering", "block")
    return index.select("ordering", "block", "rep", "sketch", "scale").groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(meet, "query long, rep long, apart float")


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nearest of each query by sketches, each candidate once."""
    once = found.groupBy("query", "rep").agg(F.min("apart").alias("apart"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("apart", "rep"))
    return once.withColumn("rank", rank).where(F.col("rank") <= keep).drop("rank")


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _answers(best: DataFrame, reps: DataFrame, most: int) -> DataFrame:
    """(query, near): the ``most`` nearest rows of each query representative as structs of
    distance and id, ties by id; its own copies are at distance 0."""
    candidates = best.select("query", "rep").unionByName(reps.where("asked").select(F.col("rep").alias("query"), "rep"))
    asked = reps.where("asked").select(F.col("rep").alias("query"), F.col("v").alias("a"))
    pairs = candidates.join(reps.select("rep", "v", "ids"), "rep").join(asked, "query")
    rows = pairs.select("query", _distance("a", "v").alias("score"), F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))


def _exact(reps: DataFrame, sample: list, most: int) -> dict:
    """The exact nearest distance of rank ``most`` of each sampled query, by one pass."""
    asked = np.array([r["rep"] for r in sample])
    wanted = np.array([r["v"] for r in sample])

    def scan(batches):
        for batch in batches:
            v, names = _matrix(batch.column(1)), batch.column(0).to_numpy()
            for q, w in zip(asked, wanted):
                apart = np.sqrt(((v - w) ** 2).sum(1))
                apart[names == q] = np.inf
                near = np.argsort(apart)[:most]
                near = near[np.isfinite(apart[near])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), q)), pa.array(names[near]), pa.array(apart[near])], ["query", "rep", "apart"])

    found = reps.select("rep", "v").mapInArrow(scan, "query long, rep long, apart double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("apart", "rep"))
    out: dict[int, set] = {}
    for r in found.withColumn("rank", rank).where(F.col("rank") <= most).collect():     # at most SAMPLE * most rows
        out.setdefault(r["query"], set()).add(r["rep"])
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding",
            recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows that the search finds for each
    row for which ``is_query`` (on ``vec_id``) holds, by Euclidean distance in double precision,
    ties to the smaller id.

    Rows whose id or vector is null, whose vector is zero, holds a null or non-finite component
    or is not of the table's most frequent length, take no part. Rows that repeat id and vector
    are one; an id with several vectors has each of them as a query and is never its own
    neighbour. Copies of a vector are searched once and are each other's nearest, by id. The
    sample, ``sample`` query vectors chosen by a hash of their id, only sets the windows' width:
    they double until ``recall`` of the sample's exact neighbours is found or the whole curve is
    in the window. An empty table gives no rows; other columns are not read.
    """
    rows = usable(vectors, id_col, vector_col)
    reps, queries = representatives(rows, is_query, k + 1)
    probe = reps.where("asked").orderBy(F.xxhash64("rep"), "rep").limit(sample).select("rep", "v").collect()
    if not probe:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = ordered(reps, _fitted(reps, len(probe[0]["v"])))
    exact = _exact(reps, probe, k)
    wanted, blocks = sum(map(len, exact.values())), -(-reps.count() // BLOCK)
    best, inner, outer = None, -1, 1
    while True:
        found = _search(index, inner, outer, RERANK)
        best = stage(_best(found if best is None else found.unionByName(best.select("query", "rep", "apart")), RERANK), "curve-best")
        got = best.where(F.col("query").isin(list(exact))).select("query", "rep").collect()     # at most SAMPLE * RERANK rows
        hits = sum(r["rep"] in exact[r["query"]] for r in got)
        if hits >= recall * wanted or outer >= blocks:
            break
        inner, outer = outer, 2 * outer
    answers = stage(_answers(best, reps, k + 1), "curve-answers").withColumn("salt", F.explode(F.lit(list(range(SALTS)))))
    asking = queries.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    own = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    return asking.join(answers, ["query", "salt"]).select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "near")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("near.vec_id").alias("vec_id"), F.col("near.score").alias("score"))
