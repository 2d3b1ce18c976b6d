"""k nearest neighbours inside groups, by cells of bounded size.

The approximate search deals distinct vectors to the cell of their nearest pivot (a bounded
sample of the group's own vectors). A vector meets the cells nearest to it. How many cells that
takes is measured: the number doubles until a sample held against brute force has the wanted
recall. The exact search deals them to the cells of a k-d tree, whose number grows with the
group. A vector meets its own cell, and then every cell whose box is as near as the k-th
neighbour found there, so nothing can be missed. A large cell is split into pieces, so no task
holds more than a piece. Copies of a vector are one vector with a bounded list of ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reach, stage

#: pivots of a group: the square root of its size, at most so many (they go to every task)
MAX_PIVOTS = 8192
#: distinct vectors of a cell of the k-d tree, those of them in the tree's sample, and all in the
#: sample of a group (it goes to the driver, the tree to every task); cells grow only beyond it
CELL_ROWS, CELL_SAMPLE, MAX_SAMPLE = 1000, 8, 400_000
#: distinct vectors that one task holds of a cell
PIECE_ROWS = 20_000
#: cells that the first round meets
PROBES = 4
#: recall that the sample must reach, and the vectors in it
RECALL, SAMPLE = 0.95, 256
#: copies of the answer of a vector that many rows share
SALTS = 16
#: distances that are held at a time in a task
AT_ONCE = 2_000_000


def matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, added up feature by feature (the order of a SQL sum)."""
    out = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        d = a[:, f, None] - b[None, :, f]
        out += d * d
    return out


def nearest_rows(apart: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` smallest finite entries of each row, ties to the smaller name."""
    k = min(k, apart.shape[1])
    if not k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bound = np.partition(apart, k - 1, 1)[:, k - 1]
    row, col = np.nonzero((apart <= bound[:, None]) & np.isfinite(apart))
    order = np.lexsort((names[col], apart[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def distinct_vectors(points: DataFrame, most: int) -> DataFrame:
    """(grp, rep, z, copies, ids) of the distinct vectors: the number of rows that have one and
    the ``most`` smallest ids, the first of which names it."""
    by = Window.partitionBy("grp", "z").orderBy("id")
    smallest = points.withColumn("at", F.row_number().over(by)).where(F.col("at") <= most)
    ids = smallest.groupBy("grp", "z").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    copies = points.groupBy("grp", "z").agg(F.count(F.lit(1)).alias("copies"))
    return stage(ids.join(copies, ["grp", "z"]).select("grp", F.col("ids")[0].alias("rep"), "z", "copies", "ids"), "neighbour-vectors")


class _Cells:
    """Pivots and pieces of each group's cells: a few thousand rows, known to all tasks."""

    def __init__(self, vectors: DataFrame):
        sizes = {r["grp"]: r["n"] for r in vectors.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.pivots = {}
        for grp, n in sizes.items():
            most = min(MAX_PIVOTS, math.ceil(n ** 0.5))
            rows = vectors.where(F.col("grp") == F.lit(grp)).orderBy(F.xxhash64("rep"), "rep").limit(most).select("z").collect()
            self.pivots[grp] = np.array([r["z"] for r in rows])
        self.count = {grp: len(p) for grp, p in self.pivots.items()}
        self.held = {grp: np.zeros(len(p), np.int64) for grp, p in self.pivots.items()}
        self.most = max((len(p) for p in self.pivots.values()), default=0)

    def gaps(self, grp: str, z: np.ndarray) -> np.ndarray:
        return np.sqrt(squares(z, self.pivots[grp]))


class _Tree:
    """The k-d tree of a group: cut from a sample of its vectors, every node with the box of all
    vectors below it, and every cell with the number of its pieces."""

    def __init__(self, sample: np.ndarray):
        self.feature, self.cut, self.child, self.cell = [], [], [], []
        self.cells = 0
        self._grow(sample[np.isfinite(sample).all(1)])
        self.feature, self.cut, self.child, self.cell = map(np.array, (self.feature, self.cut, self.child, self.cell))

    def _grow(self, z: np.ndarray) -> int:
        """Halves ``z`` at the median of its widest feature; the node's number, below its children's."""
        node = len(self.feature)
        self.feature.append(-1), self.cut.append(0.0), self.child.append((node, node)), self.cell.append(-1)
        wide = np.ptp(z, 0) if len(z) > CELL_SAMPLE else np.zeros(1)
        if wide.max() > 0:
            at = int(wide.argmax())
            values = np.sort(z[:, at])
            cut = values[(len(values) - 1) // 2]
            cut = cut if cut < values[-1] else values[values < cut][-1]
            self.feature[node], self.cut[node] = at, cut
            self.child[node] = self._grow(z[z[:, at] <= cut]), self._grow(z[z[:, at] > cut])
        else:
            self.cell[node] = self.cells
            self.cells += 1
        return node

    def fill(self, low: np.ndarray, high: np.ndarray, held: np.ndarray) -> None:
        """Takes the boxes and row counts of the cells; a cell without rows has ``low`` = inf."""
        self.pieces = np.ceil(held / PIECE_ROWS).astype(np.int64)
        self.low, self.high = low[self.cell], high[self.cell]
        for node in np.flatnonzero(self.feature >= 0)[::-1]:
            one, two = self.child[node]
            self.low[node], self.high[node] = np.minimum(self.low[one], self.low[two]), np.maximum(self.high[one], self.high[two])

    def cell_of(self, z: np.ndarray) -> np.ndarray:
        node = np.zeros(len(z), np.int64)
        while (inner := np.flatnonzero(self.feature[node] >= 0)).size:
            at = node[inner]
            node[inner] = self.child[at, (z[inner, self.feature[at]] > self.cut[at]).astype(np.int64)]
        return self.cell[node]

    def near(self, z: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells whose box is within the squared distance ``limit`` of each row."""
        row, node, out = np.arange(len(z)), np.zeros(len(z), np.int64), []
        while len(row):
            apart = np.zeros(len(row))
            for f in range(z.shape[1]):         # rounded like the distances of vectors, so never above them
                d = np.maximum(np.maximum(self.low[node, f] - z[row, f], z[row, f] - self.high[node, f]), 0)
                apart += d * d
            close = apart <= limit[row]
            row, node = row[close], node[close]
            ends = self.feature[node] < 0
            out.append((row[ends], self.cell[node[ends]]))
            row, node = np.repeat(row[~ends], 2), self.child[node[~ends]].ravel()
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def _chunks(batches, cells: dict):
    """(group, rows of it) of Arrow batches, as many rows at a time as the group's number of
    ``cells`` allows."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        grp = np.array(table.column("grp").to_pylist(), object)
        for g in set(grp):
            mine, most = np.flatnonzero(grp == g), max(1, AT_ONCE // cells[g])
            for i in range(0, len(mine), most):
                yield g, table.take(pa.array(mine[i:i + most]))


def _dealt(vectors: DataFrame, cells: _Cells) -> DataFrame:
    """(grp, cell, piece, rep, z); fills in the rows of the cells."""

    def assign(batches):
        for g, rows in _chunks(batches, cells.count):
            gap = cells.gaps(g, matrix(rows.column("z")))
            yield from rows.append_column("cell", pa.array(gap.argmin(1).astype(np.int32))).to_batches()

    at = stage(vectors.select("grp", "rep", "z").mapInArrow(assign, "grp string, rep long, z array<double>, cell int"), "neighbour-cells")
    for r in at.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n")).collect():
        cells.held[r["grp"]][r["cell"]] = r["n"]
    return _cut(at, _pieces(vectors.sparkSession, cells))


def _cut(at: DataFrame, pieces: DataFrame) -> DataFrame:
    return at.join(F.broadcast(pieces), ["grp", "cell"]).select("grp", "cell", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int").alias("piece"), "rep", "z")


def _pieces(spark, cells: _Cells) -> DataFrame:
    rows = [(g, i, max(1, math.ceil(int(n) / PIECE_ROWS))) for g, held in cells.held.items() for i, n in enumerate(held)]
    return spark.createDataFrame(rows, "grp string, cell int, pieces int")


def _asking(vectors: DataFrame, cells: _Cells, first: int, last: int) -> DataFrame:
    """(grp, cell, piece, rep, z): each vector at the pieces it meets, the cells of rank ``first``
    to ``last`` by distance."""

    def probe(batches):
        for g, rows in _chunks(batches, cells.count):
            gap = cells.gaps(g, matrix(rows.column("z")))
            rank = np.empty(gap.shape, np.int64)
            np.put_along_axis(rank, np.argsort(gap, 1, kind="stable"), np.arange(gap.shape[1])[None], 1)
            row, cell = np.nonzero((rank >= first) & (rank < last))
            yield from rows.select(["grp", "rep", "z"]).take(pa.array(row)).append_column("cell", pa.array(cell.astype(np.int32))).to_batches(max_chunksize=50_000)

    met = vectors.mapInArrow(probe, "grp string, rep long, z array<double>, cell int")
    pieces = F.broadcast(_pieces(vectors.sparkSession, cells))
    return met.join(pieces, ["grp", "cell"]).select("grp", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "rep", "z")


def _met(dealt: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """(grp, rep, other, apart): the ``k`` nearest of every piece that a vector meets, those
    within its ``limit`` if it has one."""
    schema = pa.schema([("grp", pa.string()), ("rep", pa.int64()), ("other", pa.int64()), ("apart", pa.float64())])

    def meet(here: pa.Table, there: pa.Table) -> pa.Table:
        if not here.num_rows or not there.num_rows:
            return schema.empty_table()
        names, asked = here.column("rep").to_numpy(), there.column("rep").to_numpy()
        a, b, out = matrix(there.column("z")), matrix(here.column("z")), []
        step = max(1, AT_ONCE // len(b))
        for i in range(0, len(a), step):
            apart = squares(a[i:i + step], b)
            apart[asked[i:i + step, None] == names[None]] = np.inf
            if "limit" in there.column_names:
                apart[apart > there.column("limit").to_numpy()[i:i + step, None]] = np.inf
            row, col = nearest_rows(apart, names, k)
            out.append((asked[i + row], names[col], apart[row, col]))
        rep, other, apart = (np.concatenate(x) for x in zip(*out))
        return pa.Table.from_arrays([pa.array([there.column("grp")[0].as_py()] * len(rep), pa.string()), pa.array(rep), pa.array(other), pa.array(apart)], schema=schema)

    by = ("grp", "cell", "piece")
    return dealt.groupBy(*by).cogroup(asking.groupBy(*by)).applyInArrow(meet, "grp string, rep long, other long, apart double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("grp", "rep").orderBy("apart", "other"))
    return found.withColumn("m", rank).where(F.col("m") <= k)


def _trees(vectors: DataFrame) -> tuple[dict[str, _Tree], DataFrame]:
    """The tree of each group, and (grp, cell, piece, rep, z) of its vectors."""
    trees, features = {}, 1
    for r in vectors.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("z")).alias("features")).collect():
        most, features = min(MAX_SAMPLE, math.ceil(r["n"] / CELL_ROWS) * CELL_SAMPLE), r["features"]
        share = F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(1 << 30)) < math.ceil(most / r["n"] * (1 << 30))
        trees[r["grp"]] = _Tree(matrix(vectors.where((F.col("grp") == F.lit(r["grp"])) & share).select("z").toArrow().column("z")).reshape(-1, features))
    count = {g: t.cells for g, t in trees.items()}

    def assign(batches):
        for g, rows in _chunks(batches, count):
            yield from rows.append_column("cell", pa.array(trees[g].cell_of(matrix(rows.column("z"))).astype(np.int32))).to_batches()

    at = stage(vectors.select("grp", "rep", "z").mapInArrow(assign, "grp string, rep long, z array<double>, cell int"), "neighbour-cells")
    real = [F.when(~F.isnan(F.col("z")[f]), F.col("z")[f]) for f in range(features)]
    boxes = at.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n"), *[F.min(x) for x in real], *[F.max(x) for x in real]).toArrow().to_pandas()
    for g, tree in trees.items():
        mine = boxes[boxes["grp"] == g]
        low, high, held = np.full((tree.cells, features), np.inf), np.full((tree.cells, features), -np.inf), np.zeros(tree.cells)
        here, ends = mine["cell"].to_numpy(), mine.iloc[:, 3:].to_numpy(np.float64)
        low[here], high[here], held[here] = np.nan_to_num(ends[:, :features], nan=np.inf), np.nan_to_num(ends[:, features:], nan=-np.inf), mine["n"]
        tree.fill(low, high, held)
    pieces = [(g, i, int(n)) for g, t in trees.items() for i, n in enumerate(t.pieces) if n]
    return trees, stage(_cut(at, vectors.sparkSession.createDataFrame(pieces, "grp string, cell int, pieces int")), "neighbour-pieces")


def _exact(vectors: DataFrame, k: int) -> DataFrame:
    """(grp, rep, other, apart): the ``k`` nearest of each vector."""
    trees, dealt = _trees(vectors)
    count = {g: t.cells for g, t in trees.items()}
    pairs = "array<struct<apart:double,other:long>>"

    def own(here: pa.Table) -> pa.Table:
        names, z, out = here.column("rep").to_numpy(), matrix(here.column("z")), []
        step = max(1, AT_ONCE // len(z))
        for i in range(0, len(z), step):
            apart = squares(z[i:i + step], z)
            apart[np.arange(len(apart)), i + np.arange(len(apart))] = np.inf
            row, col = nearest_rows(apart, names, k)
            out.append((i + row, names[col], apart[row, col]))
        row, other, apart = (np.concatenate(x) for x in zip(*out))
        ends = np.searchsorted(row, np.arange(len(z) + 1))
        near = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(apart), pa.array(other)], ["apart", "other"]))
        limit, full = np.full(len(z), np.inf), np.diff(ends) == k
        limit[full] = apart[ends[1:][full] - 1]
        return here.append_column("near", near).append_column("limit", pa.array(limit))

    def beyond(batches):
        for g, rows in _chunks(batches, count):
            row, cell = trees[g].near(matrix(rows.column("z")), rows.column("limit").to_numpy())
            pieces = trees[g].pieces[cell]
            piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            row, cell = np.repeat(row, pieces), np.repeat(cell, pieces)
            other = (cell != rows.column("cell").to_numpy()[row]) | (piece != rows.column("piece").to_numpy()[row])
            yield from rows.select(["grp", "rep", "z", "limit"]).take(pa.array(row[other])).append_column("cell", pa.array(cell[other].astype(np.int32))).append_column(
                "piece", pa.array(piece[other].astype(np.int32))).to_batches(max_chunksize=50_000)

    by = ("grp", "cell", "piece")
    near = stage(dealt.groupBy(*by).applyInArrow(own, f"grp string, cell int, piece int, rep long, z array<double>, near {pairs}, limit double"), "neighbour-near")
    asking = near.select(*by, "rep", "z", "limit").mapInArrow(beyond, "grp string, rep long, z array<double>, limit double, cell int, piece int")
    more = _best(_met(dealt, asking, k), k).groupBy("grp", "rep").agg(F.collect_list(F.struct("apart", "other")).alias("more"))
    all_ = F.array_sort(F.concat("near", F.coalesce("more", F.array().cast(pairs))))
    return near.select("grp", "rep", "near").join(more, ["grp", "rep"], "left").select("grp", "rep", F.explode(F.slice(all_, 1, k)).alias("one")).select(
        "grp", "rep", "one.other", "one.apart")


def _sampled(vectors: DataFrame, k: int, sample: int) -> dict:
    """{(grp, rep): exact neighbours} of a sample, by one pass over all vectors."""
    some = vectors.orderBy(F.xxhash64("rep", F.lit(1)), "grp", "rep").limit(sample).select("grp", "rep", "z").collect()
    asked: dict[str, tuple] = {g: ([], []) for g in {r["grp"] for r in some}}
    for r in some:
        asked[r["grp"]][0].append(r["rep"])
        asked[r["grp"]][1].append(r["z"])

    def scan(batches):
        for batch in batches:
            grp = np.array(batch.column("grp").to_pylist(), object)
            for g, (reps, z) in asked.items():
                mine = np.flatnonzero(grp == g)
                names, reps = batch.column("rep").to_numpy()[mine], np.array(reps)
                apart = squares(np.array(z), matrix(batch.column("z"))[mine])
                apart[reps[:, None] == names[None]] = np.inf
                row, col = nearest_rows(apart, names, k)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(row), pa.string()), pa.array(reps[row]), pa.array(names[col]), pa.array(apart[row, col])],
                                                 ["grp", "rep", "other", "apart"])

    out: dict[tuple, set] = {}
    for r in _best(vectors.select("grp", "rep", "z").mapInArrow(scan, "grp string, rep long, other long, apart double"), k).collect():
        out.setdefault((r["grp"], r["rep"]), set()).add(r["other"])
    return out


def nearest(points: DataFrame, k: int, exact: bool = False, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(grp, id, m, other, apart): the ``k`` nearest other rows of each row of its group, by squared
    Euclidean distance, ties to the smaller id; ``m`` counts from 1.

    ``points`` has grp (string), id (long, unique in its group) and z (array of doubles, one
    length, no nulls or NaN). ``exact`` finds the true neighbours; else at least the share
    ``recall`` of those of a sample of ``sample`` vectors is found, and about as many of the rest.
    A group of one row has no neighbours.
    """
    spark = points.sparkSession
    reach(spark)
    vectors = distinct_vectors(points.select("grp", "id", "z"), k + 1)
    if exact:
        return _expanded(points, vectors, _exact(vectors, k), k)
    cells = _Cells(vectors)
    dealt = stage(_dealt(vectors, cells), "neighbour-pieces")
    ask = vectors.select("grp", "rep", "z")
    best = stage(_best(_met(dealt, _asking(ask, cells, 0, PROBES), k), k), "neighbour-best")
    if cells.most > PROBES:
        true, probes = _sampled(vectors, k, sample), PROBES
        wanted = sum(map(len, true.values()))
        keys = spark.createDataFrame(list(true) or [("", 0)], "grp string, rep long")
        while probes < cells.most:
            got = best.join(F.broadcast(keys), ["grp", "rep"]).select("grp", "rep", "other").collect()     # at most k rows for each of the sample
            if sum(r["other"] in true.get((r["grp"], r["rep"]), ()) for r in got) >= recall * wanted:
                break
            more = _met(dealt, _asking(ask, cells, probes, 2 * probes), k)
            best, probes = stage(_best(best.drop("m").unionByName(more), k), "neighbour-best"), 2 * probes
    return _expanded(points, vectors, best, k)


def _expanded(points: DataFrame, vectors: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """From distinct vectors to rows: copies of a row are its nearest, by id."""
    own = vectors.select("grp", "rep", F.col("rep").alias("other"), F.lit(0.0).alias("apart"))
    ids = vectors.select("grp", F.col("rep").alias("other"), "ids")
    rows = best.select("grp", "rep", "other", "apart").unionByName(own).join(ids, ["grp", "other"]).select("grp", "rep", "apart", F.explode("ids").alias("id"))
    rank = F.row_number().over(Window.partitionBy("grp", "rep").orderBy("apart", "id"))
    near = rows.withColumn("at", rank).where(F.col("at") <= k + 1).groupBy("grp", "rep").agg(F.sort_array(F.collect_list(F.struct("apart", "id"))).alias("near"))
    told = stage(vectors.join(near, ["grp", "rep"]), "neighbour-lists")
    few = told.where(F.col("copies") <= k + 1).select("grp", F.explode("ids").alias("id"), "near")
    many = told.where(F.col("copies") > k + 1).select("grp", "z", "near", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = points.select("grp", "id", "z", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    each = few.unionByName(salted.join(many, ["grp", "z", "salt"]).select("grp", "id", "near"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return each.select("grp", "id", F.posexplode(others).alias("at", "one")).select(
        "grp", "id", (F.col("at") + 1).alias("m"), F.col("one.id").alias("other"), F.col("one.apart").alias("apart"))
