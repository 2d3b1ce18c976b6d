"""Exact global ranks and NTILE without a single-partition window.

NTILE (:func:`global_ntile`) needs only the key tuples at the ends of its tiles. They are
selected by :mod:`.selection`, and a row's tile is then a comparison: nothing is sorted, shuffled
or written.  Only rows equal to a tuple that lies across two tiles are numbered.

Row numbers (:func:`global_row_number`) place every row: ``ORDER BY`` windows with no ``PARTITION BY`` put every row in one task.  Here the
rows are range-partitioned on the sort keys (Spark samples the cut points), sorted
inside their partition and written once to the shared folder with their place in it;
a row's global number is its place plus the rows of the partitions before its own.
Only the partition sizes travel, as a small table joined on the partition number, so
the plan has the same size for twenty or a hundred thousand partitions.

The sort keys must form a total order (append a unique tie-break column) so the
result is deterministic.  The tie-break also spreads a value that a third of the rows
share over many partitions; rows equal in every key are interchangeable and are
spread by a seeded random last key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_of, unused
from ..session import stage
from .selection import Selection

DEFAULT_ROWS_PER_BUCKET = 10_000_000
MIN_ROWS_PER_TASK = 1000


@dataclass(frozen=True)
class SortKey:
    name: str
    ascending: bool = True
    nulls_first: bool = True   # Spark's default for ascending order

    def order(self) -> Column:
        c = col_of(self.name)
        if self.ascending:
            return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()


def n_buckets_for(n_rows: int, rows_per_bucket: int, parallelism: int = 1) -> int:
    """Enough partitions to bound each one by ``rows_per_bucket``, and at least one per
    core for mid-size inputs."""
    by_size = math.ceil(n_rows / max(rows_per_bucket, 1))
    by_cores = min(parallelism, math.ceil(n_rows / MIN_ROWS_PER_TASK))
    return max(1, by_size, by_cores)


@dataclass(frozen=True)
class Placed:
    """Rows with their partition and 0-based place in it, and the rows before each partition."""

    rows: DataFrame
    before: DataFrame
    part: str
    place: str
    shift: str


def placed(df: DataFrame, keys: list[SortKey], n_rows: int, rows_per_bucket: int) -> Placed:
    spark = df.sparkSession
    any_, at, part, place, shift = (unused(df.columns, name) for name in ("any", "at", "part", "place", "before"))
    n = n_buckets_for(n_rows, rows_per_bucket, spark.sparkContext.defaultParallelism)
    order = [k.order() for k in keys] + [F.col(any_).asc()]
    cut = (df.withColumn(any_, F.rand(7)).repartitionByRange(n, *order).sortWithinPartitions(*order)
           .withColumn(at, F.monotonically_increasing_id()).drop(any_))
    # monotonically_increasing_id: partition number in the upper 31 bits, place in the lower 33
    rows = stage(cut, "ranked").select(*[col_of(c) for c in df.columns], F.shiftright(at, 33).cast("int").alias(part),
                                       F.col(at).bitwiseAND(F.lit((1 << 33) - 1)).alias(place))
    if n == 1:
        return Placed(rows, spark.createDataFrame([(0, 0)], f"{part} int, {shift} bigint"), part, place, shift)
    sizes, before, table = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect(), 0, []   # one row per partition
    for number, size in sorted((r[part], r["n"]) for r in sizes):
        table.append((number, before))
        before += size
    return Placed(rows, spark.createDataFrame(table, f"{part} int, {shift} bigint"), part, place, shift)


def global_row_number(df: DataFrame, keys: list[SortKey], n_rows: int | None = None,
                      out: str = "__rn", rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Add ``out`` = 1-based position of each row in the global order of ``keys``."""
    p = placed(df, keys, df.count() if n_rows is None else n_rows, rows_per_bucket)
    number = (F.col(p.shift) + F.col(p.place) + 1).cast("bigint").alias(out)
    return p.rows.join(F.broadcast(p.before), p.part).select(*[col_of(c) for c in df.columns], number)


def ntile_from_rank(rn: Column, n_rows: int, k: int) -> Column:
    """NTILE(k) of the row at 1-based global position rn among n_rows rows."""
    q, r = divmod(n_rows, k)
    big = r * (q + 1)
    first = F.floor((rn - 1) / F.lit(q + 1)) + 1
    if q == 0:
        return first.cast("bigint")
    second = F.floor((rn - 1 - F.lit(big)) / F.lit(q)) + F.lit(r + 1)
    return F.when(rn <= F.lit(big), first).otherwise(second).cast("bigint")


def tile_ends(n_rows: int, k: int) -> list[int]:
    """The last rank of every tile but the last one that has rows."""
    q, r = divmod(n_rows, k)
    ends = [i * q + min(i, r) for i in range(1, k)]
    return sorted({e for e in ends if 0 < e < n_rows})


def global_ntile(df: DataFrame, column: str, k: int, order_key: str | None, n_rows: int | None,
                 out: str, rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET, source: tuple[DataFrame, Column] | None = None) -> DataFrame:
    """``NTILE(k) OVER (ORDER BY column NULLS FIRST, order_key)`` without one-task windows.

    ``source`` (table, value): the rows of ``df`` before joins, with its columns, and the
    expression that gives ``column`` there; the ends are then selected on that table.

    The tuples (column, order_key) at the ends of the tiles are selected; a row is in the tile
    after the last end below it.  Without ``order_key`` ties are broken by a hash of the
    whole row, so the result is still deterministic (fully identical rows are
    interchangeable).  Rows equal to an end that more of them exceed than its tile holds
    are numbered among themselves."""
    n_rows = df.count() if n_rows is None else n_rows
    ends = tile_ends(n_rows, k)
    if not ends:
        return df.withColumn(out, F.lit(1).cast("bigint"))
    table, value = source or (df, col_of(column))
    tie = col_of(order_key) if order_key else F.xxhash64(*[col_of(c) for c in table.columns])
    keys = [col_of(column), tie]
    chosen = Selection(table, [value, tie])
    tuples = chosen.at(ends, n_rows)
    counts = chosen.around(tuples)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(keys)])

    def tile(low: int, high: int) -> Column:
        """Ends low .. high - 1 are still to be compared: a search of log2(k) steps."""
        if low == high:
            return F.lit(low + 1)
        mid = (low + high) // 2
        return F.when(key > chosen.tuple_of(tuples[mid]), tile(mid + 1, high)).otherwise(tile(low, mid))

    across = {t: c for t, c, e in zip(tuples, counts, ends) if sum(c) > e}
    placed_rows = df.withColumn(out, tile(0, len(ends)).cast("bigint"))
    if not across:
        return placed_rows
    # number the rows of the tuples that lie across tiles; a tuple's first rank is known
    which, number = unused([*df.columns, out], "which"), unused([*df.columns, out], "number")
    split = F.lit(None).cast("int")
    for i, t in enumerate(across):
        split = F.when(key.eqNullSafe(chosen.tuple_of(t)), F.lit(i)).otherwise(split)
    marked = placed_rows.withColumn(which, split)
    equal = marked.where(F.col(which).isNotNull())
    tie = [SortKey(which)]
    total = sum(c[1] for c in across.values())
    numbered = global_row_number(equal, tie, total, number, rows_per_bucket)
    rank, before = F.lit(None).cast("bigint"), 0
    for i, (under, same) in enumerate(across.values()):
        rank = F.when(F.col(which) == i, F.col(number) - F.lit(before) + F.lit(under)).otherwise(rank)
        before += same
    numbered = numbered.withColumn(out, ntile_from_rank(rank, n_rows, k))
    names = [col_of(c) for c in placed_rows.columns]
    return marked.where(F.col(which).isNull()).select(*names).unionByName(numbered.select(*names))


def dense_rank_dictionary(values: DataFrame, value_col: str, out: str = "code",
                          rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Distinct values → 0-based dense rank in ascending (byte) order."""
    one = values.select(F.lit("").alias("grp"), col_of(value_col).alias("val"))
    return dense_rank_dictionaries(one, "grp", "val", out, rows_per_bucket).select(F.col("val").alias(value_col), out)


def dense_rank_dictionaries(values: DataFrame, group_col: str, value_col: str, out: str = "code",
                            rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Dense ranks of many dictionaries at once: the distinct (group, value) pairs are
    staged once and ranked in ONE global order on (group, value); a group's codes
    start at its first position.  Output: group, value, 0-based code, staged."""
    pairs = stage(values.select(col_of(group_col).alias("g"), col_of(value_col).alias("v")).distinct(), "dictionary")
    ranked = global_row_number(pairs, [SortKey("g"), SortKey("v")], pairs.count(), "rn", rows_per_bucket)
    first = ranked.groupBy("g").agg(F.min("rn").alias("first")).withColumnRenamed("g", "of")
    # one row per group (a column, a few dozen at most)
    return ranked.join(F.broadcast(first), F.col("g").eqNullSafe(F.col("of"))).select(
        F.col("g").alias(group_col), F.col("v").alias(value_col), (F.col("rn") - F.col("first")).cast("bigint").alias(out))
