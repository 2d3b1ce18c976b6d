"""Exact quantiles in bounded memory per task, one way at every size.

Spark's exact ``percentile`` merges a value → count map of a whole column in one
task.  Here a mergeable sketch (``percentile_approx``, rank error n / ACCURACY)
gives a bracket of two values around every wanted rank; one pass counts the rows
below each bracket exactly, another orders only the values inside, summed per
distinct value.  The wanted rank is then known exactly, and so is whether the bracket
held it: if it did not, the side on which the rank lies is narrowed again from within
(by samples for a column, by a second sketch for groups), so a miss costs passes, not a
task with the whole column.

percentile_cont(p) = v[r] + f·(v[r+1] − v[r]) with h = p·(n−1), r = ⌊h⌋+1,
f = h − ⌊h⌋; percentile_disc(p) = v[max(1, ⌈p·n⌉)] (1-based ranks).  NULL and NaN
are missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_of
from ..session import stage
from .selection import Selection

ACCURACY = 50_000
#: groups of at most this many rows are ordered whole (an open bracket)
WHOLE = 20_000
#: steps of the sketch that narrows a bracket that missed
GRID = 500


def probes(requests: list[tuple[str, float]]) -> list[float]:
    """Sketch fractions on both sides of each request, further out than the sketch's error."""
    margin = 2.0 / ACCURACY
    return [f for _, p in requests for f in (max(0.0, p - margin), min(1.0, p + margin))]


def sketch(x: Column, requests: list[tuple[str, float]]) -> Column:
    return F.percentile_approx(x, F.array(*[F.lit(f) for f in probes(requests)]), ACCURACY)


def target_ranks(kind: str, p: float, n: int) -> tuple[int, int, float]:
    """(rank, next rank, weight of the next) whose mix is the quantile; 1-based."""
    if kind == "disc":
        r = max(1, math.ceil(p * n - 1e-12))
        return r, r, 0.0
    h = p * (n - 1)
    r = math.floor(h) + 1
    f = h - math.floor(h)
    return r, min(r + (f > 0), n), f


def column_quantiles(df: DataFrame, wanted: dict[str, list[tuple[str, float]]], counts: dict[str, int],
                     sketches: dict[str, list[float]]) -> dict:
    """{(kind, column, p): value} from each column's row count and sketch values (of
    :func:`probes`).  Two jobs for all columns together."""
    todo = []                                   # (column, kind, p, low, high, ranks)
    out = {}
    for c, requests in wanted.items():
        n, found = counts[c], sketches[c]
        for i, (kind, p) in enumerate(requests):
            if not n:
                out[(kind, c, p)] = None
                continue
            low, high = (found[2 * i], found[2 * i + 1]) if n > WHOLE else (None, None)
            todo.append((c, kind, p, low, high, target_ranks(kind, p, n)))
    values, missed = _settle_columns(df, todo) if todo else ({}, [])
    out.update(values)
    for c, kind, p, _, _, (r1, r2, f) in missed:
        x = col_of(c).cast("double")
        v1, v2 = (t[0] for t in Selection(df.where(_present(x)), [x]).at([r1, r2], counts[c]))
        out[(kind, c, p)] = v1 + f * (v2 - v1)
    return out


def _present(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def _settle_columns(df: DataFrame, todo: list) -> tuple[dict, list]:
    x = [col_of(c).cast("double") for c, *_ in todo]
    below = [F.lit(0).alias(f"b{i}") if low is None else F.count_if(_present(x[i]) & (x[i] < low)).alias(f"b{i}")
             for i, (_, _, _, low, _, _) in enumerate(todo)]
    counted = [i for i, t in enumerate(todo) if t[3] is not None]
    row = df.agg(*[below[i] for i in counted]).first() if counted else None
    under = {i: int(row[f"b{i}"]) for i in counted}
    inside = [_present(x[i]) & (F.lit(True) if t[3] is None else x[i].between(t[3], t[4])) for i, t in enumerate(todo)]
    some = inside[0]
    for c in inside[1:]:
        some = some | c
    values = F.array(*[F.when(c, F.struct(F.lit(i).alias("i"), x[i].alias("x"))) for i, c in enumerate(inside)])
    ranks = df.sparkSession.createDataFrame(
        [(i, under.get(i, 0), *t[5][:2]) for i, t in enumerate(todo)], "i int, below long, r1 long, r2 long")
    settled = _ranked(df.where(some).select(F.inline(F.array_compact(values))), ["i"], F.broadcast(ranks)).collect()
    done, again = {}, []
    got = {r["i"]: r for r in settled}
    for i, (c, kind, p, low, high, (r1, r2, f)) in enumerate(todo):
        r = got.get(i)
        if r is None or not r["held"]:
            again.append(todo[i])
        else:
            done[(kind, c, p)] = r["v1"] + f * (r["v2"] - r["v1"])
    return done, again


def _ranked(inside: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """(keys, v1, v2, held): the values at ranks r1 and r2 of each key's rows, ``below`` of
    which lie under the bracket; ``inside`` has (keys, x)."""
    counted = inside.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("upto", upto).join(ranks, keys).withColumn("upto", F.col("upto") + F.col("below"))
    return placed.groupBy(*keys).agg(
        F.min(F.when(F.col("upto") >= F.col("r1"), F.col("x"))).alias("v1"),
        F.min(F.when(F.col("upto") >= F.col("r2"), F.col("x"))).alias("v2"),
        ((F.max("below") < F.max("r1")) & (F.max("upto") >= F.max("r2"))).alias("held"))


def grouped_quantiles(long: DataFrame, keys: list[str], value: str, requests: list[tuple[str, float]]) -> DataFrame:
    """(keys, n, q0, q1, ...): exact quantiles of ``value`` for each group, one row per
    group with a value; any number of groups.  The brackets are a table joined to the rows
    on the keys, so neither the plan nor the driver grows with the groups."""
    x = F.col(value).cast("double")
    base = long.select(*keys, x.alias("x")).where(_present(F.col("x")))
    first = stage(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketch(F.col("x"), requests).alias("s")), "sketches")
    brackets = first.select(*keys, F.explode(F.array(*[_bracket(i, kind, p) for i, (kind, p) in enumerate(requests)])).alias("w")).select(*keys, "w.*")
    settled = stage(_settle_groups(base, keys, brackets), "quantiles")
    missed = brackets.join(settled.where("held").select(*keys, "i"), [*keys, "i"], "left_anti")
    while not missed.isEmpty():
        missed = stage(_narrowed(base, keys, _narrowed(base, keys, missed)), "brackets")
        again = stage(_settle_groups(base, keys, missed), "quantiles")
        settled = settled.where("held").unionByName(again)
        missed = missed.join(again.where("held").select(*keys, "i"), [*keys, "i"], "left_anti")
    wide = settled.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"q{i}") for i in range(len(requests))])
    return first.select(*keys, "n").join(wide, keys)


def _bracket(i: int, kind: str, p: float) -> Column:
    n, s = F.col("n"), F.col("s")
    if kind == "disc":
        r1 = F.greatest(F.lit(1), F.ceil(F.lit(p) * n - 1e-12))
        r2, f = r1, F.lit(0.0)
    else:
        h = F.lit(p) * (n - 1)
        r1 = F.floor(h) + 1
        f = h - F.floor(h)
        r2 = F.least(r1 + (f > 0).cast("long"), n)
    whole = n <= WHOLE
    return F.struct(F.lit(i).alias("i"), F.when(~whole, s[2 * i]).alias("low"), F.when(~whole, s[2 * i + 1]).alias("high"),
                    r1.cast("long").alias("r1"), r2.cast("long").alias("r2"), f.alias("f"))


def _narrowed(base: DataFrame, keys: list[str], brackets: DataFrame) -> DataFrame:
    """Brackets that missed, narrowed: a bound on the wrong side of a rank is opened, and a
    sketch of the rows that are then inside gives bounds GRID times closer."""
    by, x = [*keys, "i"], F.col("x")
    low, high = F.col("low"), F.col("high")
    met = base.join(brackets, keys)
    told = met.groupBy(*by).agg(F.count_if(x < low).alias("under"), F.count_if(x <= high).alias("upto"))
    opened = brackets.join(told, by).select(
        *by, F.when(F.col("r1") > F.col("under"), low).alias("low"), F.when(F.col("r2") <= F.col("upto"), high).alias("high"), "r1", "r2", "f")
    opened = stage(opened, "brackets")
    inside = (low.isNull() | (x >= low)) & (high.isNull() | (x <= high))
    grid = F.percentile_approx(F.when(inside, x), F.array(*[F.lit(j / GRID) for j in range(GRID + 1)]), ACCURACY)
    sketched = base.join(opened, keys).groupBy(*by).agg(F.count_if(x < low).alias("under"), F.count_if(inside).alias("held"), grid.alias("grid"))
    share = lambda r: (F.col(r) - F.col("under")) / F.col("held") * GRID
    left, right = F.floor(share("r1")).cast("int") - 2, F.ceil(share("r2")).cast("int") + 2
    return opened.join(sketched, by).select(
        *by, F.when(left >= 0, F.col("grid")[left]).otherwise(low).alias("low"), F.when(right <= GRID, F.col("grid")[right]).otherwise(high).alias("high"), "r1", "r2", "f")


def _settle_groups(base: DataFrame, keys: list[str], brackets: DataFrame) -> DataFrame:
    packed = brackets.groupBy(*keys).agg(F.collect_list(F.struct("i", "low", "high")).alias("w"))    # one entry per request
    joined = base.join(packed, keys)
    under = (joined.select(*keys, "x", F.explode("w").alias("b")).where(F.col("x") < F.col("b.low"))
             .groupBy(*keys, F.col("b.i").alias("i")).agg(F.count(F.lit(1)).alias("below")))
    inside = joined.select(*keys, "x", F.explode("w").alias("b")).where(
        (F.col("b.low").isNull() | (F.col("x") >= F.col("b.low"))) & (F.col("b.high").isNull() | (F.col("x") <= F.col("b.high"))))
    by = [*keys, "i"]
    ranks = brackets.join(under, by, "left").select(*by, F.coalesce("below", F.lit(0)).alias("below"), "r1", "r2", "f")
    got = _ranked(inside.select(*keys, F.col("b.i").alias("i"), "x"), by, ranks.drop("f"))
    return got.join(ranks.select(*by, "f"), by).select(*by, (F.col("v1") + F.col("f") * (F.col("v2") - F.col("v1"))).alias("v"), "held")
