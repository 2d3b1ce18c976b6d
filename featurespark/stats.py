"""StatsPlan: gather every global statistic the requested operators need, compute
them in ONE aggregate over the input (partial + final aggregation, no
single-partition window over data rows), and hand the one-row result back as
literals.

Quantiles (session conf ``featurespark.quantiles``, default ``exact``):
  * ``exact``  – the aggregate carries a bounded sketch of each column; two further
    passes settle the exact values (operators.quantiles).  One way at every size.
  * ``approx`` – ``percentile_approx`` with a configurable accuracy, on request only.

NaN is missing, like NULL, in every statistic.

Mode is computed separately as a distributed ``groupBy(x).count()`` followed by
a constant-state ``min_by`` so no value map is held in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.columns import col_of
from .operators.quantiles import column_quantiles, sketch


def default_quantile_method(spark) -> str:
    return spark.conf.get("featurespark.quantiles", "exact")


@dataclass
class Stats:
    values: dict = field(default_factory=dict)

    def __getitem__(self, key):
        return self.values[key]

    def get(self, key, default=None):
        return self.values.get(key, default)

    def q(self, col: str, p: float):
        return self.values[("q", col, float(p))]


class StatsPlan:
    """Collects aggregate requests; ``fit(df)`` runs them in one job."""

    SIMPLE = {
        "avg": lambda c: F.avg(c.cast("double")),
        "stddev": lambda c: F.stddev_samp(c.cast("double")),
        "var_pop": lambda c: F.var_pop(c.cast("double")),
        "min": F.min,
        "max": F.max,
        "count": F.count,
        "ndv": lambda c: F.approx_count_distinct(c, 0.05),
        "skew": lambda c: F.skewness(c.cast("double")),
        "kurt": lambda c: F.kurtosis(c.cast("double")),
        "nulls": lambda c: F.count_if(c.isNull()),
    }

    def __init__(self, quantile_method: str | None = None, accuracy: int = 1_000_000):
        self.quantile_method = quantile_method
        self.accuracy = accuracy
        self._simple: dict[tuple, Callable[[Column], Column]] = {}
        self._quant: dict[str, set] = defaultdict(set)
        self._quant_disc: dict[str, set] = defaultdict(set)
        self._modes: set[str] = set()
        self._rows = False

    # -- requests -----------------------------------------------------------
    def need(self, kind: str, col: str):
        if kind == "rows":
            self._rows = True
        elif kind == "mode":
            self._modes.add(col)
        else:
            self._simple[(kind, col)] = self.SIMPLE[kind]
        return (kind, col)

    def need_q(self, col: str, p: float):
        self._quant[col].add(float(p))
        return ("q", col, float(p))

    def need_qdisc(self, col: str, p: float):
        self._quant_disc[col].add(float(p))
        return ("qd", col, float(p))

    def empty(self) -> bool:
        return not (self._simple or self._quant or self._quant_disc or self._modes or self._rows)

    # -- execution ----------------------------------------------------------
    def fit(self, df: DataFrame) -> Stats:
        approx = (self.quantile_method or default_quantile_method(df.sparkSession)) == "approx"
        stats = Stats()
        if self.empty():                     # nothing asked for: no job
            return stats
        wanted = {c: [("cont", p) for p in sorted(self._quant.get(c, ()))] + [("disc", p) for p in sorted(self._quant_disc.get(c, ()))]
                  for c in sorted(set(self._quant) | set(self._quant_disc))}
        exprs = [make(present(df, col)).alias(f"s{i}") for i, ((_, col), make) in enumerate(self._simple.items())]
        exprs.append(F.count(F.lit(1)).alias("rows"))
        for j, (c, requests) in enumerate(wanted.items()):
            x = present(df, c).cast("double")
            if approx:
                exprs.append(F.percentile_approx(x, F.array(*[F.lit(p) for _, p in requests]), self.accuracy).alias(f"q{j}"))
            else:
                exprs += [F.count(x).alias(f"n{j}"), sketch(x, requests).alias(f"q{j}")]
        row = df.agg(*exprs).first()
        for i, key in enumerate(self._simple):
            stats.values[key] = row[f"s{i}"]
        stats.values[("rows", None)] = row["rows"]
        found = {c: row[f"q{j}"] for j, c in enumerate(wanted)}
        if approx:
            values = {(kind, c, p): v for c, requests in wanted.items() for (kind, p), v in zip(requests, found[c] or [None] * len(requests))}
        else:
            values = column_quantiles(df, wanted, {c: row[f"n{j}"] for j, c in enumerate(wanted)}, found) if wanted else {}
        for (kind, c, p), v in values.items():
            stats.values[("q" if kind == "cont" else "qd", c, p)] = v
        if self._modes:
            for col, v in modes_of(df, sorted(self._modes)).items():
                stats.values[("mode", col)] = v
        return stats


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN as NULL."""
    c = col_of(name)
    return F.when(~F.isnan(c), c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c


def modes_of(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent non-missing value of each column (smallest on ties) in one job:
    columns of one type are unpivoted to (column, value), counted with partial
    aggregation, and reduced by a constant-state min_by per column."""
    out = {}
    by_type: dict[str, list[str]] = {}
    for c in cols:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for _, group in by_type.items():
        if len(group) == 1:
            out[group[0]] = mode_of(df, group[0])
            continue
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), present(df, c).alias("v")) for c in group])))
        counts = long.where(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        rows = counts.groupBy("c").agg(
            F.min_by("v", F.struct((-F.col("n")).alias("nn"), F.col("v").alias("vv"))).alias("m")).collect()
        got = {r["c"]: r["m"] for r in rows}
        for c in group:
            out[c] = got.get(c)
    return out


def mode_of(df: DataFrame, col: str):
    """Most frequent non-missing value, smallest value on ties (None if all NULL).

    Distributed: partial-aggregated group count, then a constant-state min_by."""
    counts = df.select(present(df, col).alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.min_by("v", F.struct((-F.col("n")).alias("nn"), F.col("v").alias("vv"))).alias("m")).collect()
    return row[0]["m"] if row else None
