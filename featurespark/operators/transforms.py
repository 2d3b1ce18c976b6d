"""Single-column feature transforms (N*, C*, T*, V*, O*, I*, D*) and the
multi-transform projection (X2).

Fit/transform split, like a Spark ML estimator:

* ``fit`` registers every global statistic of every spec in one StatsPlan and
  runs ONE aggregate; lookup tables (label dictionary, value counts, target
  means) are DataFrames derived from the fitted input.
* ``transform`` inlines the statistics as literals (constant-folded by
  Catalyst, no window over the whole table) and joins each lookup on its key.
  A lookup is broadcast only when its estimated distinct count (HLL from the
  stats pass, +20 % margin) is below ``max_broadcast_rows``; otherwise it is a
  shuffle join, and AQE splits a skewed key's partition.

Statistics come from the raw column; NTILE is the only rank-based transform
and runs through operators.rank (bucketed global row number).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import specs as S
from ..functions.columns import as_text, btrim_ws, clip, col_of, md5_bucket, nan_to_null
from ..session import stage
from ..stats import Stats, StatsPlan
from . import rank

LOOKUP_METHODS = {"label_encoding", "frequency_encoding", "target_encoding"}
RANK_METHODS = {"binning"}


def _f(v):
    return None if v is None else float(v)


def _lit_double(v) -> Column:
    return F.lit(None).cast("double") if v is None else F.lit(float(v))


# ---------------------------------------------------------------------------
# statistic requests per transform (on the RAW column)
# ---------------------------------------------------------------------------
def register_needs(spec: S.Spec, plan: StatsPlan) -> None:
    c, m, p = spec.column, spec.method, spec.params
    if m == "standardization":
        plan.need("avg", c), plan.need("stddev", c)
    elif m == "normalization":
        plan.need("min", c), plan.need("max", c)
    elif m == "robust_scaling":
        for q in (0.25, 0.5, 0.75):
            plan.need_q(c, q)
    elif m == "impute_mean":
        plan.need("avg", c)
    elif m == "impute_median":
        plan.need_q(c, 0.5)
    elif m == "impute_mode":
        plan.need("mode", c)
    elif m == "clip_iqr":
        plan.need_q(c, 0.25), plan.need_q(c, 0.75)
    elif m == "winsorize":
        plan.need_q(c, float(p["lower_percentile"])), plan.need_q(c, float(p["upper_percentile"]))
    elif m in RANK_METHODS:
        plan.need("rows", c)


# ---------------------------------------------------------------------------
# expressions: transform an input expression ``x`` (raw column or the value
# of an earlier step in a chain) using statistics of the raw column
# ---------------------------------------------------------------------------
def iqr_bounds(stats: Stats, col: str):
    q1, q3 = _f(stats.q(col, 0.25)), _f(stats.q(col, 0.75))
    if q1 is None or q3 is None:
        return None, None
    iqr = q3 - q1
    return q1 - 1.5 * iqr, q3 + 1.5 * iqr


def scalar_expr(spec: S.Spec, x: Column, dtype: T.DataType, stats: Stats) -> Column:
    """Row-local expression of a one-output transform (no lookup, no rank)."""
    c, m, p = spec.column, spec.method, spec.params
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        x = nan_to_null(x)              # NaN is missing
    xd = x.cast("double")
    if m == "standardization":
        avg, sd = _f(stats[("avg", c)]), _f(stats[("stddev", c)])
        if avg is None or not sd:
            return F.lit(None).cast("double")
        return (xd - F.lit(avg)) / F.lit(sd)
    if m == "normalization":
        lo, hi = _f(stats[("min", c)]), _f(stats[("max", c)])
        if lo is None or hi is None or hi == lo:
            return F.lit(None).cast("double")
        return (xd - F.lit(lo)) / F.lit(hi - lo)
    if m == "log_transformation":
        return F.ln(xd + F.lit(1.0))
    if m == "sqrt_transformation":
        return F.sqrt(F.abs(xd))
    if m == "power_transformation":
        return nan_to_null(F.pow(xd, F.lit(float(p["power"]))))
    if m == "custom_binning":
        b1, b2, b3 = (F.lit(p["bin1"]), F.lit(p["bin2"]), F.lit(p["bin3"]))
        return (F.when(x < b1, "low").when(x < b2, "medium").when(x < b3, "high").otherwise("very_high"))
    if m == "robust_scaling":
        q1, q2, q3 = (_f(stats.q(c, v)) for v in (0.25, 0.5, 0.75))
        if q2 is None or q1 is None or q3 is None or q3 == q1:
            return F.lit(None).cast("double")
        return (xd - F.lit(q2)) / F.lit(q3 - q1)
    if m == "binary_encoding":
        return F.when(as_text(x, dtype).isin(S.TRUE_TEXTS), F.lit(1)).otherwise(F.lit(0))
    if m in ("hash_encoding", "one_hot_encoding"):
        return md5_bucket(as_text(x, dtype), int(p["num_buckets"]))
    if m == "lowercase":
        return F.lower(as_text(x, dtype))
    if m == "uppercase":
        return F.upper(as_text(x, dtype))
    if m == "trim":
        return btrim_ws(as_text(x, dtype))
    if m == "string_length":
        return F.char_length(as_text(x, dtype))
    if m == "extract_numbers":
        return F.regexp_substr(as_text(x, dtype), F.lit("[0-9]+")).try_cast("bigint")
    if m == "impute_mean":
        return F.coalesce(xd, _lit_double(stats[("avg", c)]))
    if m == "impute_median":
        return F.coalesce(xd, _lit_double(stats.q(c, 0.5)))
    if m == "impute_mode":
        mode = stats[("mode", c)]
        return x if mode is None else F.coalesce(x, F.lit(mode).cast(dtype))
    if m == "impute_constant":
        fill = p["fill_value"]
        if isinstance(dtype, T.NumericType) and isinstance(fill, (int, float)):
            return F.coalesce(x, F.lit(fill))
        return F.coalesce(x, F.lit(fill).cast(dtype) if not isinstance(dtype, T.NumericType) else F.lit(fill))
    if m == "missing_indicator":
        return x.isNull().cast("int")
    if m == "clip_outliers":
        return clip(x, p["lower_bound"], p["upper_bound"])
    if m == "clip_iqr":
        lo, hi = iqr_bounds(stats, c)
        return clip(xd, _lit_double(lo), _lit_double(hi)) if lo is not None else F.lit(None).cast("double")
    if m == "winsorize":
        lo = _f(stats.q(c, float(p["lower_percentile"])))
        hi = _f(stats.q(c, float(p["upper_percentile"])))
        return clip(xd, _lit_double(lo), _lit_double(hi)) if lo is not None else F.lit(None).cast("double")
    if m == "polynomial_features":
        return F.pow(xd, F.lit(2.0))
    if m == "date_diff":
        return F.datediff(reference_date(p), F.to_date(x))
    raise ValueError(f"{m} is not a row-local transform")


def reference_date(params: dict) -> Column:
    ref = params.get("reference_date")
    if ref is None:
        return F.current_date()
    if isinstance(ref, _dt.datetime):
        ref = ref.date()
    if isinstance(ref, _dt.date):
        return F.lit(ref.isoformat()).cast("date")
    return F.to_date(F.lit(str(ref)))


def multi_output(spec: S.Spec, df: DataFrame) -> list[tuple[str, Column]]:
    """Transforms with their own output naming (two inputs or several outputs)."""
    m, p = spec.method, spec.params
    if m in ("interaction", "ratio"):
        a, b = p["column1"], p["column2"]
        ca, cb = col_of(a), col_of(b)
        name = f"{S.sanitize_column_name(a)}_{'x' if m == 'interaction' else 'div'}_{S.sanitize_column_name(b)}"
        if m == "interaction":
            return [(name, ca * cb)]
        return [(name, ca / F.nullif(cb, F.lit(0)))]
    if m == "extract_date_parts":
        x, base = col_of(spec.column), spec.out_base
        return [(f"{base}_year", F.year(x)), (f"{base}_month", F.month(x)),
                (f"{base}_day", F.dayofmonth(x)), (f"{base}_dayofweek", F.dayofweek(x))]
    raise ValueError(m)


MULTI = {"interaction", "ratio", "extract_date_parts"}


# ---------------------------------------------------------------------------
# lookups (joins on a key expression)
# ---------------------------------------------------------------------------
@dataclass
class Lookup:
    """key expression on the input → value column from a table keyed by ``__lk``."""
    key: Column
    table: DataFrame          # columns: __lk, __lv
    null_safe: bool = True


def lookup_tables(fit_df: DataFrame, wanted: list[tuple[str, str, Column, T.DataType, str | None]],
                  rows_per_bucket: int = rank.DEFAULT_ROWS_PER_BUCKET) -> dict[str, DataFrame]:
    """Lookup tables (__lk, __lv) by name of label / frequency / target encodings fitted on
    ``fit_df``; ``wanted`` has (name, method, key expression, key type, target column).

    All encodings of one method (and target) are one group-by over (name, value) pairs,
    staged once; each table is a filter on that staged table, so the input is read once
    per method, however many columns it encodes."""
    kinds: dict[tuple[str, str | None], list] = {}
    for name, method, key, dtype, target in wanted:
        text = as_text(key, dtype)
        if method == "label_encoding":
            text = F.coalesce(text, F.lit(""))
        kinds.setdefault((method, target if method == "target_encoding" else None), []).append((name, text))
    out = {}
    for (method, target), keys in kinds.items():
        pairs = F.inline(F.array(*[F.struct(F.lit(n).alias("g"), t.alias("v")) for n, t in keys]))
        if method == "label_encoding":
            table = stage(rank.dense_rank_dictionaries(fit_df.select(pairs), "g", "v", "n", rows_per_bucket), "labels")
        elif method == "frequency_encoding":
            table = stage(fit_df.select(pairs).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")), "counts")
        else:
            mean = F.avg(F.col("__y")).alias("n")
            table = stage(fit_df.select(pairs, col_of(target).cast("double").alias("__y")).groupBy("g", "v").agg(mean), "means")
        for n, _ in keys:
            out[n] = table.where(F.col("g") == n).select(F.col("v").alias("__lk"), F.col("n").alias("__lv"))
    return out


def build_lookup_key(spec: S.Spec, x: Column, dtype: T.DataType) -> Column:
    """The join key a lookup of ``spec`` expects for input expression ``x``."""
    if spec.method == "label_encoding":
        return F.coalesce(as_text(x, dtype), F.lit(""))
    if spec.method in ("frequency_encoding", "target_encoding"):
        return as_text(x, dtype)
    return x


def join_lookup(df: DataFrame, lookup: Lookup, out: str) -> DataFrame:
    """Left join of ``lookup`` onto ``df``; adds column ``out``.  The table is staged, so
    Spark knows its size in bytes: it broadcasts a small one and shuffles a large one,
    where adaptive execution splits a hot key."""
    k = f"__key{out}"
    left = df.withColumn(k, lookup.key)
    table = lookup.table.withColumnRenamed("__lk", k + "_r").withColumnRenamed("__lv", out)
    cond = (left[k].eqNullSafe(table[k + "_r"]) if lookup.null_safe else left[k] == table[k + "_r"])
    return left.join(table, cond, "left").drop(k, k + "_r")


# ---------------------------------------------------------------------------
# Many independent transforms in one projection
# ---------------------------------------------------------------------------
@dataclass
class TransformResult:
    df: DataFrame
    applied: list = field(default_factory=list)
    skipped: list = field(default_factory=list)
    outputs: list = field(default_factory=list)


def output_name(spec: S.Spec) -> str:
    return f"{spec.out_base}_{S.SUFFIX[spec.method]}"


@dataclass
class FittedTransforms:
    """Statistics and lookup tables fitted on one DataFrame; ``transform`` applies
    them to any DataFrame with the same input columns (batch or streaming)."""
    specs: list
    skipped: list
    stats: Stats
    lookups: dict                      # spec index → Lookup (staged tables fitted on the input)
    order_key: str | None
    rows_per_bucket: int
    source: DataFrame | None = None    # the fitted input (its row count is known)

    def transform(self, df: DataFrame, include_original: bool = True) -> TransformResult:
        out = df
        outputs: list[tuple[str, Column]] = []
        for i, spec in enumerate(self.specs):
            x = col_of(spec.column)
            dtype = df.schema[spec.column].dataType
            if spec.method in MULTI:
                outputs.extend(multi_output(spec, df))
                continue
            name = output_name(spec)
            if spec.method in LOOKUP_METHODS:
                tmp = f"__lookup_{i}"
                lk = self.lookups[i]
                key = build_lookup_key(spec, x, dtype)
                out = join_lookup(out, Lookup(key, lk.table, lk.null_safe), tmp)
                outputs.append((name, F.col(tmp)))
            elif spec.method == "binning":
                if df.isStreaming:
                    raise ValueError("NTILE needs the whole table; it cannot run on a stream")
                tmp = f"__rank_{i}"
                key = spec.params.get("order_key", self.order_key)
                n_rows = self.stats[("rows", None)] if df is self.source else None
                out = rank.global_ntile(out, spec.column, int(spec.params["num_bins"]), key,
                                        n_rows, tmp, self.rows_per_bucket)
                outputs.append((name, F.col(tmp)))
            else:
                outputs.append((name, scalar_expr(spec, x, dtype, self.stats)))
        outputs = dedupe_names(outputs, df.columns if include_original else [])
        base = [col_of(c) for c in df.columns] if include_original else []
        result = out.select(*base, *[c.alias(n) for n, c in outputs])
        return TransformResult(result, self.specs, self.skipped, [n for n, _ in outputs])


def fit_transforms(df: DataFrame, raw_specs: list[dict], quantiles: str | None = None,
                   order_key: str | None = None,
                   rows_per_bucket: int = rank.DEFAULT_ROWS_PER_BUCKET) -> FittedTransforms:
    """One aggregate for every statistic of every spec, and one staged lookup table for
    each kind of encoding.  Invalid specs are skipped with a reason; when all are,
    there is nothing to fit and an error is raised."""
    valid, skipped = S.validate_specs(raw_specs, df.columns)
    if not valid:
        raise S.no_valid_specs(skipped)
    plan = StatsPlan(quantile_method=quantiles)
    for spec in valid:
        register_needs(spec, plan)
    stats = plan.fit(df)
    encoded = [(i, s) for i, s in enumerate(valid) if s.method in LOOKUP_METHODS]
    tables = lookup_tables(df, [(str(i), s.method, col_of(s.column), df.schema[s.column].dataType, s.params.get("target_column"))
                                for i, s in encoded], rows_per_bucket)
    lookups = {i: Lookup(build_lookup_key(s, col_of(s.column), df.schema[s.column].dataType), tables[str(i)],
                         null_safe=s.method != "label_encoding") for i, s in encoded}
    return FittedTransforms(valid, skipped, stats, lookups, order_key, rows_per_bucket, df)


def apply_transforms(df: DataFrame, raw_specs: list[dict], include_original: bool = True,
                     quantiles: str | None = None, order_key: str | None = None,
                     rows_per_bucket: int = rank.DEFAULT_ROWS_PER_BUCKET) -> TransformResult:
    """Apply each spec independently to the raw columns (template semantics)."""
    fitted = fit_transforms(df, raw_specs, quantiles, order_key, rows_per_bucket)
    return fitted.transform(df, include_original)


def dedupe_names(outputs: list[tuple[str, Column]], taken: list[str]) -> list[tuple[str, Column]]:
    """Give repeated output names a ``_2``, ``_3`` … suffix (aliases of one method
    on one column would otherwise collide)."""
    seen = set(taken)
    result = []
    for name, c in outputs:
        new, k = name, 2
        while new in seen:
            new, k = f"{name}_{k}", k + 1
        seen.add(new)
        result.append((new, c))
    return result


def one_hot_columns(df: DataFrame, column: str, max_values: int | None = None, drop_original: bool = False) -> DataFrame:
    """True one-hot (ours, beside the reference's hash-based 'one-hot'): one 0/1
    column per distinct non-NULL value; NULL rows are all zeros.  Values whose names
    collide get ``_2``, ``_3`` … in value order.

    The distinct values become column names and so travel to the driver; for a column
    of many values use :func:`one_hot_long`.  ``max_values`` makes that an error."""
    text = as_text(col_of(column), df.schema[column].dataType)
    found = df.select(text.alias("v")).where(F.col("v").isNotNull()).distinct()
    values = sorted(r[0] for r in (found if max_values is None else found.limit(max_values + 1)).collect())
    if max_values is not None and len(values) > max_values:
        raise ValueError(f"{column}: more than {max_values} distinct values")
    base = S.sanitize_column_name(column)
    keep = [c for c in df.columns if not (drop_original and c == column)]
    outs = dedupe_names([(f"{base}_{S.sanitize_column_name(v)}", F.when(text == F.lit(v), F.lit(1)).otherwise(F.lit(0)))
                         for v in values], keep)
    return df.select(*[col_of(c) for c in keep], *[c.alias(n) for n, c in outs])


def one_hot_long(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Sparse one-hot for any number of values: (keys, value, flag = 1), no row for NULL."""
    text = as_text(col_of(column), df.schema[column].dataType)
    return df.select(*[col_of(k) for k in keys], text.alias("value"), F.lit(1).alias("flag")).where(F.col("value").isNotNull())
