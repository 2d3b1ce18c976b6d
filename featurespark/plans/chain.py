"""Chained transforms per column → one model-ready table.

Specs are grouped by column (first appearance order) and stable-sorted by
priority: impute (1) → scale / other (2) → encode (3).  Each column's steps
nest into one expression; only the final value of each column is emitted,
named ``<column>_<suffixes>`` (suffixes in application order, de-duplicated).

Scale / clip / winsorize statistics come from the RAW column, so every
statistic of every column is computed in a single aggregate.  Only steps that
depend on the staged value (label / frequency / target encoding, NTILE) need
a second, small group-by (or the bucketed rank) on the staged value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import specs as S
from ..functions.columns import as_text, clip, col_of, md5_bucket
from ..operators import rank
from ..operators.transforms import (LOOKUP_METHODS, Lookup, build_lookup_key, dedupe_names, iqr_bounds, join_lookup,
                                    lookup_tables, multi_output, MULTI, scalar_expr, _lit_double, _f)
from ..session import stage
from ..stats import Stats, StatsPlan

# FIXED VALUES: suffix of each step inside a chain.
CHAIN_SUFFIX = {
    "impute_mean": "imputed", "impute_median": "imputed", "impute_mode": "imputed",
    "impute_constant": "imputed", "hash_encoding": "encoded", "one_hot_encoding": "encoded",
    "binary_encoding": "binary", "label_encoding": "encoded", "frequency_encoding": "freq",
    "winsorize": "winsorized", "standardization": "scaled", "normalization": "normalized",
    "log_transformation": "log", "sqrt_transformation": "sqrt", "clip_outliers": "clipped",
    "clip_iqr": "clipped",
}
CHAIN_HASH_BUCKETS = 50


@dataclass
class ChainResult:
    df: DataFrame
    lineage: list = field(default_factory=list)
    skipped: list = field(default_factory=list)

    def lineage_df(self, spark):
        rows = [(l["original_column"], l["output_column"], l["transformations"]) for l in self.lineage]
        return spark.createDataFrame(rows, "original_column string, output_column string, "
                                           "transformations array<string>")


def group_by_column(specs: list[S.Spec]) -> dict[str, list[S.Spec]]:
    grouped: dict[str, list[S.Spec]] = {}
    for s in specs:
        grouped.setdefault(s.column, []).append(s)
    return {c: sorted(v, key=lambda s: S.priority(s.method)) for c, v in grouped.items()}


def _register_chain_needs(column: str, steps: list[S.Spec], plan: StatsPlan) -> None:
    for s in steps:
        m = s.method
        if m == "impute_mean" or m == "standardization":
            plan.need("avg", column)
            if m == "standardization":
                plan.need("stddev", column)
        elif m == "impute_median":
            plan.need_q(column, 0.5)
        elif m == "impute_mode":
            plan.need("mode", column)
        elif m == "normalization":
            plan.need("min", column), plan.need("max", column)
        elif m in ("clip_iqr", "clip_outliers"):
            plan.need_q(column, 0.25), plan.need_q(column, 0.75)
        elif m == "winsorize":
            plan.need_q(column, float(s.params["lower_percentile"]))
            plan.need_q(column, float(s.params["upper_percentile"]))
        elif m == "robust_scaling":
            for q in (0.25, 0.5, 0.75):
                plan.need_q(column, q)
        elif m == "binning":
            plan.need("rows", column)


NUMERIC_OUT = {"standardization", "normalization", "log_transformation", "sqrt_transformation",
               "power_transformation", "robust_scaling", "clip_iqr", "clip_outliers", "winsorize",
               "polynomial_features", "impute_mean", "impute_median"}
LONG_OUT = {"hash_encoding", "one_hot_encoding", "binary_encoding", "label_encoding",
            "frequency_encoding", "binning", "string_length", "extract_numbers",
            "missing_indicator", "date_diff"}
STRING_OUT = {"custom_binning", "lowercase", "uppercase", "trim"}


class _Chain:
    """Running state while nesting one column's steps."""

    def __init__(self, df: DataFrame, column: str, dtype: T.DataType, source: DataFrame):
        self.df = df
        self.source = source          # the chain's input table
        self.local = True             # expr is row-local on the input (no join / rank so far)
        self.column = column
        self.expr: Column = col_of(column)
        self.dtype = dtype
        self.suffixes: list[str] = []
        self.extra: list[tuple[str, Column]] = []


def _apply_step(ch: _Chain, spec: S.Spec, stats: Stats, idx: str, order_key, rows_per_bucket,
                pending: list | None = None) -> None:
    m, c = spec.method, ch.column
    if m in ("interaction", "ratio", "extract_date_parts"):
        ch.extra.extend(multi_output(spec, ch.df))
        return
    if m in ("hash_encoding", "one_hot_encoding"):
        n = int(spec.given.get("num_buckets", CHAIN_HASH_BUCKETS))
        ch.expr = md5_bucket(as_text(ch.expr, ch.dtype), n)
    elif m in ("clip_iqr", "clip_outliers"):
        lo, hi = iqr_bounds(stats, c)          # a chain always clips by IQR of the raw column
        ch.expr = clip(ch.expr.cast("double"), _lit_double(lo), _lit_double(hi))
    elif m == "winsorize":
        lo = _f(stats.q(c, float(spec.params["lower_percentile"])))
        hi = _f(stats.q(c, float(spec.params["upper_percentile"])))
        ch.expr = clip(ch.expr.cast("double"), _lit_double(lo), _lit_double(hi))
    elif m in LOOKUP_METHODS or m == "binning":
        staged = f"__stage{idx}"
        ch.df = ch.df.withColumn(staged, ch.expr)
        out = f"__step{idx}"
        if m == "binning":
            key = spec.params.get("order_key", order_key)
            # a row-local value is ranked on the input table, without other columns' joins
            on = (ch.source, ch.expr) if ch.local else None
            ch.df = rank.global_ntile(ch.df, staged, int(spec.params["num_bins"]), key, stats[("rows", None)], out, rows_per_bucket, on)
        elif pending is not None and ch.local:
            # deferred: all such steps of one kind share one staged table
            pending.append((spec, ch.expr, ch.dtype, staged, out))
        else:
            # fit the lookup on the input table when the staged value is row-local,
            # so its lineage does not re-run other columns' joins
            fit_df, key = ((ch.source, ch.expr) if ch.local else (ch.df, F.col(staged)))
            table = lookup_tables(fit_df, [(out, m, key, ch.dtype, spec.params.get("target_column"))], rows_per_bucket)[out]
            ch.df = join_lookup(ch.df, Lookup(build_lookup_key(spec, F.col(staged), ch.dtype), table, m != "label_encoding"), out)
        ch.expr = F.col(out)
        ch.local = False
    else:
        ch.expr = scalar_expr(spec, ch.expr, ch.dtype, stats)
    if m == "impute_constant":
        ch.dtype = ch.df.select(ch.expr.alias("x")).schema["x"].dataType     # an integer column filled with 0.5 is double
    elif m in NUMERIC_OUT:
        ch.dtype = T.DoubleType()
    elif m in LONG_OUT:
        ch.dtype = T.LongType()
    elif m in STRING_OUT:
        ch.dtype = T.StringType()
    suffix = CHAIN_SUFFIX.get(m) or S.SUFFIX.get(m)
    if suffix and suffix not in ch.suffixes:
        ch.suffixes.append(suffix)


def _resolve_pending(source: DataFrame, running: DataFrame, pending: list, rows_per_bucket: int) -> DataFrame:
    """Join the deferred lookups, all fitted on the chain's input: one staged table for
    each kind of encoding."""
    tables = lookup_tables(source, [(out, spec.method, expr, dtype, spec.params.get("target_column"))
                                    for spec, expr, dtype, _, out in pending], rows_per_bucket)
    for spec, _, dtype, staged, out in pending:
        lookup = Lookup(build_lookup_key(spec, F.col(staged), dtype), tables[out], spec.method != "label_encoding")
        running = join_lookup(running, lookup, out)
    return running


def auto_binary_target(x: Column, dtype: T.DataType) -> Column:
    return F.when(as_text(x, dtype).isin(S.TRUE_TEXTS), F.lit(1)).otherwise(F.lit(0))


def chain_lineage(raw_specs: list[dict], columns: list[str], target_column: str | None = None,
                  include_target: bool = True) -> list[dict]:
    """Lineage of the chain that ``raw_specs`` describe, from the specs alone (no data is
    read): which output each column gets, and by which steps."""
    out = []
    valid, _ = S.validate_specs(raw_specs, columns)
    for column, steps in group_by_column(valid).items():
        if column == target_column and not include_target:
            continue
        suffixes = list(dict.fromkeys(x for s in steps if s.method not in MULTI and (x := CHAIN_SUFFIX.get(s.method) or S.SUFFIX.get(s.method))))
        name = "target" if column == target_column else "_".join([S.sanitize_column_name(column), *suffixes])
        out.append(_lineage(column, name, [s.raw_method for s in steps]))
    if target_column and include_target and not any(l["original_column"] == target_column for l in out):
        out.append(_lineage(target_column, "target", [AUTO_TARGET]))
    return out


# FIXED VALUES: the step name of a target without a chain, and the keys of a lineage entry
AUTO_TARGET = "auto_binary_encoding"


def _lineage(column: str, output: str, steps: list[str]) -> dict:
    return {"original_column": column, "output_column": output, "transformations": steps}


def build_chain(df: DataFrame, raw_specs: list[dict], target_column: str | None = None,
                include_target: bool = True, quantiles: str | None = None, order_key: str | None = None,
                keep_columns: list[str] | None = None,
                rows_per_bucket: int = rank.DEFAULT_ROWS_PER_BUCKET, stage_input: bool = False) -> ChainResult:
    """X3 + X4: chained, model-ready projection of ``df``.

    ``keep_columns`` (ours) passes key columns through unchanged, e.g. to join
    the features back or compare them.  ``stage_input`` writes the needed input
    columns once as Parquet to the shared folder (``spark.checkpoint.dir``; see
    ``session.drop_staged``) — worth it when the input is expensive (a join), since
    every fitting pass then reads only its own columns of the staged table."""
    valid, skipped = S.validate_specs(raw_specs, df.columns)
    if not valid:
        raise S.no_valid_specs(skipped)
    if stage_input:
        needed = set(keep_columns or []) | {s.column for s in valid} | ({target_column} if target_column else set())
        for s in valid:
            for k in ("column1", "column2", "target_column", "order_key"):
                if isinstance(s.params.get(k), str):
                    needed.add(s.params[k])
        if order_key:
            needed.add(order_key)
        df = stage(df.select(*[col_of(c) for c in df.columns if c in needed]), "chain-input")
    grouped = group_by_column(valid)
    plan = StatsPlan(quantile_method=quantiles)
    for column, steps in grouped.items():
        _register_chain_needs(column, steps, plan)
    stats = plan.fit(df)

    running = df
    outputs: list[tuple[str, Column]] = []
    lineage = []
    pending: list = []
    for ci, (column, steps) in enumerate(grouped.items()):
        is_target = column == target_column
        if is_target and not include_target:
            continue
        ch = _Chain(running, column, df.schema[column].dataType, df)
        # a column with a single lookup step and
        # no rank step can defer that lookup to the shared tables below
        n_lookup = sum(1 for s in steps if s.method in LOOKUP_METHODS)
        eligible = n_lookup == 1 and not any(s.method == "binning" for s in steps)
        for si, spec in enumerate(steps):
            _apply_step(ch, spec, stats, f"{ci}_{si}", order_key, rows_per_bucket, pending if eligible else None)
        running = ch.df
        name = "target" if is_target else (
            f"{S.sanitize_column_name(column)}_{'_'.join(ch.suffixes)}" if ch.suffixes
            else S.sanitize_column_name(column))
        outputs.append((name, ch.expr))
        outputs.extend(ch.extra)
        lineage.append(_lineage(column, name, [s.raw_method for s in steps]))
    running = _resolve_pending(df, running, pending, rows_per_bucket)
    if target_column and include_target and target_column not in grouped:
        if target_column not in df.columns:
            raise ValueError(f"no column {target_column!r} to use as target")
        outputs.append(("target", auto_binary_target(col_of(target_column), df.schema[target_column].dataType)))
        lineage.append(_lineage(target_column, "target", [AUTO_TARGET]))
    keep = [col_of(k) for k in (keep_columns or [])]
    outputs = dedupe_names(outputs, keep_columns or [])
    result = running.select(*keep, *[c.alias(n) for n, c in outputs])
    return ChainResult(result, lineage, skipped)


def assert_no_nulls(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    """NULL count per output column in one pass (the reference promises, but does
    not check, NULL-free output)."""
    columns = columns or df.columns
    row = df.agg(*[F.count_if(col_of(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]).collect()[0]
    return {c: int(row[f"n{i}"]) for i, c in enumerate(columns) if row[f"n{i}"]}


def apply_and_write(df: DataFrame, raw_specs: list[dict], target_column: str | None, path: str,
                    mode: str = "overwrite", fmt: str = "parquet", **kw) -> ChainResult:
    """Build the chain and materialise it (the reference's CREATE OR REPLACE TABLE)."""
    res = build_chain(df, raw_specs, target_column, **kw)
    res.df.write.mode(mode).format(fmt).save(path)
    return res
