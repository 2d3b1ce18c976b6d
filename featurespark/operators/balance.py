"""Class imbalance, rebalancing and group bias.

Random oversampling (B6) is exact and distributed:

* only minority-class rows are numbered 0..n-1 within their class, through the global row
  number (sort key = class, row hash), so no class is ever numbered inside one task;
* class counts and first positions are tables; the draws of a class are generated in blocks
  spread over all tasks, and draw j takes the row at md5(class, j, seed) mod n;
* draws meet rows in an equi-join on (class, index, salt).  A class whose rows are drawn more
  than DRAWS_PER_COPY times each has its rows copied under as many salts, and its draws are dealt
  over them, so a tiny class drawn millions of times is no hot key.

Majority rows (and all originals) pass straight from the scan to the union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_text, col_of, is_numeric, md5_int
from ..session import stage
from ..stats import present
from . import rank

#: draws that one task generates at a time
DRAW_BLOCK = 10_000
#: draws that meet one copy of a row, on average
DRAWS_PER_COPY = 1000


def _class_text(df: DataFrame, target: str) -> Column:
    return as_text(col_of(target), df.schema[target].dataType)


# ---------------------------------------------------------------------------
# B1–B3 class distribution, imbalance ratio, rare classes
# ---------------------------------------------------------------------------
def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class, count, share): NULL is a class of its own (before balancing)."""
    cnt = df.groupBy(_class_text(df, target).alias("class")).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    return with_total(cnt, "count", "share")


def with_total(df: DataFrame, count_col: str, share_col: str) -> DataFrame:
    """share = count / sum(count): the one-row total is broadcast back on a
    constant key (no single-partition window, no cross join)."""
    tot = df.agg(F.sum(count_col).alias("__tot")).withColumn("__one", F.lit(1))
    return (df.withColumn("__one", F.lit(1)).join(F.broadcast(tot), "__one")
            .withColumn(share_col, F.col(count_col) / F.col("__tot")).drop("__one", "__tot"))


def imbalance_summary(dist: DataFrame, rare_threshold: float = 0.05, floor_min_at_one: bool = False) -> DataFrame:
    """B2 + B3: (n_classes, max_count, min_count, imbalance_ratio, rare_classes)."""
    mn = F.greatest(F.min("count"), F.lit(1)) if floor_min_at_one else F.min("count")
    return dist.agg(F.count(F.lit(1)).cast("bigint").alias("n_classes"),
                    F.max("count").cast("bigint").alias("max_count"),
                    F.min("count").cast("bigint").alias("min_count"),
                    F.round(F.max("count") / mn, 2).alias("imbalance_ratio"),
                    F.count_if(F.col("share") < rare_threshold).cast("bigint").alias("rare_classes"))


# ---------------------------------------------------------------------------
# B4 quantile bins of a continuous target
# ---------------------------------------------------------------------------
def qcut_edges(df: DataFrame, target: str, q: int = 4) -> list[float]:
    """Interpolated quantile edges 0, 1/q, …, 1 with duplicates dropped."""
    from ..stats import StatsPlan
    ps = [i / q for i in range(q + 1)]
    plan = StatsPlan()
    for p in ps:
        plan.need_q(target, p)
    st = plan.fit(df)
    vals = [st.q(target, p) for p in ps]
    if any(v is None for v in vals):
        return []
    edges = []
    for e in vals:
        if not edges or e != edges[-1]:
            edges.append(float(e))
    return edges


def qcut_bin(x: Column, edges: list[float]) -> Column:
    """Right-closed bins, lowest edge included; bin = 1 + #{inner edges < x}."""
    if len(edges) < 2:
        return F.lit(None).cast("bigint")
    b = F.lit(1)
    for e in edges[1:-1]:
        b = b + F.when(x > F.lit(e), 1).otherwise(0)
    inside = (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1]))
    return F.when(inside, b).cast("bigint")


def qcut_distribution(df: DataFrame, target: str, q: int = 4, edges: list[float] | None = None) -> DataFrame:
    """(bin, lower, upper, count) of the continuous target (pandas.qcut semantics)."""
    edges = edges if edges is not None else qcut_edges(df, target, q)
    spark = df.sparkSession
    if len(edges) < 2:
        return spark.createDataFrame([], "bin bigint, lower double, upper double, count bigint")
    counts = (df.select(qcut_bin(col_of(target).cast("double"), edges).alias("bin"))
              .where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).cast("bigint").alias("count")))
    bounds = spark.createDataFrame([(i + 1, edges[i], edges[i + 1]) for i in range(len(edges) - 1)],
                                   "bin bigint, lower double, upper double")
    return bounds.join(counts, "bin").select("bin", "lower", "upper", "count")


# ---------------------------------------------------------------------------
# B5 prepare rows
# ---------------------------------------------------------------------------
def prepare_rows(df: DataFrame, target: str, quantiles: str | None = None) -> DataFrame:
    """Drop rows whose target is missing (NULL or NaN); fill features: boolean → False,
    numeric → median (NaN is missing), other → 'missing' (text). Medians of all numeric
    columns in one aggregate."""
    from ..stats import StatsPlan
    base = df.where(present(df, target).isNotNull())
    nums = [f.name for f in df.schema.fields if f.name != target and is_numeric(f.dataType)]
    plan = StatsPlan(quantile_method=quantiles)
    for c in nums:
        plan.need_q(c, 0.5)
    stats = plan.fit(base) if nums else None
    cols = []
    for f in df.schema.fields:
        c = col_of(f.name)
        if f.name == target:
            cols.append(c)
        elif isinstance(f.dataType, T.BooleanType):
            cols.append(F.coalesce(c, F.lit(False)).alias(f.name))
        elif is_numeric(f.dataType):
            med = stats.q(f.name, 0.5)
            c = present(df, f.name)
            cols.append((F.coalesce(c, F.lit(med).cast(f.dataType)) if med is not None else c).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(F.coalesce(c, F.lit("missing")).alias(f.name))
        else:
            cols.append(c)
    return base.select(*cols)


# ---------------------------------------------------------------------------
# B6 random oversampling, B7 shuffle
# ---------------------------------------------------------------------------
def random_oversample(df: DataFrame, target: str, seed: int = 42, order_key: str | None = None,
                      rows_per_bucket: int = rank.DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Every class raised to the majority count by draws with replacement; all
    original rows kept; NULL-target rows dropped.  Deterministic for a seed: draw j of
    class c copies the row at position md5(c, j, seed) mod its size, in the order of
    ``order_key`` (default: a hash of the row).

    Class counts and first positions are tables, so the plan has one size for two or a
    million classes."""
    base = df.where(present(df, target).isNotNull())
    classes = stage(base.groupBy(_class_text(base, target).alias("cls")).agg(F.count(F.lit(1)).alias("n")), "classes")
    most = classes.agg(F.max("n")).first()[0] or 0
    need = F.lit(most) - F.col("n")
    copies = F.ceil(need / (F.col("n") * F.lit(DRAWS_PER_COPY))).cast("int")
    minority = classes.where(F.col("n") < most).withColumn("need", need).withColumn("copies", copies)
    n_min = minority.agg(F.sum("n")).first()[0] or 0
    if not n_min:
        return base
    # minority rows, numbered 0..n-1 inside their class; a row travels as one struct, so that
    # its names cannot meet those used here
    names = [col_of(c) for c in df.columns]
    tie = col_of(order_key) if order_key else F.xxhash64(*names)
    tagged = base.select(F.struct(*names).alias("row"), _class_text(base, target).alias("cls"), tie.alias("tie")).join(
        minority.select("cls"), "cls", "left_semi")
    ranked = rank.global_row_number(tagged, [rank.SortKey("cls"), rank.SortKey("tie")], n_min, "at", rows_per_bucket)
    first = ranked.groupBy("cls").agg(F.min("at").alias("first")).join(minority.select("cls", "copies"), "cls")
    indexed = ranked.join(first, "cls").select("cls", (F.col("at") - F.col("first")).alias("idx"), "row",
                                               F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    # draws: blocks of a class first, then the draws of each block
    blocks = minority.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("need") - 1) / DRAW_BLOCK))))
    draws = blocks.repartition("cls", "block").withColumn(
        "j", F.explode(F.sequence(F.col("block") * DRAW_BLOCK, F.least("need", (F.col("block") + 1) * DRAW_BLOCK) - 1)))
    draws = draws.select("cls", F.pmod(md5_int(F.col("cls"), F.col("j"), F.lit(seed)), F.col("n")).alias("idx"),
                         F.pmod(F.col("j"), F.col("copies")).cast("int").alias("salt"))
    return base.unionByName(draws.join(indexed, ["cls", "idx", "salt"]).select("row.*"))


def shuffle_rows(df: DataFrame, seed: int = 42) -> DataFrame:
    """B7 (optional): deterministic random order = range-partitioned sort on a row hash."""
    return df.orderBy(row_draw(df, seed))


def row_draw(df: DataFrame, seed: int) -> Column:
    return md5_int(*[F.coalesce(as_text(col_of(c), df.schema[c].dataType), F.lit("")) for c in df.columns], F.lit(seed))


# ---------------------------------------------------------------------------
# B8 SMOTER gate
# ---------------------------------------------------------------------------
def smoter_gate_frame(df: DataFrame, target: str, min_distinct: int = 10, min_abs_skew: float = 0.5) -> DataFrame:
    """One row (apply, distinct, skewness): numeric target with ≥ min_distinct
    distinct values and |adjusted skewness| ≥ min_abs_skew (one aggregate); NaN is
    missing and does not open the gate."""
    y = present(df, target).cast("double")
    n = F.count(y).cast("double")
    adj = F.when(n > 2, F.skewness(y) * F.sqrt(n * (n - 1)) / (n - 2))
    one = df.agg(F.count_distinct(y).alias("distinct"), adj.alias("skewness"))
    numeric = is_numeric(df.schema[target].dataType) and not isinstance(df.schema[target].dataType, T.BooleanType)
    skew = F.when(~F.isnan("skewness"), F.abs(F.col("skewness")))        # infinite values leave none
    ok = (F.col("distinct") >= min_distinct) & F.coalesce(skew >= min_abs_skew, F.lit(False))
    return one.select((ok & F.lit(numeric)).alias("apply"), F.col("distinct").cast("bigint").alias("distinct"),
                      "skewness")


def smoter_gate(df: DataFrame, target: str, min_distinct: int = 10, min_abs_skew: float = 0.5) -> dict:
    if not is_numeric(df.schema[target].dataType):
        return {"apply": False, "reason": "target is not numeric"}
    r = smoter_gate_frame(df, target, min_distinct, min_abs_skew).collect()[0]
    return {"apply": bool(r["apply"]), "distinct": r["distinct"], "skewness": r["skewness"],
            "reason": "ok" if r["apply"] else "target has no rare/extreme regions"}


# ---------------------------------------------------------------------------
# B10 post-balance report, B13 imbalance analysis record
# ---------------------------------------------------------------------------
def balance_report(df: DataFrame, target: str, target_type: str = "categorical", q: int = 4,
                   balanced_threshold: float = 1.2) -> DataFrame:
    """(target_column, target_type, n_classes, imbalance_ratio, balance_status)
    after balancing; continuous targets are measured on q quantile bins."""
    if target_type == "categorical":
        dist = class_distribution(df.where(col_of(target).isNotNull()), target)
    else:
        dist = qcut_distribution(df, target, q).withColumn("share", F.lit(None).cast("double"))
    s = imbalance_summary(dist, floor_min_at_one=True)
    return s.select(F.lit(target).alias("target_column"), F.lit(target_type).alias("target_type"), "n_classes",
                    "imbalance_ratio",
                    F.when(F.col("imbalance_ratio") <= balanced_threshold, "Balanced").otherwise("Imbalanced")
                    .alias("balance_status"))


def infer_target_type(df: DataFrame, target: str, max_classes: int = 20) -> str:
    if not is_numeric(df.schema[target].dataType):
        return "categorical"
    some = df.select(col_of(target)).where(col_of(target).isNotNull()).distinct().limit(max_classes + 1).count()
    return "categorical" if some <= max_classes else "continuous"


def severity(ratio: Column, bands=(1.2, 3.0, 10.0)) -> Column:
    return (F.when(ratio <= bands[0], "none").when(ratio <= bands[1], "mild")
            .when(ratio <= bands[2], "moderate").otherwise("severe"))


def imbalance_analysis(df: DataFrame, target: str, target_type: str | None = None, q: int = 4,
                       bands=(1.2, 3.0, 10.0)) -> DataFrame:
    """Majority / minority class, ratio (≥ 1), is_imbalanced, severity and
    the method to use (categorical → random oversampling, continuous → SMOTER)."""
    tt = target_type or infer_target_type(df, target)
    if tt == "categorical":
        dist = class_distribution(df.where(col_of(target).isNotNull()), target)
    else:
        dist = qcut_distribution(df, target, q).select(
            F.format_string("(%s, %s]", F.col("lower"), F.col("upper")).alias("class"), "count")
    agg = dist.agg(F.max_by("class", F.struct(F.col("count"), F.col("class"))).alias("majority_class"),
                   F.max("count").cast("bigint").alias("majority_count"),
                   F.min_by("class", F.struct(F.col("count"), F.col("class"))).alias("minority_class"),
                   F.min("count").cast("bigint").alias("minority_count"))
    ratio = F.round(F.col("majority_count") / F.greatest(F.col("minority_count"), F.lit(1)), 2)
    return agg.select(F.lit(target).alias("target_column"), F.lit(tt).alias("target_type"),
                      "majority_class", "majority_count", "minority_class", "minority_count",
                      ratio.alias("imbalance_ratio"), (ratio > F.lit(bands[0])).alias("is_imbalanced"),
                      severity(ratio, bands).alias("severity"),
                      F.lit("random_oversampling" if tt == "categorical" else "smoter").alias("recommended_method"))


# ---------------------------------------------------------------------------
# B14 bias detection
# ---------------------------------------------------------------------------
# FIXED VALUES (reference's sensitive-feature kinds, plus close synonyms of ours)
SENSITIVE_HINTS = ["gender", "sex", "region", "country", "nation", "age", "race", "ethnicity", "religion"]


def sensitive_columns(df: DataFrame) -> list[str]:
    out = []
    for c in df.columns:
        lc = c.lower()
        if any(lc == h or lc.endswith("_" + h) or lc.startswith(h + "_") for h in SENSITIVE_HINTS):
            out.append(c)
    return out


def group_outcomes(df: DataFrame, target: str, features: list[str] | None = None, positive=None,
                   numeric_bins: int = 4) -> DataFrame:
    """(feature, group, n, share, outcome): share of rows and mean outcome per
    group of each sensitive feature.  Outcome = mean target (numeric / boolean),
    or rate of ``positive`` when given.  Numeric features are grouped in
    quantile bins."""
    feats = features if features is not None else sensitive_columns(df)
    feats = [f for f in feats if f != target]
    y = col_of(target)
    ydt = df.schema[target].dataType
    if positive is not None:
        outcome = (as_text(y, ydt) == F.lit(str(positive))).cast("double")
    elif isinstance(ydt, T.BooleanType):
        outcome = y.cast("double")
    else:
        outcome = y.cast("double")
    groups = []
    for f in feats:
        dt = df.schema[f].dataType
        if is_numeric(dt) and not isinstance(dt, T.BooleanType):
            edges = qcut_edges(df, f, numeric_bins)
            g = F.concat(F.lit("q"), qcut_bin(col_of(f).cast("double"), edges).cast("string"))
        else:
            g = as_text(col_of(f), dt)
        groups.append(F.struct(F.lit(f).alias("feature"), g.alias("group")))
    if not groups:
        return df.sparkSession.createDataFrame([], "feature string, group string, n bigint, share double, "
                                                   "outcome double")
    long = df.select(F.inline(F.array(*groups)), outcome.alias("__y"))
    per = long.groupBy("feature", "group").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                                F.avg("__y").alias("outcome"))
    per = stage(per, "groups")
    total = per.groupBy("feature").agg(F.sum("n").alias("__total"))        # one row per feature
    return (per.join(F.broadcast(total), "feature").withColumn("share", F.col("n") / F.col("__total"))
            .select("feature", "group", "n", "share", "outcome"))


def bias_report(outcomes: DataFrame, di_high: float = 0.8, di_medium: float = 0.9,
                rep_high: float = 10.0, rep_medium: float = 3.0) -> DataFrame:
    """(feature, bias_type, risk, evidence) per feature and kind of bias, plus one
    explicit 'no significant bias' row when nothing is flagged.  Outcome bias
    uses the four-fifths rule on min/max group outcome (ours)."""
    per = outcomes.where(F.col("group").isNotNull()).groupBy("feature").agg(
        F.min("outcome").alias("omin"), F.max("outcome").alias("omax"),
        F.min("share").alias("smin"), F.max("share").alias("smax"),
        F.min_by("group", F.struct("outcome", "group")).alias("g_lo"), F.max_by("group", F.struct("outcome", "group")).alias("g_hi"))
    di = F.when(F.col("omax") > 0, F.col("omin") / F.col("omax"))
    rep = F.col("smax") / F.col("smin")
    outcome_rows = per.select(
        "feature", F.lit("outcome").alias("bias_type"),
        F.when(di < di_high, "high").when(di < di_medium, "medium").otherwise("low").alias("risk"),
        F.format_string("outcome ratio %.3f (group %s vs %s)", F.coalesce(di, F.lit(1.0)), F.col("g_lo"),
                        F.col("g_hi")).alias("evidence"))
    rep_rows = per.select(
        "feature", F.lit("representation").alias("bias_type"),
        F.when(rep > rep_high, "high").when(rep > rep_medium, "medium").otherwise("low").alias("risk"),
        F.format_string("largest/smallest group share %.3f", rep).alias("evidence"))
    flagged = outcome_rows.unionByName(rep_rows).where(F.col("risk") != "low")
    none_row = (flagged.agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == 0)
                .select(F.lit(None).cast("string").alias("feature"), F.lit("none").alias("bias_type"),
                        F.lit("low").alias("risk"), F.lit("no significant bias").alias("evidence")))
    return flagged.unionByName(none_row)


# ---------------------------------------------------------------------------
# the balancing service as one call
# ---------------------------------------------------------------------------
def balance_table(df: DataFrame, target: str, target_type: str = "categorical", rare_threshold: float = 0.05,
                  keep_original: bool = False, seed: int = 42, q: int = 4, preview_rows: int = 100) -> dict:
    """Pre-balance analysis (B1–B4), balancing (B5 + B6 or B8/B9), post-balance
    report (B10) and a preview.  Returns named results; the balanced table is
    the full DataFrame (the reference only returns its first 100 rows)."""
    from .smoter import smoter
    if target not in df.columns:
        raise ValueError(f"no column {target!r} to balance")
    if target_type == "categorical":
        dist = class_distribution(df, target)
    else:
        edges = qcut_edges(df, target, q)
        dist = with_total(qcut_distribution(df, target, q, edges).withColumnRenamed("bin", "class"), "count", "share")
    pre = imbalance_summary(dist, rare_threshold)
    info = {}
    if keep_original:
        balanced = df
    else:
        prepared = prepare_rows(df, target)
        if target_type == "categorical":
            balanced = random_oversample(prepared, target, seed=seed)
        else:
            balanced, info = smoter(prepared, target, seed=seed)
    post = balance_report(balanced, target, target_type, q)
    from .profile import preview
    return {"pre_distribution": dist, "pre_summary": pre, "balanced": balanced, "post_summary": post,
            "preview": preview(balanced, preview_rows), "smoter": info}
