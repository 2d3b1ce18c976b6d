"""SMOTER: over-sampling for a continuous target (B9), after the B8 gate.

Built from the published method (Torgo et al. 2013, SMOTE for regression;
Branco et al. 2017, SMOGN) as Spark jobs:

1. relevance φ(y) from the box plot of y: 0 at the median, 1 at and beyond
   the whiskers (q1 − 1.5·IQR, q3 + 1.5·IQR, clipped to the data range), joined
   by the monotone cubic Hermite curve with flat ends (3t² − 2t³);
2. rows with φ ≥ ``rel_threshold`` form the low and high rare bumps;
3. the neighbours of a row are the k nearest of its bump in feature space (numeric
   features scaled to [0, 1], ties to the lower target), found by
   :mod:`.neighbours`: exactly on request, else with a measured recall;
4. the synthetic rows a bump needs to reach the balanced size (n / bumps) are
   generated by ``spark.range`` (spread over all tasks); synthetic j takes seed
   position (j mod size) + 1, neighbour choice and gap u ∈ [0, 1) from
   md5(bump, j, seed); numeric features and y are interpolated
   seed + u·(neighbour − seed), other features come from seed or neighbour; the
   ``order_key`` identifies original rows only and is NULL in synthetic ones;
5. originals are all kept (``under_sample=True`` samples the normal bump down
   to the balanced size by hash rank, as SMOGN's balance mode does).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col_of, is_numeric, md5_int
from ..session import stage
from ..stats import StatsPlan, present
from . import neighbours, rank
from .balance import smoter_gate

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def relevance(y: Column, median: float, lower: float, upper: float) -> Column:
    """φ(y) ∈ [0, 1]: 0 at the median, 1 at/after the whiskers, smooth in between."""
    def side(t):
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.lit(3.0) * t * t - F.lit(2.0) * t * t * t
    hi = side((y - F.lit(median)) / F.lit(upper - median)) if upper > median else F.lit(0.0)
    lo = side((F.lit(median) - y) / F.lit(median - lower)) if median > lower else F.lit(0.0)
    return F.when(y >= F.lit(median), hi).otherwise(lo)


def _scaled(x: Column, low, high) -> Column:
    """A feature on [0, 1]; a missing value in the middle, a constant feature at 0."""
    if low is None or high is None or float(low) == float(high):
        return F.lit(0.0)
    return F.coalesce((x.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low)), F.lit(0.5))


def smoter(df: DataFrame, target: str, k: int = 5, rel_threshold: float = 0.5, seed: int = 42,
           under_sample: bool = False, order_key: str | None = None, features: list[str] | None = None,
           exact: bool = False, rows_per_bucket: int = rank.DEFAULT_ROWS_PER_BUCKET, quantiles: str | None = None):
    """Returns (DataFrame, info dict).  Data are returned unchanged when the gate
    refuses or no rare bump exists.  ``features`` (default: all numeric columns but the
    target and ``order_key``) span the neighbour space; ``order_key`` breaks ties
    (default: a hash of the row) and is NULL in synthetic rows.  ``exact`` asks for the true
    neighbours; else about 95 % of them are found, measured on a sample.  Rows without a
    target (NULL or NaN) are dropped."""
    gate = smoter_gate(df, target)
    info = {"gate": gate}
    if not gate["apply"]:
        return df, info
    base = df.where(present(df, target).isNotNull())
    plan = StatsPlan(quantile_method=quantiles)
    for q in (0.25, 0.5, 0.75):
        plan.need_q(target, q)
    if features is None:
        features = [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in (target, order_key)]
    for c in [target, *features]:
        plan.need("min", c), plan.need("max", c)
    st = plan.fit(base)
    q1, med, q3 = (float(st.q(target, p)) for p in (0.25, 0.5, 0.75))
    ymin, ymax = float(st[("min", target)]), float(st[("max", target)])
    iqr = q3 - q1
    lower, upper = max(ymin, q1 - 1.5 * iqr), min(ymax, q3 + 1.5 * iqr)
    y = col_of(target).cast("double")
    phi = relevance(y, med, lower, upper)
    bump = F.when(phi >= F.lit(rel_threshold), F.when(y < F.lit(med), "low").otherwise("high")).otherwise("normal")
    cols = df.columns
    tie = col_of(order_key) if order_key else F.xxhash64(*[col_of(c) for c in cols])
    scaled = [_scaled(present(df, c), st[("min", c)], st[("max", c)]) for c in features] or [F.lit(0.0)]
    # a data row travels as one struct, so its names cannot meet those used here
    tagged = base.select(F.struct(*[col_of(c) for c in cols]).alias("row"), bump.alias("grp"), y.alias("y"), tie.alias("tie"),
                         F.array(*scaled).cast("array<double>").alias("z"))
    sizes = {r["grp"]: r["n"] for r in tagged.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes.values())
    bumps = [b for b in ("low", "normal", "high") if sizes.get(b)]
    rare = [b for b in ("low", "high") if sizes.get(b)]
    info.update({"sizes": sizes, "relevance_points": (lower, med, upper)})
    if not rare:
        return df, info
    goal = n // len(bumps)
    need = [(b, goal - sizes[b], sizes[b]) for b in rare if goal > sizes[b]]
    info["synthetic"] = {b: d for b, d, _ in need}
    spark = df.sparkSession
    kept = base
    if under_sample and sizes.get("normal", 0) > goal:
        normal = tagged.where("grp = 'normal'").select("row", "tie")
        ranked_n = rank.global_row_number(normal, [rank.SortKey("tie")], sizes["normal"], "at", rows_per_bucket)
        kept = tagged.where("grp <> 'normal'").select("row.*").unionByName(ranked_n.where(F.col("at") <= goal).select("row.*"))
    if not need:
        return kept, info

    # positions inside each rare bump, in target order
    names = F.array(*[F.lit(b) for b in rare])
    sorted_rare = sorted(rare)
    start = F.create_map(*[x for i, b in enumerate(sorted_rare) for x in (F.lit(b), F.lit(sum(sizes[a] for a in sorted_rare[:i])))])
    numbered = rank.global_row_number(tagged.where(F.array_contains(names, F.col("grp"))), [rank.SortKey("grp"), rank.SortKey("y"), rank.SortKey("tie")],
                                      sum(sizes[b] for b in rare), "at", rows_per_bucket)
    pos = stage(numbered.withColumn("pos", F.col("at") - F.element_at(start, F.col("grp"))).select("grp", "pos", "z", "row"), "bumps")
    nbrs = stage(neighbours.nearest(pos.select("grp", F.col("pos").alias("id"), "z"), k, exact).select(
        "grp", F.col("id").alias("pos"), "m", F.col("other").alias("npos")), "neighbours")
    n_nb = nbrs.groupBy("grp", "pos").agg(F.max("m").alias("k"))

    # synthetic ids, spread over all tasks
    firsts, acc = [], 0
    for _, d, _ in need:
        firsts.append(acc)
        acc += d
    total = acc

    def pick(idx):
        def build(lo, hi):
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi + 1) // 2
            return F.when(idx < F.lit(firsts[mid]), build(lo, mid - 1)).otherwise(build(mid, hi))
        return build(0, len(firsts) - 1)

    draw = lambda i: md5_int(F.col("grp"), F.col("j"), F.lit(seed), F.lit(i))
    names = F.array(*[F.lit(b) for b, _, _ in need])
    szs = F.array(*[F.lit(s) for _, _, s in need])
    fst = F.array(*[F.lit(f) for f in firsts])
    ids = (spark.range(0, total, numPartitions=max(1, spark.sparkContext.defaultParallelism))
           .withColumn("i", pick(F.col("id")))
           .withColumn("grp", F.element_at(names, F.col("i") + 1))
           .withColumn("j", F.col("id") - F.element_at(fst, F.col("i") + 1))
           .withColumn("pos", F.pmod(F.col("j"), F.element_at(szs, F.col("i") + 1)) + 1)
           .withColumn("r1", draw(1)).withColumn("u", F.pmod(draw(2), F.lit(1_000_000)) / F.lit(1_000_000.0))
           .withColumn("side", F.pmod(draw(3), F.lit(2)))
           .select("grp", "pos", "r1", "u", "side"))
    # all sides grow with the data: Spark plans the joins from their sizes
    ids = (ids.join(n_nb, ["grp", "pos"])
           .withColumn("m", (F.pmod(F.col("r1"), F.col("k")) + 1).cast("int"))
           .join(nbrs, ["grp", "pos", "m"]))
    joined = (ids.join(pos.select("grp", "pos", F.col("row").alias("s")), ["grp", "pos"])
              .join(pos.select("grp", F.col("pos").alias("npos"), F.col("row").alias("o")), ["grp", "npos"]))
    u = F.col("u")
    out_cols = []
    for f in df.schema.fields:
        s, nb = F.col("s").getField(f.name), F.col("o").getField(f.name)
        if f.name == order_key:
            out_cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif is_numeric(f.dataType) and not isinstance(f.dataType, T.BooleanType):
            v = s.cast("double") + u * (nb.cast("double") - s.cast("double"))
            if isinstance(f.dataType, _INTEGRAL):
                v = F.round(v)
            out_cols.append(v.cast(f.dataType).alias(f.name))
        else:
            out_cols.append(F.when(F.col("side") == 0, s).otherwise(nb).alias(f.name))
    return kept.unionByName(joined.select(*out_cols)), info
