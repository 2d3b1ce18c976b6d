"""Physical-plan checks: no single-partition window over data rows, filters and
column pruning reach the Parquet scan, statistics are literals (no join)."""
import re

from featurespark.operators.transforms import apply_transforms
from featurespark.plans.chain import build_chain
from featurespark.plans.registered import CHAIN_FEATURE_SPECS, lineitem_nulls
from tests.conftest import SF01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chain_plan_has_no_single_partition(spark):
    res = build_chain(lineitem_nulls(spark, SF01), CHAIN_FEATURE_SPECS)
    plan = _plan(res.df)
    assert "SinglePartition" not in plan
    assert "BroadcastNestedLoopJoin" not in plan       # stats are literals, not a joined row


def test_ntile_plan_windows_are_partitioned(spark):
    df = spark.read.parquet(f"{SF01}/orders.parquet")
    res = apply_transforms(df, [{"column_name": "o_totalprice", "fe_method": "binning", "order_key": "o_orderkey"}],
                           rows_per_bucket=2000)
    plan = _plan(res.df)
    assert "SinglePartition" not in plan and "Window" not in plan


def test_filter_pushdown_and_pruning(spark):
    df = spark.read.parquet(f"{SF01}/lineitem.parquet").where("l_quantity > 10").select("l_quantity", "l_tax")
    res = apply_transforms(df, [{"column_name": "l_tax", "fe_method": "standardization"}], include_original=False)
    plan = res.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    read_schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(read_schema.split(",")) == {"l_quantity:double", "l_tax:double"}


# windows that rank per-column summary tables (one row per column), not data rows
SUMMARY_WINDOWS = {"chi2_ranking", "target_suggestion", "sorted_corr"}


def test_no_single_partition_window_over_data_rows(spark):
    from featurespark.plans.registered import QUERIES
    from tests.conftest import SF001
    offenders = []
    for name, fn in QUERIES.items():
        if name in SUMMARY_WINDOWS:
            continue
        df = fn(spark, SF001)
        df.write.format("noop").mode("overwrite").save()
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        for i, line in enumerate(lines):
            if "Window [" in line and "SinglePartition" in " ".join(lines[i + 1:i + 4]):
                offenders.append(name)
    assert offenders == []


def test_plan_summary_of_flagship(spark):
    from featurespark.plans.inspect import plan_summary
    from featurespark.plans.registered import QUERIES
    s = plan_summary(QUERIES["chain_features"](spark, SF01))
    assert s.single_partition_windows == 0 and s.nested_loop_joins == 0
    assert s.broadcast_hash_joins == 2                 # the two lookups, by their staged size
    assert all("l_shipdate" not in schema for schema, _ in s.scans)     # pruned


def test_three_frequency_encodings_scan_the_input_twice(spark):
    """Once to count, staged, and once for the output; the lookups read the staged counts."""
    df = spark.read.parquet(f"{SF01}/orders.parquet")
    out = apply_transforms(df, [{"column_name": c, "fe_method": "frequency_encoding"} for c in ("o_orderstatus", "o_orderpriority", "o_custkey")]).df
    out.write.format("noop").mode("overwrite").save()
    assert len(re.findall(r"Location: InMemoryFileIndex[^\n]*orders.parquet", out._jdf.queryExecution().executedPlan().toString())) <= 1


def test_chi2_scans_the_input_once(spark):
    from featurespark.operators.contingency import chi2_scores
    out = chi2_scores(spark.read.parquet(f"{SF01}/orders.parquet"), ["o_orderpriority"], "o_orderstatus")
    assert "orders.parquet" not in out._jdf.queryExecution().executedPlan().toString()      # all branches read the staged cells


def test_no_expand_over_columns(spark):
    from featurespark.operators import profile as P
    plan = P.cardinality(spark.read.parquet(f"{SF01}/orders.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
