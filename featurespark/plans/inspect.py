"""Plan inspection: the properties this library is built to keep, read from a
DataFrame's executed plan (no job is run, no UI involved)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class PlanSummary:
    shuffles: int = 0
    broadcast_exchanges: int = 0
    broadcast_hash_joins: int = 0
    sort_merge_joins: int = 0
    nested_loop_joins: int = 0
    windows: int = 0
    single_partition_windows: int = 0
    scans: list = field(default_factory=list)      # (read schema, pushed filters) per Parquet scan


def plan_summary(df: DataFrame) -> PlanSummary:
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = text.splitlines()
    out = PlanSummary()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line or \
                "Exchange SinglePartition" in line or "Exchange RoundRobinPartitioning" in line:
            out.shuffles += 1
        if "BroadcastExchange" in line:
            out.broadcast_exchanges += 1
        if "BroadcastHashJoin" in line:
            out.broadcast_hash_joins += 1
        if "SortMergeJoin" in line:
            out.sort_merge_joins += 1
        if "NestedLoopJoin" in line:
            out.nested_loop_joins += 1
        if "Window [" in line:
            out.windows += 1
            if "SinglePartition" in " ".join(lines[i + 1:i + 4]):
                out.single_partition_windows += 1
        if "FileScan parquet" in line:
            schema = re.search(r"ReadSchema: struct<([^>]*)>", line)
            pushed = re.search(r"PushedFilters: \[([^\]]*)\]", line)
            out.scans.append((schema.group(1) if schema else "", pushed.group(1) if pushed else ""))
    return out
