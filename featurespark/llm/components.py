"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featurespark.llm.shared import stage

#: parts of a hot label
SALTS = 16


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of ``edges`` (a, b).

    Every round takes the least label of the neighbours, then the label of that
    label, so long chains halve; the rounds stop when no label changes. Edge lists
    and labels stay distributed tables, staged each round. A label that many nodes have
    is looked up in ``SALTS`` parts; a node of very many edges is one key, so callers
    give trees of few edges a node where they can.
    """
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
                .select(F.col("a").alias("of"), "near"))
        hooked = stage(labels.join(near, F.col("node") == F.col("of")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "labels")
        up = hooked.select(F.col("label").alias("up")).distinct().join(hooked.select("node", F.col("label").alias("upper")), F.col("up") == F.col("node"))
        up = up.select("up", "upper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
        jumped = stage(hooked.join(up, (F.col("label") == F.col("up")) & (salt == F.col("part"))).select("node", F.col("upper").alias("label"), "was"), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> was").isEmpty():
            return labels
