"""Merkle manifest of a dataset: a tree of hashes for each source, and one over the sources.

The nodes of a level are consecutive in their tree. Fixed-offset lag and lead columns,
masked by the node's slot in its run and by the run's length, supply its siblings; the
first child of each run hashes it into the parent. A window holds one run, at most FANOUT
rows, so a source that has a third of all documents is spread like any other. Going down
again, each node takes its parent's path and puts its own siblings before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from featurespark.llm.ranks import numbered
from featurespark.llm.shared import stage

FANOUT = 16
#: the columns of a leaf, in the order in which they are hashed
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_hash(columns: dict[str, Column]) -> Column:
    """Hash of the fields: ``-`` for null, else the length in bytes, a colon and the value."""
    told = []
    for name in FIELDS:
        value = columns[name].cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(*told)


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (key, idx, n, hash, ...) with ``left`` and ``right``: the hashes of the run's
    other nodes on either side, joined."""
    placed = nodes.selectExpr("*", f"idx div {FANOUT} as run", f"idx % {FANOUT} as slot", f"least({FANOUT}, n - idx div {FANOUT} * {FANOUT}) as length")
    one = "over (partition by key, run order by idx)"
    before = [f"if(slot >= {k}, lag(hash, {k}) {one}, null)" for k in range(FANOUT - 1, 0, -1)]
    after = [f"if(slot + {k} < length, lead(hash, {k}) {one}, null)" for k in range(1, FANOUT)]
    return placed.selectExpr("*", f"concat_ws('', {', '.join(before)}) as left", f"concat_ws('', {', '.join(after)}) as right")


def parents(nodes: DataFrame) -> DataFrame:
    """The next level of the trees that have more than one node on this one."""
    first = with_siblings(nodes.where("n > 1").select("key", "idx", "n", "hash")).where("slot = 0")
    return first.select("key", F.col("run").alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n"), digest(F.col("hash"), F.col("right")).alias("hash"))


def climb(leaves: DataFrame) -> list[DataFrame]:
    """All levels, leaves first; a tree ends at the level where it has one node (n = 1)."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(stage(parents(levels[-1]), "merkle-level"))
        most = -(-most // FANOUT)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(key, hash): the one node that remains of each tree."""
    return reduce(DataFrame.unionByName, [level.where("n = 1").select("key", "hash") for level in levels])


def descend(levels: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """The leaves with ``path``, the siblings level by level up to the tree's top and on as
    ``seeds`` (key, path, ...) tell, and the other columns of ``seeds``."""
    carried = [c for c in seeds.columns if c not in ("key", "path")]
    above = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        here = level.where("n = 1").join(seeds, "key").select(*level.columns, "path", *carried)
        if above is not None:
            up = above.select(F.col("key").alias("up_key"), F.col("idx").alias("up_idx"), F.col("path").alias("up_path"), *carried)
            inner = with_siblings(level.where("n > 1")).join(up, (F.col("key") == F.col("up_key")) & (F.col("run") == F.col("up_idx")))
            step = F.array(F.struct("left", "right")).cast(STEP)
            here = here.unionByName(inner.select(*level.columns, F.concat(step, "up_path").alias("path"), *carried))
        above = stage(here.select("key", "idx", "path", *carried), "merkle-paths") if depth else here
    return above


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, leaf, subroot (of its source), root, proof_sha256
    (hash of all siblings up to the root), folded_root (from the document as it is where
    ``tampered`` holds, with A-Z of its text lower-cased, and the siblings of the untampered
    tree) and verified (folded_root is the root).

    A null field is hashed as such. Documents of a source ascend by doc_id, null first, then by
    leaf, so a repeated row is a leaf of its own; a null source is a source of its own, before
    all others, and the empty one comes next. A lone leaf is its source's subroot and a lone
    subroot the root. An empty table gives no rows; further columns are not read.
    """
    columns = {name: F.col(name) for name in FIELDS}
    lowered = dict(columns, text=F.translate(F.col("text"), UPPER, LOWER))
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf_hash(lowered)) if tampered is not None else F.lit(None).cast("string")
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(source.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(columns).alias("hash"), changed.alias("changed"))
    leaves = stage(numbered(rows, "key", [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("changed")], "merkle-leaves"), "merkle-level")
    levels = climb(leaves)
    subroots = tops(levels).select(F.lit("").alias("key"), F.col("key").alias("source"), "hash")
    above = climb(stage(numbered(subroots, "key", [F.col("source")], "merkle-sources"), "merkle-level"))
    root = tops(above).first()
    ends = docs.sparkSession.createDataFrame([("", [])], f"key string, path {STEP}")
    seeds = stage(descend(above, ends).select(F.col("source").alias("key"), F.col("hash").alias("subroot"), "path"), "merkle-subroots")
    found = descend(levels, seeds)
    folded = F.aggregate("path", F.coalesce("changed", "hash"), lambda h, step: digest(step["left"], h, step["right"]))
    others = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    root = F.lit(root["hash"] if root else None).cast("string")
    return found.select("doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), digest(others).alias("proof_sha256"),
                        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
