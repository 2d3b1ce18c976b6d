"""Merkle manifest against a plain tree."""
import hashlib
import zlib

from pyspark.sql import functions as F

from featurespark.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    told = [row[c] if c != "text" else text for c in merkle.FIELDS]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in told))


def plain_tree(nodes):
    """The top and, for each node, its siblings (left, right) level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, place in enumerate(at):
            first = place // 16 * 16
            paths[i].append(("".join(level[first:place]), "".join(level[place + 1:first + 16])))
            at[i] = place // 16
        level = [sha(*level[i:i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def plain_manifest(rows, tampered):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, above = plain_tree([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above):
        for (_, _, leaf, r), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            path = path + up
            h = leaf
            if tampered(r) and r["text"] is not None:
                h = plain_leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]))
            for left, right in path:
                h = sha(left, h, right)
            out.append((r["doc_id"], leaf, trees[s][0], root, sha(*(left + right for left, right in path)), h, h == root))
    return sorted(out, key=repr)


def bad(r):
    return r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0


def is_bad():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def compare(spark, docs):
    rows = [r.asDict() for r in docs.select(*merkle.FIELDS).collect()]
    got = merkle.manifest(docs, is_bad())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_manifest(rows, bad)


def test_odd_rows_and_empty_table(spark, odd, none):
    for name in ("key", "idx", "slot", "run", "path", "hash", "subroot", "root"):
        odd = odd.withColumn(name, F.lit(1))
    compare(spark, odd)
    assert merkle.manifest(none, is_bad()).collect() == []


def test_levels_and_a_source_with_most_rows(spark):
    rows = [(i, f"Text {i}", "en", "hot" if i % 3 else f"s{i % 40}", i) for i in range(900)] + [(5, "x", None, None, 1), (6, None, "en", "", 2)]
    compare(spark, spark.createDataFrame(rows, SCHEMA).repartition(7))


def test_one_row_and_full_runs(spark):
    compare(spark, spark.createDataFrame([(1, "A", None, "a", 1)], SCHEMA))
    compare(spark, spark.createDataFrame([(i, "A", None, "a", 1) for i in range(256)] + [(i, "B", None, "b", 1) for i in range(17)], SCHEMA))


def test_untampered_manifest_verifies(spark, odd):
    out = merkle.manifest(odd)
    assert out.where("verified").count() == odd.count()
