"""Divergence of the sources of each language over a vocabulary of frequent terms.

The kept terms of a language, sorted, become minimal acyclic transducers with lexicographic
ordinals; the texts stream through them once more, and ordinals stand for terms from then on,
also where ranks are tied. Transducers hold SHARD_TERMS terms each and go out to the tasks in
blocks of at most BLOCK_BYTES, one block at a time.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from featurespark.llm.ranks import numbered
from featurespark.llm.shared import stage
from featurespark.llm.transducer import Transducer
from featurespark.llm.words import slices, utf8

#: a kept term occurs in so many documents of its language
LEAST_DOCS = 30
#: ranks of the terms of a group that are reported
TOP_TERMS = 50
#: terms of one transducer, and bytes of the transducers that are broadcast at a time
SHARD_TERMS, BLOCK_BYTES = 20_000, 64_000_000
#: sources and terms that one comparison task holds
TILE_SOURCES, TILE_TERMS = 32, 4096
#: bytes of text that are counted at a time in a task, and rows of counts that it adds up before they leave
SLICE, HELD_ROWS = 4_000_000, 1_000_000

_in_term = np.zeros(256, bool)
_in_term[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def terms_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with A-Z lower-cased, the start and end of each term in them, and
    the number of its text."""
    data, offsets = utf8(column)
    inside = _in_term[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = np.unique(offsets[1:-1])
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(first)
    return _lower[data], starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def plain(docs: DataFrame) -> DataFrame:
    """(lang, source, text) with null as empty."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _numbers(batch: pa.RecordBatch, *names: str) -> tuple[pa.RecordBatch, np.ndarray]:
    """The distinct values of the columns, and which one each row has."""
    rows = pd.MultiIndex.from_arrays([batch.column(n).to_pandas() for n in names]) if len(names) > 1 else batch.column(names[0]).to_pandas()
    codes, distinct = pd.factorize(rows)
    return [tuple(d) if len(names) > 1 else d for d in distinct], codes.astype(np.int64)


def _words(column) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """The distinct terms of all texts, which one each term is, and the number of its text."""
    data, starts, ends, doc = terms_of(column)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[_in_term[data]])).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), doc


def _added(parts, value: str):
    """The rows of a task's tables of counts, those equal in all but ``value`` added up: a term
    leaves once for the slices whose counts fit HELD_ROWS, not once for each slice."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows > HELD_ROWS:
            held = [_merged(held, value)]
            rows = held[0].num_rows
            if rows > HELD_ROWS // 2:
                yield held[0]
                held, rows = [], 0
    if rows:
        yield _merged(held, value)


def _merged(held: list[pa.Table], value: str) -> pa.Table:
    names = held[0].column_names
    sums = pa.concat_tables(held).group_by([n for n in names if n != value], use_threads=False).aggregate([(value, "sum")])
    return sums.rename_columns([value if n == value + "_sum" else n for n in sums.column_names]).select(names)


def document_counts(texts: DataFrame) -> DataFrame:
    """(lang, term, docs): the number of texts of the language that have the term."""

    def count(batches):
        known: dict[str, int] = {}

        def parts():
            for batch in (part for whole in batches for part in slices(whole, 2, SLICE)):
                langs, lang = _numbers(batch, "lang")
                words, codes, doc = _words(batch.column(2))
                n = max(1, len(words))
                once = np.unique(doc * n + codes)
                pairs, docs = np.unique(lang[once // n] * n + once % n, return_counts=True)
                place = np.array([known.setdefault(x, len(known)) for x in langs], np.int64)
                yield pa.table({"lang": place[pairs // n], "term": words.take(pa.array(pairs % n)), "docs": docs})

        for sums in _added(parts(), "docs"):
            yield from pa.table([pa.array(list(known), pa.string()).take(sums["lang"]), sums["term"].cast(pa.string()), sums["docs"]],
                                ["lang", "term", "docs"]).to_batches()

    return texts.mapInArrow(count, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def vocabulary(texts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, idx, n): the kept terms with their ordinal in byte order, and their number."""
    kept = document_counts(texts).where(F.col("docs") >= least_docs).select("lang", "term")
    return stage(numbered(kept, "lang", [F.col("term")], "divergence-terms"), "divergence-vocabulary")


def transducers(words: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, first, size, blob): a transducer for every ``shard_terms`` consecutive terms."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        machine = Transducer.build([t.encode() for t in rows["term"]])
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "first": [rows["idx"].iloc[0]], "size": [machine.nbytes], "blob": [machine.to_bytes()]})

    return words.withColumn("shard", F.floor(F.col("idx") / shard_terms)).groupBy("lang", "shard").applyInPandas(
        build, "lang string, first long, size long, blob binary")


@functools.lru_cache(maxsize=1)
def _machines(block: tuple) -> dict:
    found: dict[str, list] = {}
    for lang, first, blob in block:
        found.setdefault(lang, []).append((first, Transducer.from_bytes(blob)))
    return found


def _recount(texts: DataFrame, block: list[tuple]) -> DataFrame:
    """(lang, source, idx, count) of the terms of one block of transducers."""
    held = texts.sparkSession.sparkContext.broadcast(tuple(block))

    def count(batches):
        machines, known = _machines(held.value), {}

        def parts():
            for batch in (part for whole in batches for part in slices(whole, 2, SLICE)):
                groups, group = _numbers(batch, "lang", "source")
                words, codes, doc = _words(batch.column(2))
                n = max(1, len(words))
                pairs, times = np.unique(group[doc] * n + codes, return_counts=True)
                of, word = pairs // n, pairs % n
                # each distinct term of a language goes through its transducers once
                data, offsets = utf8(words)
                place = np.array([known.setdefault(g, len(known)) for g in groups], np.int64)
                for lang in {g[0] for g in groups}:
                    mine = np.flatnonzero(np.array([g[0] == lang for g in groups])[of])
                    asked, which = np.unique(word[mine], return_inverse=True)
                    for first, machine in machines.get(lang, ()):
                        found = machine.ordinals(data, offsets[asked], offsets[asked + 1])[which]
                        hit = found >= 0
                        yield pa.table({"group": place[of[mine][hit]], "idx": found[hit] + first, "count": times[mine][hit]})

        for sums in _added(parts(), "count"):
            langs, sources = (pa.array([g[i] for g in known], pa.string()).take(sums["group"]) for i in (0, 1))
            yield from pa.table([langs, sources, sums["idx"], sums["count"]], ["lang", "source", "idx", "count"]).to_batches()

    langs = sorted({lang for lang, _, _ in block})
    return texts.where(F.col("lang").isin(langs)).mapInArrow(count, "lang string, source string, idx long, count long")


def recounted(texts: DataFrame, words: DataFrame, shard_terms: int = SHARD_TERMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, idx, count): occurrences of each kept term in each source where it has
    any. One pass over the texts for each block of transducers."""
    counts, block, size = None, [], 0

    def run(block, counts):
        new = stage(_recount(texts, block).groupBy("lang", "source", "idx").agg(F.sum("count").alias("count")), "divergence-counts")
        return new if counts is None else counts.unionByName(new)

    for row in stage(transducers(words, shard_terms), "divergence-transducers").toLocalIterator():
        if block and size + row["size"] > block_bytes:
            counts, block, size = run(block, counts), [], 0
        block.append((row["lang"], row["first"], bytes(row["blob"])))
        size += row["size"]
    if block or counts is None:
        counts = run(block, counts)
    return counts


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact; null without terms."""
    return (F.expr(f"(1000000000BD * (cast({count} as decimal(19, 0)) + 5)) div nullif(cast({total} as decimal(20, 0)) + 5 * cast({terms} as decimal(18, 0)), 0)") + 1).cast("long")


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language: the absolute
    differences of their shares, summed over all kept terms. Sources are dealt to tiles and
    terms to blocks; a task compares two tiles over one block, whatever the language's size."""
    tiles = F.ceil(F.count("*").over(Window.partitionBy("lang")) / TILE_SOURCES).cast("int")
    dealt = stage(groups.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")), "divergence-tiles")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    both = [F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b")]
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("terms") / TILE_TERMS) - 1))).alias("block")
    sides = dealt.select("lang", "source", "tile", "none", "terms", "tiles", blocks).select("*", other).select("lang", "source", "tile", "none", "terms", "block", *both)
    cells = counts.join(dealt.select("lang", "source", "tile", "tiles"), ["lang", "source"]).select("*", other).select(
        "lang", "source", "idx", "p", F.floor(F.col("idx") / TILE_TERMS).alias("block"), *both)

    def compare(key, cells: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        lang, block, a, b = key
        names = sides["source"].tolist()
        width = int(min(TILE_TERMS, sides["terms"].iloc[0] - block * TILE_TERMS))
        p = np.repeat(sides["none"].fillna(0).to_numpy(np.int64)[:, None], width, 1)
        if len(cells):
            row = pd.Index(names).get_indexer(cells["source"])
            p[row, cells["idx"].to_numpy(np.int64) - block * TILE_TERMS] = cells["p"].to_numpy(np.int64)
        tile, out = sides["tile"].to_numpy(), []
        for i in range(len(names)):
            with_ = np.flatnonzero(tile == (b if tile[i] == a else a))
            with_ = with_[with_ != i]
            apart = np.abs(p[with_] - p[i]).sum(1)
            out += [(lang, names[i], names[j], int(v)) for j, v in zip(with_, apart)]
        return pd.DataFrame(out, columns=["lang", "source", "item", "value"])

    by = ("lang", "block", "a", "b")
    compared = cells.groupBy(*by).cogroup(sides.groupBy(*by)).applyInPandas(compare, "lang string, source string, item string, value long")
    return compared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the
    language by the summed differences of their term shares, part ``term`` the terms that a
    source has more often than its language, by the difference.

    Terms are runs of letters (A-Z lower-cased, a-z) and characters beyond ASCII. Null lang, source
    and text are empty strings; a language or source may be the empty one. Repeated rows count
    as documents. A language without kept terms has pairs of value 0 and no terms; one with a
    single source has no pairs. Equal values rank by item in byte order. An empty table gives
    no rows; further columns are not read.
    """
    texts = plain(docs)
    words = vocabulary(texts, least_docs)
    found = stage(recounted(texts, words), "divergence-recount")
    held = found.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    sizes = words.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = texts.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = stage(groups.withColumn("none", share("0", "total", "terms")), "divergence-groups")
    counts = stage(found.join(groups, ["lang", "source"]).select("lang", "source", "idx", share("count", "total", "terms").alias("p")), "divergence-shares")
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    usual = found.groupBy("lang", "idx").agg(F.sum("count").alias("count")).join(whole, "lang").select("lang", "idx", share("count", "total", "terms").alias("q"))
    group = Window.partitionBy("lang", "source")
    above = counts.join(usual, ["lang", "idx"]).where("p > q").select("lang", "source", "idx", (F.col("p") - F.col("q")).alias("value"))
    best = above.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "idx"))).where(F.col("rank") <= top_terms)
    terms = best.join(words.select("lang", "idx", "term"), ["lang", "idx"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    pairs = _pairs(counts, groups).withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item")))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(terms)
