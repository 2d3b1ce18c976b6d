"""Benchmark overlap: short test items found inside long documents.

Items are partitioned by size. An item of m distinct shingles keeps a MinHash sketch:
the r = m - ceil(t m) + 1 smallest of its shingle hashes. A document that contains at
least t of the item's shingles lacks at most m - ceil(t m) of them, so it holds a
sketch member for certain: unlike banded signatures, whose recall falls with the
document's length, the search misses nothing. A document is looked up with those of
its hashes that are no larger than a size partition's largest sketch value. What the
search proposes is verified by the exact shingle containment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featurespark.functions.columns import unused
from featurespark.llm.shared import stage, text_or_empty
from featurespark.llm.words import U64, Words, slices

SHINGLE, PERCENT = 5, 80
#: items of one pass: at most so many bytes of item text are broadcast; more items take more passes
BLOCK_BYTES = 16_000_000

RESULT = "doc_id long, item_id long, n_shingles long, n_common long, containment double"


def _sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and the text number of each. A text of fewer than
    ``size`` words has none."""
    grams, at = words.windows(words.hashes(), size)
    return grams, words.doc[at]


class Items:
    """Sketches and shingle sets of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], size: int):
        grams, owner = _sets(Words(pa.array(texts, pa.string()), lower=True), size)
        pairs = np.unique(np.stack([owner.astype(U64), grams], 1), axis=0) if len(grams) else np.zeros((0, 2), U64)
        self.owner, self.grams = pairs[:, 0].astype(np.int64), pairs[:, 1]
        self.ids = pa.array(ids, pa.int64())
        self.m = np.bincount(self.owner, minlength=len(ids)).astype(np.int64)
        self.need = (PERCENT * self.m + 99) // 100
        keep = self.m - self.need + 1
        rank = np.arange(len(self.grams)) - np.repeat(np.cumsum(self.m) - self.m, self.m)
        sketch = rank < keep[self.owner]
        part = np.floor(np.log2(np.maximum(self.m, 1))).astype(np.int64)[self.owner]
        # of each size partition: its largest sketch value, and its sketch sorted by hash
        self.parts = []
        for p in np.unique(part[sketch]):
            own = sketch & (part == p)
            order = np.argsort(self.grams[own], kind="stable")
            self.parts.append((self.grams[own].max(), self.grams[own][order], self.owner[own][order]))
        order = np.argsort(self.grams, kind="stable")
        self.by_gram, self.by_owner = self.grams[order], self.owner[order]

    def search(self, grams: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Rows (document number, item number, common shingles) that reach the containment."""
        wide = np.int64(max(1, len(self.ids)))
        proposed = []
        for largest, sketch, owner in self.parts:
            near = grams <= largest
            low, high = np.searchsorted(sketch, grams[near]), np.searchsorted(sketch, grams[near], "right")
            hit = np.flatnonzero(high > low)
            span = (high - low)[hit]
            at = np.repeat(low[hit] - (np.cumsum(span) - span), span) + np.arange(span.sum())
            proposed.append(np.repeat(docs[near][hit], span) * wide + owner[at])
        proposed = np.unique(np.concatenate(proposed)) if proposed else np.zeros(0, np.int64)
        if not len(proposed):
            return np.zeros((0, 3), np.int64)
        # exact: every shingle of the proposed documents against the items' full sets
        some = np.isin(docs, proposed // wide)
        low, high = np.searchsorted(self.by_gram, grams[some]), np.searchsorted(self.by_gram, grams[some], "right")
        hit = np.flatnonzero(high > low)
        span = (high - low)[hit]
        at = np.repeat(low[hit] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        met = np.stack([np.repeat(docs[some][hit], span) * wide + self.by_owner[at], at], 1)
        pair, common = np.unique(np.unique(met, axis=0)[:, 0], return_counts=True)
        ok = (common >= self.need[pair % wide]) & np.isin(pair, proposed)
        return np.stack([pair[ok] // wide, pair[ok] % wide, common[ok]], 1)


def _blocks(items: DataFrame, item_id: str, text_col: str):
    """Items in blocks of at most BLOCK_BYTES of text, read one block at a time."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text_col).alias("t"),
                                                           F.octet_length(text_col).alias("b"))
    total = rows.agg(F.sum("b")).first()[0] or 0
    blocks = max(1, -(-2 * int(total) // BLOCK_BYTES))
    for k in range(blocks):
        yield rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").select("i", "t").collect()


def contained_items(docs: DataFrame, items: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
                    item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_common, containment): every pair in which the
    document holds at least PERCENT % of the item's distinct ``size``-word shingles
    (A-Z lowered). Items of fewer words have no shingles and are never found; nor is
    anything in null or empty texts. Rows that repeat an id each give their pairs. A
    null doc_id stays null. Empty tables give no rows; other columns are not read.

    The items are a stated query set. They go to the executors in blocks of bounded
    size, one pass over the documents for each block; the block is released before the
    next is read, so the driver never holds more than one.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    out = None
    for block in _blocks(items, item_id, item_text):
        held = spark.sparkContext.broadcast(Items([r["i"] for r in block], [r["t"] for r in block], size))

        def find(batches, held=held):
            for batch in (part for whole in batches for part in slices(whole, 1)):
                grams, owner = _sets(Words(batch.column(1), lower=True), size)
                found = held.value.search(grams, owner)
                m, common = held.value.m[found[:, 1]], found[:, 2]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(found[:, 0])), held.value.ids.take(pa.array(found[:, 1])), pa.array(m), pa.array(common),
                     pa.array(common / np.maximum(m, 1))], ["doc_id", "item_id", "n_shingles", "n_common", "containment"])

        part = stage(texts.mapInArrow(find, RESULT), "contained-items")
        held.destroy()
        out = part if out is None else out.union(part)
    return out


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """``docs`` without the documents that contain an item; rows with a null id stay."""
    name = unused(docs.columns, "__leak")
    leaks = contained_items(docs, items, id_col=id_col, **kw).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaks, F.col(id_col) == F.col(name), "left_anti")
