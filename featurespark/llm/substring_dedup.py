"""Removal of passages that repeat across documents: Rabin-Karp hashes of every
window of consecutive words, counted in Spark.

Round one sends each batch's distinct window hashes, shortened to 40 bits and the
bucket number, and learns which occur in several batches. Round two sends only those
windows, with 128 bits and their smallest document, and learns the smallest document
of all. Windows within one batch are compared there. What is removed are the maximal
intervals that removed windows cover.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from featurespark.llm import exchange as x
from featurespark.llm.shared import NULL_ID, batch_count, batched, bucket_count, text_bytes
from featurespark.llm.words import Words, mix, runs_cover

WINDOW = 13
BATCH_BYTES = 2_000_000


def _ids(table: pa.Table) -> np.ndarray:
    return table["id"].fill_null(NULL_ID).to_numpy()


def _candidates(table, found, plan, size):
    """Windows, their place, and which of them several batches share."""
    words = Words(table["text"])
    one, at = words.windows(words.hashes(0), size, 0)
    cut = plan.cut(one)
    keys, group = np.unique(cut, return_inverse=True)
    shared = x.replies(found, keys, plan, np.uint8)[group] > 1
    return words, one, at, shared


def _second(words, size):
    return words.windows(words.hashes(1), size, 1)[0]


def _least(one, two, ids):
    """Distinct (one, two) sorted by a key of both, with the smallest id; the group of each."""
    both = mix(one ^ (two << np.uint64(1)))
    order = np.lexsort((ids, both))
    keys, first, group = np.unique(both[order], return_index=True, return_inverse=True)
    back = np.empty(len(order), np.int64)
    back[order] = group
    return keys, ids[order][first], back, two[order][first]


def _smallest(group, groups, _source, values):
    check, ids = values
    # a key and its check word are compared together: 128 bits
    order = np.lexsort((check, group))
    g, c = group[order], check[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
    part = np.empty(len(group), np.int64)
    part[order] = np.cumsum(new) - 1
    least = np.full(int(new.sum()), NULL_ID, np.int64)
    np.minimum.at(least, part, ids)
    return least[part]


def repeated_word_cover(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, n_intervals, kept) per row of ``docs``: ``kept`` is
    the remaining words joined by one space.

    A word goes when a window of ``size`` words that covers it also starts in a
    document with a smaller id; windows are judged on the input. Null and empty texts
    have no words; a text of fewer than ``size`` words has no window. A null id is
    larger than any other. Rows that repeat an id are not smaller than one another, so
    neither loses words to the other. An empty table gives no rows; other columns are
    not read.
    """
    spark = docs.sparkSession
    total = text_bytes(docs, text_col)
    batches = batched(docs, batch_count(spark, total, BATCH_BYTES), id_col, text_col)
    buckets = bucket_count(spark, total)
    short, full = x.Plan(buckets, 40), x.Plan(buckets)

    def windows(batch, table):
        words = Words(table["text"])
        one, _ = words.windows(words.hashes(0), size, 0)
        return short.send(batch, np.unique(short.cut(one)))

    found = x.ask(batches, windows, x.shared_by_batches, [])

    def sources(batch, table, answer):
        words, one, at, shared = _candidates(table, answer, short, size)
        keys, least, _, check = _least(one[shared], _second(words, size)[shared], _ids(table)[words.doc[at[shared]]])
        return full.send(batch, keys, [check, least])

    smallest = x.ask(batches, sources, _smallest, [np.uint64, np.int64], found)
    replies = smallest.selectExpr("batch", "bucket", "reply", "1 as step").union(found.selectExpr("batch", "bucket", "reply", "0 as step"))

    def finish(_key, table, answer):
        step = answer["step"].to_numpy()
        words, one, at, shared = _candidates(table, answer.filter(pa.array(step == 0)), short, size)
        two, ids = _second(words, size), _ids(table)
        own = ids[words.doc[at]]
        keys, least, group, _ = _least(one, two, own)
        smallest_here = least[group]
        keys, _, group, _ = _least(one[shared], two[shared], own[shared])
        smallest_here[shared] = np.minimum(smallest_here[shared], x.replies(answer.filter(pa.array(step == 1)), keys, full, np.int64)[group])
        gone = runs_cover(at[smallest_here < own], size, len(words.starts))
        return _kept(table, words, gone)

    return batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(
        finish, "doc_id long, n_words long, n_removed long, n_intervals long, kept string")


def _kept(table: pa.Table, words: Words, gone: np.ndarray) -> pa.Table:
    """Texts of the words that stay, each followed by a space but for the last."""
    stay = ~gone
    length = words.ends[stay] - words.starts[stay] + 1
    docs = words.doc[stay]
    total = int(length.sum())
    ends = np.cumsum(length)
    source = np.arange(total) + np.repeat(words.starts[stay] - (ends - length), length)
    out = words.data[np.minimum(source, max(len(words.data) - 1, 0))] if total else np.zeros(0, np.uint8)
    out[ends - 1] = 32
    n = len(words.counts)
    size = np.bincount(docs, length, n).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum(size)])
    raw = out.tobytes()
    kept = [raw[a:max(a, b - 1)].decode() for a, b in zip(cuts[:-1], cuts[1:])]
    starts = gone & np.concatenate([[True], ~gone[:-1] | (words.doc[1:] != words.doc[:-1])])[:len(gone)]
    return pa.table({"doc_id": table["id"], "n_words": words.counts.astype(np.int64),
                     "n_removed": np.bincount(words.doc, gone, n).astype(np.int64),
                     "n_intervals": np.bincount(words.doc, starts, n).astype(np.int64), "kept": pa.array(kept, pa.string())})


