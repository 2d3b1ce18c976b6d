"""Batches of documents ask buckets of keys.

A batch sends its distinct 64-bit keys, sorted, each with packed values; the key
space is cut into equal buckets. A bucket gathers one blob from each batch that has
keys there, computes over equal keys of all batches, and answers every batch with an
array aligned with the keys it sent. A key that a third of all documents share
arrives once a batch, not once a document, so no bucket receives a hot key's rows,
and neither side ever holds more than one batch or one bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SENT = "bucket int, batch int, n int, keys binary, vals binary"
ANSWER = "batch int, bucket int, reply binary"


def planes(values: np.ndarray) -> bytes:
    """Bytes of an integer array, most of them zero, ordered so that Spark's
    compression removes the zeros: all lowest bytes, then all second bytes, ..."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()


def unplanes(blob: bytes, dtype, n: int) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(blob, np.uint8, n * dtype.itemsize).reshape(dtype.itemsize, n)
    return np.ascontiguousarray(raw.T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unplanes(blob, np.uint64, n), dtype=np.uint64)


class Plan:
    """How keys are cut: ``buckets`` equal ranges, and ``bits`` of a key kept.

    Keeping fewer bits makes the blobs smaller; ``bits`` beyond the bucket number
    stay the same as data and buckets grow.
    """

    def __init__(self, buckets: int, bits: int = 64):
        self.lead = max(1, ceil(log2(max(2, buckets))))     # bits that name the bucket
        self.buckets = 1 << self.lead
        self.shift = np.uint64(max(0, 64 - bits - self.lead) if bits < 64 else 0)
        self.left = np.uint64(64 - self.lead)

    def cut(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> self.shift

    def send(self, batch: int, keys: np.ndarray, values: list[np.ndarray] = ()) -> pa.Table:
        """``keys``: sorted, distinct, cut; ``values``: arrays aligned with them."""
        edges = np.searchsorted(keys, np.arange(1, self.buckets, dtype=np.uint64) << (self.left - self.shift))
        edges = np.concatenate([[0], edges, [len(keys)]])
        full = np.flatnonzero(np.diff(edges))
        start = full.astype(np.uint64) << (self.left - self.shift)
        rows = [(int(b), batch, int(edges[b + 1] - edges[b]), pack_sorted(keys[edges[b]:edges[b + 1]] - s),
                 b"".join(planes(v[edges[b]:edges[b + 1]]) for v in values)) for b, s in zip(full, start)]
        return pa.table(dict(zip(("bucket", "batch", "n", "keys", "vals"), zip(*rows) if rows else [[]] * 5)),
                        schema=pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())]))


def answers(reduce: Callable, kinds: list) -> Callable[[pa.Table], pa.Table]:
    """Bucket function: ``reduce(group, groups, source, values)`` gets, for all entries
    of a bucket, the number of the entry's key, the count of keys, the entry's batch
    number within the bucket, and the value arrays of ``kinds``; it returns the reply
    array for all entries (one array, answered as bytes in planes)."""
    def run(table: pa.Table) -> pa.Table:
        ns = table["n"].to_numpy()
        sent = [unpack_sorted(k.as_py(), n) for k, n in zip(table["keys"], ns)]
        values: list[list[np.ndarray]] = [[] for _ in kinds]
        for blob, n in zip(table["vals"], ns):
            raw, at = blob.as_py(), 0
            for out, kind in zip(values, kinds):
                size = n * np.dtype(kind).itemsize
                out.append(unplanes(raw[at:at + size], kind, n))
                at += size
        distinct, group = np.unique(np.concatenate(sent), return_inverse=True)
        reply = reduce(group, len(distinct), np.repeat(np.arange(len(ns)), ns), [np.concatenate(v) for v in values])
        cuts = np.concatenate([[0], np.cumsum(ns)])
        return pa.table({"batch": table["batch"], "bucket": table["bucket"],
                         "reply": pa.array([planes(reply[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})
    return run


def replies(table: pa.Table, keys: np.ndarray, plan: Plan, kind) -> np.ndarray:
    """The answers to one batch, aligned with the keys it sent."""
    if not len(keys):
        return np.zeros(0, kind)
    edges = np.searchsorted(keys, np.arange(1, plan.buckets, dtype=np.uint64) << (plan.left - plan.shift))
    edges = np.concatenate([[0], edges, [len(keys)]])
    out = np.empty(len(keys), kind)
    for bucket, reply in zip(table["bucket"].to_pylist(), table["reply"]):
        a, b = edges[bucket], edges[bucket + 1]
        out[a:b] = unplanes(reply.as_py(), kind, b - a)
    return out


def ask(batches: DataFrame, question: Callable[[int, pa.Table], pa.Table], reduce: Callable, kinds: list, other: DataFrame | None = None) -> DataFrame:
    """(batch, bucket, reply). ``question(batch, table[, others])`` returns ``Plan.send``'s rows."""
    if other is None:
        sent = batches.groupBy("batch").applyInArrow(lambda key, t: question(key[0].as_py(), t), SENT)
    else:
        sent = batches.groupBy("batch").cogroup(other.groupBy("batch")).applyInArrow(
            lambda key, t, o: question(key[0].as_py(), t, o), SENT)
    return sent.groupBy("bucket").applyInArrow(answers(reduce, kinds), ANSWER)


def shared_by_batches(group: np.ndarray, groups: int, _source, _values) -> np.ndarray:
    """Reply: in how many batches a key is, at most 255."""
    return np.minimum(np.bincount(group, minlength=groups), 255).astype(np.uint8)[group]
