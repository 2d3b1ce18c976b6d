"""Removal of repeated byte strings, decided by suffix sorting with common prefixes.

Every string of SIZE bytes belongs to one anchor: the place in it whose GRAM-byte
string has the least hash (the leftmost of equal ones). Equal strings have equal
anchors, so a string can only repeat where its anchor's gram does. Round one counts the
grams of all anchors over the corpus. Round two sends, for every anchor whose gram
repeats, the bytes of the strings it owns to the shard of that gram; equal stretches of
one batch are sent once. A shard sorts the suffixes of all its stretches by external
induced sorting; strings are equal where neighbours share SIZE bytes, and all but the
earliest are answered as repeated.

The gram of a line that very many documents share would fill one shard with different
stretches. Strings of such anchors are dealt by a longer part that they have in common
instead: BLOCK neighbouring strings share all but BLOCK - 1 of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featurespark.llm import exchange as x
from featurespark.llm.shared import NULL_ID, batch_count, batched, bucket_count, text_bytes
from featurespark.llm.suffixes import DEPTH as SIZE, descending
from featurespark.llm.words import U64, _power_tables, mix, runs_cover, utf8

GRAM, BLOCK = 24, 8
BATCH_BYTES = 1_000_000
#: text of the corpus for each shard; a shard sorts the repeated part of it several times over
SHARD_BYTES = 2_000_000
#: bytes that no UTF-8 text has, between the stretches of a shard
BORDER = 255
#: memory for the queues of one shard
QUEUE_BYTES = 64_000_000
_PLACE = U64((1 << 28) - 1)

SENT = "bucket int, batch int, n int, entries binary, text binary"


class Anchors:
    """The strings of a batch's texts, by anchor: stretch i owns the strings that start at
    first[i] to last[i] and has its anchor at at[i]."""

    def __init__(self, table: pa.Table):
        ids = table["id"].fill_null(NULL_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.table, self.ids = table.take(pa.array(order)), ids[order]
        self.data, self.edges = utf8(self.table["text"])
        n = len(self.data)
        self.sums: dict[int, np.ndarray] = {}
        none = np.zeros(0, np.int64)
        self.at, self.first, self.last = none, none, none
        width = SIZE - GRAM + 1
        if n < SIZE:
            return
        # hash of every gram, its place in the lowest bits: the least is the leftmost least
        sums = self._sums(0)
        least = sums[GRAM:] - sums[:-GRAM]
        least *= _power_tables(n, 0)[1][:len(least)]
        least ^= least >> U64(32)
        least *= U64(0x9E3779B97F4A7C15)
        least &= ~_PLACE
        least |= np.arange(len(least), dtype=U64)
        reach = 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[:reach - width], least[width - reach:])
        # strings that lie in one document, document by document
        at = (least & _PLACE).astype(np.int32)
        new = np.empty(len(at), bool)
        new[0] = True
        np.not_equal(at[1:], at[:-1], out=new[1:])
        sizes = np.diff(self.edges)
        long = np.flatnonzero(sizes >= SIZE)
        low, high = self.edges[long], self.edges[long + 1] - SIZE
        new[low] = True
        whole = np.zeros(len(at) + 1, np.int8)
        whole[low] = 1
        whole[high + 1] -= 1
        first = np.flatnonzero(new & (np.cumsum(whole[:-1], dtype=np.int8) > 0))
        doc = np.searchsorted(low, first, "right") - 1
        self.first = first
        self.last = np.minimum(np.append(first[1:], len(at)) - 1, high[doc])
        self.at = at[first].astype(np.int64)
        self.key = self.hash(self.at, self.at + GRAM)

    def _sums(self, base: int) -> np.ndarray:
        """Sums of byte times power: any stretch's hash is a difference."""
        if base not in self.sums:
            s = np.empty(len(self.data) + 1, U64)
            s[0] = 0
            terms = self.data.astype(U64)
            terms += U64(1)
            terms *= _power_tables(len(self.data), base)[0][:len(self.data)]
            np.cumsum(terms, out=s[1:])
            self.sums[base] = s
        return self.sums[base]

    def hash(self, low: np.ndarray, high: np.ndarray, base: int = 0) -> np.ndarray:
        sums, down = self._sums(base), _power_tables(len(self.data), base)[1]
        return mix((sums[high] - sums[low]) * down[low])

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, places, "right") - 1


class Stretches:
    """The stretches of a batch that may repeat, equal ones once."""

    def __init__(self, table: pa.Table, answer: pa.Table, plan: x.Plan, common: int):
        a = self.a = Anchors(table)
        self.first, self.last, self.key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
        if len(a.at):
            cut = plan.cut(a.key)
            keys, group, here = np.unique(cut, return_inverse=True, return_counts=True)
            batches = x.replies(answer, keys, plan, np.uint8)[group].astype(np.int64)
            repeats = (batches > 1) | (here[group] > 1)
            hot = repeats & (batches >= common)
            self._add(a.first[repeats & ~hot], a.last[repeats & ~hot], a.key[repeats & ~hot])
            if hot.any():
                self._blocks(a.at[hot], a.first[hot], a.last[hot])
        size = self.last - self.first + SIZE
        one, two = a.hash(self.first, self.first + size), a.hash(self.first, self.first + size, 1)
        docs = a.doc_of(self.first)
        self.id, self.place = a.ids[docs], self.first - a.edges[docs]
        order = np.lexsort((self.place, self.id, size, two, one, self.key))
        same = np.zeros(len(order), bool)
        same[1:] = True
        for v in (size, two, one, self.key):
            same[1:] &= v[order][1:] == v[order][:-1]
        self.one_of = np.empty(len(order), np.int64)          # stretch -> its distinct number
        self.one_of[order] = np.cumsum(~same) - 1
        self.origin = order[~same]                            # distinct number -> its earliest stretch

    def _add(self, first, last, key) -> None:
        self.first, self.last = np.concatenate([self.first, first]), np.concatenate([self.last, last])
        self.key = np.concatenate([self.key, key])

    def _blocks(self, at, first, last) -> None:
        """Cut stretches by the distance of a string's start from the anchor."""
        high, low = (at - first) // BLOCK, (at - last) // BLOCK
        count = high - low + 1
        which = np.repeat(np.arange(len(at)), count)
        block = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        near = at[which] - BLOCK * block                      # the last start of a whole block
        key = mix(self.a.hash(near, near + SIZE - BLOCK + 1) + block.astype(U64))
        self._add(np.maximum(first[which], near - BLOCK + 1), np.minimum(last[which], near), key)


ENTRY = np.dtype([("id", "<i8"), ("place", "<i4"), ("owned", "<i4")])


def _send(batch: int, s: Stretches, plan: x.Plan) -> pa.Table:
    """One row for each bucket: entries and bytes of the distinct stretches, in order of key."""
    origin = s.origin
    bucket = (s.key[origin] >> plan.left).astype(np.int64)
    starts, size = s.first[origin], s.last[origin] - s.first[origin] + SIZE
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    text = s.a.data[np.arange(total) + np.repeat(starts - (ends - size), size)].tobytes() if total else b""
    entries = np.empty(len(origin), ENTRY)
    entries["id"], entries["place"], entries["owned"] = s.id[origin], s.place[origin], size - SIZE + 1
    # distinct numbers are in order of key, so buckets are runs
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else [0]
    edge = np.concatenate([[0], ends])
    rows = [(int(bucket[a]), batch, int(b - a), x.planes(entries[a:b]), text[edge[a]:edge[b]]) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table(dict(zip(("bucket", "batch", "n", "entries", "text"), zip(*rows) if rows else [[]] * 5)),
                    schema=pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("n", pa.int32()), ("entries", pa.binary()), ("text", pa.binary())]))


def repeated_strings(texts: list[bytes], ids: np.ndarray, places: np.ndarray, owned: np.ndarray) -> list[np.ndarray]:
    """For each stretch, which of its ``owned`` strings of SIZE bytes also start earlier, by
    (id, place), in some stretch. Equal texts are sorted once, for the earliest of them."""
    order = np.lexsort((places, ids))
    known: dict[bytes, int] = {}
    for i in order:
        known.setdefault(texts[i], int(i))
    chosen = np.array(sorted(known.values()), np.int64)
    border = bytes([BORDER])
    shard = np.frombuffer(border.join(texts[i] for i in chosen) + border, np.uint8)
    sizes = np.array([len(texts[i]) + 1 for i in chosen], np.int64)
    starts = np.cumsum(sizes) - sizes
    flags = np.zeros(len(shard), bool)

    def settle(group: np.ndarray) -> None:
        """``group``: blocks of equal strings, a number for each and its places in the shard."""
        number, at = group
        entry = np.searchsorted(starts, at, "right") - 1
        offset = at - starts[entry]
        valid = offset < owned[chosen[entry]]
        number, at, entry, offset = number[valid], at[valid], entry[valid], offset[valid]
        place = places[chosen[entry]] + offset
        of = ids[chosen[entry]]
        order = np.lexsort((place, of, number))
        lead = np.ones(len(order), bool)
        lead[1:] = number[order][1:] != number[order][:-1]
        head = np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
        later = (of[order] > of[order][head]) | (place[order] > place[order][head])
        flags[at[order[later]]] = True

    def close(blocks: list[tuple[np.ndarray, np.ndarray]]) -> None:
        at = np.concatenate([b[0] for b in blocks])
        equal = np.concatenate([b[1] for b in blocks])
        number = np.cumsum(~equal)
        big = np.bincount(number)[number] > 1
        if big.any():
            settle((number[big], at[big].astype(np.int64)))

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for at, common in descending(shard, QUEUE_BYTES):
        equal = common >= SIZE
        breaks = np.flatnonzero(~equal)
        if not len(breaks):
            held.append((at, equal))
            continue
        held.append((at[:breaks[-1]], equal[:breaks[-1]]))
        close(held)
        held = [(at[breaks[-1]:], equal[breaks[-1]:])]
    if held:
        close(held)
    out = []
    number = {int(c): k for k, c in enumerate(chosen)}
    for i, text in enumerate(texts):
        first = known[text]
        if first == i or (ids[i], places[i]) == (ids[first], places[first]):
            s = starts[number[first]]
            out.append(flags[s:s + owned[i]])
        else:
            out.append(np.ones(owned[i], bool))
    return out


def _shard(table: pa.Table) -> pa.Table:
    entries = [x.unplanes(e.as_py(), ENTRY, n) for e, n in zip(table["entries"], table["n"].to_pylist())]
    texts = []
    for e, text in zip(entries, table["text"]):
        edge = np.concatenate([[0], np.cumsum(e["owned"].astype(np.int64) + SIZE - 1)])
        raw = text.as_py()
        texts += [raw[a:b] for a, b in zip(edge[:-1], edge[1:])]
    every = np.concatenate(entries)
    flags = repeated_strings(texts, every["id"], every["place"].astype(np.int64), every["owned"].astype(np.int64))
    cuts = np.concatenate([[0], np.cumsum([len(e) for e in entries])])
    return pa.table({"batch": table["batch"], "bucket": table["bucket"],
                     "reply": pa.array([np.packbits(np.concatenate(flags[a:b])).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def _repeated_starts(s: Stretches, answer: pa.Table, plan: x.Plan) -> np.ndarray:
    """Places in the batch's bytes where a repeated string starts."""
    origin = s.origin
    owned = s.last - s.first + 1
    edge = np.concatenate([[0], np.cumsum(owned[origin])])
    bits = np.zeros(edge[-1], bool)
    bucket = (s.key[origin] >> plan.left).astype(np.int64)
    for b, reply in zip(answer["bucket"].to_pylist(), answer["reply"]):
        low, high = np.searchsorted(bucket, [b, b + 1])
        bits[edge[low]:edge[high]] = np.unpackbits(np.frombuffer(reply.as_py(), np.uint8), count=int(edge[high] - edge[low])).astype(bool)
    one = s.one_of
    first = origin[one]
    own = (s.id == s.id[first]) & (s.place == s.place[first])
    which = np.repeat(np.arange(len(one)), owned)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(owned) - owned, owned)
    gone = ~own[which] | bits[edge[one[which]] + offset] if len(which) else np.zeros(0, bool)
    return s.first[which[gone]] + offset[gone]


def repeated_byte_cover(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) per row: ``spans`` are the maximal removed
    runs (start, end) in bytes, ``kept`` is the remaining bytes.

    A byte goes when a string of SIZE bytes that covers it also starts earlier: in a
    document with a smaller id, or earlier in the same one. Strings never cross
    documents, overlaps count, and strings are judged on the input. Null and short texts
    lose nothing. A null id is larger than any other. Rows that repeat an id are the same
    document: equal places in them do not remove one another. An empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    total = text_bytes(docs, text_col)
    n = batch_count(spark, total, BATCH_BYTES)
    buckets = bucket_count(spark, total, SHARD_BYTES)
    texts = batched(docs, n, id_col, text_col)
    short, full = x.Plan(buckets, 40), x.Plan(buckets)
    common = min(255, max(8, n // 8))

    def grams(batch, table):
        a = Anchors(table)
        return short.send(batch, np.unique(short.cut(a.key)) if len(a.at) else np.zeros(0, U64))

    found = x.ask(texts, grams, x.shared_by_batches, [])

    def stretches(key, table, answer):
        return _send(key[0].as_py(), Stretches(table, answer, short, common), full)

    sent = texts.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(stretches, SENT)
    repeated = sent.groupBy("bucket").applyInArrow(_shard, x.ANSWER)
    replies = repeated.select("batch", "bucket", "reply", F.lit(1).alias("step")).union(found.select("batch", "bucket", "reply", F.lit(0).alias("step")))

    def finish(_key, table, answer):
        step = answer["step"].to_numpy()
        s = Stretches(table, answer.filter(pa.array(step == 0)), short, common)
        a = s.a
        gone = runs_cover(_repeated_starts(s, answer.filter(pa.array(step == 1)), full), SIZE, len(a.data))
        flat = np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))
        inner = a.edges[1:-1][(a.edges[1:-1] > 0) & (a.edges[1:-1] < len(gone))]
        both = inner[gone[inner] & gone[inner - 1]] if len(inner) else inner
        starts = np.sort(np.concatenate([np.flatnonzero(flat == 1), np.unique(both)]))
        ends = np.sort(np.concatenate([np.flatnonzero(flat == -1), np.unique(both)]))
        docs_ = a.doc_of(starts)
        spans = [[] for _ in a.ids]
        for d, low, high in zip(docs_.tolist(), starts.tolist(), ends.tolist()):
            spans[d].append({"start": int(low - a.edges[d]), "end": int(high - a.edges[d])})
        removed = np.concatenate([[0], np.cumsum(gone)])
        kept, stay = a.data[~gone].tobytes(), a.edges - removed[a.edges]
        return pa.table({"doc_id": a.table["id"], "n_bytes": np.diff(a.edges), "n_removed": np.diff(removed[a.edges]).astype(np.int64),
                         "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                         "kept": pa.array([kept[i:j] for i, j in zip(stay[:-1], stay[1:])], pa.binary())})

    return texts.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(
        finish, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
