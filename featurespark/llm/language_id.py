"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to ORDER, learnt from a bounded
sample of labelled documents and then frozen. The code length of a text under a
language is exact: every byte is coded in the longest context that has seen it, after
the escapes of the longer contexts (escape method C), and at last with 8 bits. The
shortest code names the language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from featurespark.llm.words import slices, utf8

ORDER = 4
#: the training sample: so many documents of each language, so many characters of each
TRAIN_DOCS, TRAIN_CHARS = 150, 8000
UNKNOWN = "und"
#: distinct byte contexts whose code lengths a task remembers
REMEMBER = 1_500_000

_letters = np.zeros(256, bool)
_letters[[*range(65, 91), *range(97, 123)]] = True


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learnt from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it in its text (zeros before the start)."""
    out = data.astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER + 1):
        out[k:] |= np.where(place[k:] >= k, data[:-k], 0).astype(np.uint64) << np.uint64(8 * k)
    return out


class ContextTree:
    """Frozen counts of one language: contexts and their symbols, by order."""

    def __init__(self, texts: list[str]):
        data, offsets = utf8(pa.array(texts, pa.string()))
        all_ = grams(data, offsets)
        self.orders = []
        for k in range(ORDER + 1):
            keys, count = np.unique(all_ & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
            contexts, first, distinct = np.unique(keys >> np.uint64(8), return_index=True, return_counts=True)
            total = np.add.reduceat(count, first) if len(first) else first
            self.orders.append((contexts, total, distinct, keys, count))

    def bits(self, asked: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte in its context."""
        bits, open_ = np.zeros(len(asked)), np.arange(len(asked))
        for k in range(ORDER, -1, -1):
            contexts, total, distinct, keys, count = self.orders[k]
            if not len(keys) or not len(open_):
                continue
            key = asked[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(contexts, key >> np.uint64(8)), len(contexts) - 1)
            known = contexts[at] == key >> np.uint64(8)
            sym = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            seen = keys[sym] == key
            mass = np.where(seen, count[sym], distinct[at]) / (total[at] + distinct[at])
            bits[open_[known]] -= np.log2(mass[known])
            open_ = open_[~seen]
        bits[open_] += 8
        return bits


class Languages:
    """One frozen tree for each language, and a memory of code lengths already found."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        self.trees = [ContextTree(samples[n]) for n in self.names]
        self.known, self.lengths = np.zeros(0, np.uint64), np.zeros((0, len(self.names)), np.float32)

    def _lengths(self, asked: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, asked)
        new = np.ones(len(asked), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != asked[inside]
        if new.any():
            found = np.stack([t.bits(asked[new]) for t in self.trees], 1).astype(np.float32)
            if len(self.known) + len(found) > REMEMBER:
                keep = np.zeros(len(self.known), bool)
                keep[at[~new]] = True
                self.known, self.lengths = self.known[keep], self.lengths[keep]
            where = np.searchsorted(self.known, asked[new])
            self.known, self.lengths = np.insert(self.known, where, asked[new]), np.insert(self.lengths, where, found, 0)
            at = np.searchsorted(self.known, asked)
        return self.lengths[at]

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        asked, group = np.unique(grams(data, offsets), return_inverse=True)
        each = self._lengths(asked) if len(asked) else np.zeros((0, len(self.names)), np.float32)
        out = np.zeros((len(offsets) - 1, len(self.names)))
        for j in range(len(self.names)):
            sums = np.concatenate([[0.0], np.cumsum(each[:, j][group], dtype=np.float64)])
            out[:, j] = sums[offsets[1:]] - sums[offsets[:-1]]
        return out

    def predict(self, column) -> pa.Table:
        """lang_pred, score (the language's share of the code space) and bits per byte."""
        data, offsets = utf8(column)
        has = np.concatenate([[0], np.cumsum(_letters[data])])
        letter = has[offsets[1:]] > has[offsets[:-1]]
        for d in np.flatnonzero(~letter):
            letter[d] = any(c.isalpha() for c in column[int(d)].as_py() or "")
        if not self.names:
            letter[:] = False
        size = np.diff(offsets)
        best, score, rate = np.zeros(len(size), np.int64), np.zeros(len(size)), np.zeros(len(size))
        if self.names:
            bits = self.code_lengths(data, offsets)
            best = bits.argmin(1)
            least = bits.min(1)
            score = 1 / np.exp2(np.maximum(least[:, None] - bits, -200)).sum(1)
            rate = least / np.maximum(size, 1)
        names = [self.names[b] if ok else UNKNOWN for b, ok in zip(best, letter)]
        return names, np.where(letter, np.round(score, 6), 0.0), np.where(letter, np.round(rate, 6), 0.0)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Languages:
    """Fit the trees on at most ``train_docs`` documents of each language, at most
    ``train_chars`` characters of each, chosen by a hash of the id. Held-out documents
    and rows without a language or text are not read."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    rows = rows.select(F.col(lang_col).alias("lang"), F.substring(F.col(text_col), 1, train_chars).alias("text"),
                       F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << 40)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    pick = F.lit(False)
    for lang, n in counts.items():
        # three times the wanted rows by a hash threshold, cut to the wanted number below
        pick = pick | ((F.col("lang") == lang) & (F.col("h") < min(1.0, (3 * train_docs + 20) / n) * (1 << 40)))
    samples: dict[str, list] = {}
    if counts:
        for r in rows.where(pick).select("lang", "h", "text").limit(len(counts) * (6 * train_docs + 100)).collect():
            samples.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return Languages({lang: [t for _, t in sorted(v)[:train_docs]] for lang, v in samples.items()})


def identify(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte), one row for each row.

    A null text, a text without a letter, or an empty model gives ``und`` with score 0.
    The prediction reads the text alone; of equal code lengths the first language by
    name wins. A null id is not held out. An empty table gives no rows; repeated rows
    are predicted alike; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(languages)

    def predict(batches):
        model = held.value
        for batch in (part for whole in batches for part in slices(whole, 2)):
            names, score, rate = model.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(rate)],
                                             ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(
        predict, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")
