"""SentencePiece unigram encoding and decoding.

The pieces and scores come from a given model file. They sit in a double-array trie
over UTF-8 bytes; the best segmentation is the path of the largest score (Viterbi).
A character that no piece covers falls back to its bytes. Spaces become the marker
U+2581, and one marker is put in front; decoding undoes both.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featurespark.llm.words import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: segmentations of words that a worker remembers (in each of two generations), and the longest such word
REMEMBER, LONGEST = 300_000, 48


class DoubleArray:
    """Trie of byte strings in two arrays: the child of s by byte c is base[s] + c + 1
    if check there is s. ``value`` has the id of the piece that ends in a node, or -1."""

    def __init__(self, words: list[tuple[bytes, int]]):
        words = sorted(words)
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        free = wide = 300               # where single children and groups of children look for room
        queue = [(0, 0, len(words), 0)]
        while queue:
            node, low, high, depth = queue.pop()
            if low < high and len(words[low][0]) == depth:
                self.value[node] = words[low][1]
                low += 1
            children = []
            while low < high:
                c, start = words[low][0][depth], low
                while low < high and words[low][0][depth] == c:
                    low += 1
                children.append((c + 1, start, low))
            if not children:
                continue
            first = children[0][0]
            if len(children) == 1:
                while used[free]:
                    free += 1
                base = free - first
            else:
                base = wide
            while any(used[base + c] for c, _, _ in children):
                base += 1
                if base + 1024 > len(used):
                    used.extend(bytes(len(used)))
            if len(children) > 1:
                wide = base
            if len(used) > len(self.base):
                grow = len(used) - len(self.base)
                self.base, self.check, self.value = (np.concatenate([v, np.full(grow, f, np.int32)]) for v, f in ((self.base, 0), (self.check, -1), (self.value, -1)))
            self.base[node] = base
            for c, start, end in children:
                used[base + c] = 1
                self.check[base + c] = node
                queue.append((base + c, start, end, depth + 1))

    def lists(self):
        return self.base.tolist(), self.check.tolist(), self.value.tolist()


class PieceModel:
    """Pieces, scores and trie of a model file, ready to be broadcast."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.vocab_size())
        normal = [i for i in ids if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.scores = [p.get_score(i) for i in ids]
        self.unknown = p.unk_id()
        self.byte_id = {int(p.id_to_piece(i)[3:5], 16): i for i in ids if p.is_byte(i)}
        words = [p.id_to_piece(i) for i in normal]
        self.trie = DoubleArray([(w.encode(), i) for w, i in zip(words, normal)])
        self.bytes = [b""] * len(self.scores)
        for w, i in zip(words, normal):
            self.bytes[i] = w.replace(MARK, " ").encode()
        for b, i in self.byte_id.items():
            self.bytes[i] = bytes([b])
        self.least = min(self.scores[i] for i in normal) - UNKNOWN_PENALTY
        #: no piece goes on past a marker or holds a line feed, so the best path splits there
        self.splits = all(MARK not in w.lstrip(MARK) and "\n" not in w for w in words)

    def start(self) -> "PieceModel":
        """Tables of a worker process (plain lists are faster to step through), and its
        memory of words, which later tasks of the process go on with."""
        if hasattr(self, "memory"):
            return self
        self.base, self.check, self.value = self.trie.lists()
        self.memory: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.unit = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        return self

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path. Of equal scores the earlier start of the last piece wins."""
        data = text.encode()
        n = len(data)
        worst = float("-inf")
        best, start, last = [worst] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, scores, least = self.base, self.check, self.value, self.scores, self.least
        top = len(base)
        at = 0
        while at < n:
            lead = data[at]
            after = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            here, node, end, single = best[at], 0, at, False
            while end < n:
                step = base[node] + data[end] + 1
                if step >= top or check[step] != node:
                    break
                node = step
                end += 1
                piece = value[node]
                if piece >= 0:
                    total = here + scores[piece]
                    if total > best[end]:
                        best[end], start[end], last[end] = total, at, piece
                    if end == after:
                        single = True
            if not single and here + least > best[after]:
                best[after], start[after], last[after] = here + least, at, -1
            at = after
        out = []
        while n:
            at, piece = start[n], last[n]
            if piece >= 0:
                out.append(piece)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in reversed(data[at:n]))
            else:
                out.append(self.unknown)
            n = at
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not self.splits:
            return self.viterbi(marked)
        memory, older, out = self.memory, self.older, []
        for unit in self.unit.findall(marked):
            ids = memory.get(unit)
            if ids is None:
                ids = older.get(unit) or tuple(self.viterbi(unit))
                if len(unit) <= LONGEST:
                    if len(memory) >= REMEMBER:
                        # what was not asked for since the last change of generation is forgotten
                        older = self.older = memory
                        memory = self.memory = {}
                    memory[unit] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        """Text of ``ids``: markers become spaces, the one put in front goes, bytes are
        joined; bytes that are not UTF-8 become U+FFFD."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, n_pieces, n_bytes, round_trip), one row for each row.

    n_bytes counts byte-fallback pieces; round_trip says that decoding the ids gives the
    text back, which holds for every text without U+2581 (it reads as a space). Null and
    empty texts have no pieces. Repeated rows are encoded alike; a null id stays null;
    an empty table gives no rows; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches):
        model = held.value.start()
        is_byte = np.zeros(len(model.scores), bool)
        is_byte[list(model.byte_id.values())] = True
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lists = [model.encode(t) for t in texts]
            same = [model.decode(ids) == t for ids, t in zip(lists, texts)]
            sizes = np.array([len(ids) for ids in lists], np.int64)
            flat = np.array([i for ids in lists for i in ids], np.int32)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            low = np.concatenate([[0], np.cumsum(is_byte[flat])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat)), pa.array(sizes),
                 pa.array((low[edges[1:]] - low[edges[:-1]]).astype(np.int64)), pa.array(same)],
                ["doc_id", "ids", "n_pieces", "n_bytes", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        encode, "doc_id long, ids array<int>, n_pieces long, n_bytes long, round_trip boolean")


def decode_documents(encoded: DataFrame, model: PieceModel, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from piece ids; null ids give an empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(model)

    def decode(batches):
        model = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(decode, "doc_id long, text string")
