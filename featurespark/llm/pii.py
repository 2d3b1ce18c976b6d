"""Personal data in texts: fixed patterns, and a character-level bidirectional LSTM
with CRF transitions that adds what the patterns miss.

The network is trained in numpy from labelled spans of a bounded sample. It reads
every character of every text in overlapping windows. Each window is decoded by
Viterbi; a character takes the label of the window in whose middle part it lies, and
spans are formed over the whole text afterwards, so one that crosses windows is whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featurespark.llm.words import slices

KINDS = ("email", "ip", "card", "phone")
#: fixed patterns of the base spans; the lookbehinds only save retries inside a run of digits
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

HIDDEN, WINDOW, OVERLAP = 8, 256, 32
#: windows that go through the network together (their gates stay in a core's cache)
TILE = 2048
#: the training sample: documents with and without marks of personal data, characters of each, steps
TRAIN_DOCS, TRAIN_CHARS, TRAIN_WINDOW, STEPS = 300, 20_000, 64, 150
#: a span that the network adds has at least so many characters and so many digits
LEAST_CHARS, LEAST_DIGITS = 6, 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping per kind,
    ordered by kind and start."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((0, start, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _classes() -> np.ndarray:
    """Class of a code point below 768: the marks that personal data is made of stand
    alone, other characters by kind."""
    table = np.zeros(768, np.uint8)
    for i, c in enumerate(".@+-()_% \n\t/:,;\"'="):
        table[ord(c)] = 6 + i
    for c in range(768):
        if not table[c]:
            s = chr(c)
            table[c] = 1 if "0" <= s <= "9" else 2 if "a" <= s <= "z" else 3 if "A" <= s <= "Z" else 4 if s.isalpha() else 5
    return table


CLASSES = _classes()
PAD, N_CLASSES = 0, int(_classes().max()) + 1


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 768, CLASSES[np.minimum(codes, 767)], 4).astype(np.uint8)


class Tagger:
    """BiLSTM emissions and CRF transitions over the labels none + KINDS."""

    def __init__(self, seed: int = 7):
        rng, h, k = np.random.default_rng(seed), HIDDEN, len(KINDS) + 1
        draw = lambda *shape: (rng.normal(0, 0.3, shape)).astype(np.float32)
        self.p = {"out": draw(2 * h, k), "bias": np.zeros(k, np.float32), "move": np.zeros((k, k), np.float32), "first": np.zeros(k, np.float32)}
        for d in "fb":
            self.p |= {"x" + d: draw(N_CLASSES, 4 * h), "u" + d: draw(h, 4 * h)}
            self.p["x" + d][:, h:2 * h] += 1                # gates: in, forget, out, new

    def _run(self, d: str, x: np.ndarray, keep: bool = False):
        """States (time, hidden, windows) of one direction over x (time, windows); with
        ``keep`` all gates. Windows lie along the last axis, so every gate is contiguous."""
        h, times, n = HIDDEN, *x.shape
        scale = np.ones((4 * h, 1), np.float32)
        scale[3 * h:] = 2                                    # tanh(v) = 2 sigmoid(2 v) - 1
        u, wx = -scale * self.p["u" + d].T, -scale * self.p["x" + d].T
        state, cell = np.zeros((h, n), wx.dtype), np.zeros((h, n), wx.dtype)
        states = np.empty((times, h, n), wx.dtype)
        bent, kept = np.empty((h, n), wx.dtype), []
        for t in (range(times) if d == "f" else range(times - 1, -1, -1)):
            z = np.take(wx, x[t], 1)
            z += u @ state
            np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
            new = z[3 * h:]
            new *= 2
            new -= 1
            before, cell = cell, z[h:2 * h] * cell
            cell += z[:h] * new
            np.multiply(cell, -2, out=bent)
            np.exp(bent, out=bent)
            bent += 1
            np.divide(2, bent, out=bent)
            bent -= 1
            if keep:
                kept.append((t, z, before, bent.copy(), state))
            state = np.multiply(z[2 * h:3 * h], bent, out=states[t])
        return states, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(time, labels, windows)."""
        h, out = HIDDEN, self.p["out"].T
        e = out[:, :h] @ self._run("f", x)[0]
        e += out[:, h:] @ self._run("b", x)[0]
        e += self.p["bias"][:, None]
        return e

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood of the labels y and its gradients (mean over windows)."""
        p, h = self.p, HIDDEN
        times, n = x.shape
        runs = {d: self._run(d, x, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 1).transpose(0, 2, 1)
        e = both @ p["out"] + p["bias"]
        k = e.shape[2]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + p["first"]
        lse = lambda v, axis: (m := v.max(axis)) + np.log(np.exp(v - np.expand_dims(m, axis)).sum(axis))
        for t in range(1, times):
            alpha[t] = e[t] + lse(alpha[t - 1][:, :, None] + p["move"], 1)
        for t in range(times - 2, -1, -1):
            beta[t] = lse((e[t + 1] + beta[t + 1])[:, None, :] + p["move"], 2)
        total = lse(alpha[-1], 1)
        marginal = np.exp(alpha + beta - total[None, :, None])
        pair = np.exp(alpha[:-1][:, :, :, None] + p["move"] + (e[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]).sum((0, 1))
        hot = np.eye(k, dtype=np.float32)[y]
        gold = (e * hot).sum() + p["first"][y[0]].sum() + p["move"][y[:-1], y[1:]].sum()
        counts = np.zeros((k, k), np.float32)
        np.add.at(counts, (y[:-1].ravel(), y[1:].ravel()), 1)
        de = (marginal - hot) / n
        g = {"move": (pair - counts) / n, "first": (marginal[0] - hot[0]).sum(0) / n,
             "out": np.tensordot(both, de, ((0, 1), (0, 1))), "bias": de.sum((0, 1))}
        ds = de @ p["out"].T
        for d, part in (("f", ds[:, :, :h]), ("b", ds[:, :, h:])):
            gx, gu = np.zeros_like(p["x" + d]), np.zeros_like(p["u" + d])
            dstate, dcell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, *saved in reversed(runs[d][1]):
                z, before, bent, state = (v.T for v in saved)
                i, f, o, new = (z[:, j * h:(j + 1) * h] for j in range(4))
                dstate = dstate + part[t]
                dcell = dcell + dstate * o * (1 - bent * bent)
                dz = np.concatenate([dcell * new * i * (1 - i), dcell * before * f * (1 - f), dstate * bent * o * (1 - o), dcell * i * (1 - new * new)], 1)
                np.add.at(gx, x[t], dz)
                gu += state.T @ dz
                dstate, dcell = dz @ p["u" + d].T, dcell * f
            g |= {"x" + d: gx, "u" + d: gu}
        return float((total.sum() - gold) / n), g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 96, rate: float = 0.03, seed: int = 3) -> "Tagger":
        """Adam over random windows x, y (windows, time)."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            _, g = self.gradients(x[pick].T, y[pick].T)
            for k, w in self.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                w -= rate * min(1, 3 * (1 - step / (steps + 1))) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)
        return self

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best labels (time, windows) of emissions e (time, labels, windows)."""
        times, _, n = e.shape
        labels = np.zeros((times, n), np.uint8)
        move, first = self.p["move"], self.p["first"]
        open_ = np.flatnonzero(self._most_gain(e) > 0)      # elsewhere no label at all is best
        if not len(open_):
            return labels
        e = np.ascontiguousarray(e[:, :, open_].transpose(0, 2, 1))
        back, best = np.empty(e.shape, np.uint8), e[0] + first
        for t in range(1, times):
            paths = best[:, :, None] + move
            back[t] = paths.argmax(1)
            best = paths.max(1) + e[t]
        at = best.argmax(1)
        for t in range(times - 1, -1, -1):
            labels[t, open_] = at
            if t:
                at = back[t, np.arange(len(open_)), at]
        return labels

    def _most_gain(self, e: np.ndarray) -> np.ndarray:
        """Upper bound, per window, of what any labels gain over none: the best run with the
        best label at every place, the best transitions between labels, and its ends."""
        move, first = self.p["move"] - self.p["move"][0, 0], self.p["first"] - self.p["first"][0]
        enter, stay, leave = move[0, 1:].max(), move[1:, 1:].max(), move[1:, 0].max()
        over = e[:, 1:].max(1) - e[:, 0]
        run = over[0] + first[1:].max()
        most = run + leave
        for t in range(1, len(over)):
            run = np.maximum(run + stay, enter) + over[t]
            np.maximum(most, run + leave, out=most)
        return np.maximum(most, run)                          # a run may last to the window's end

    def tag(self, x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Labels of all characters of texts x[edges[i]:edges[i + 1]], window by window."""
        step = WINDOW - OVERLAP
        sizes = np.diff(edges)
        count = np.maximum(-(-(sizes - OVERLAP) // step), 1) * (sizes > 0)
        text = np.repeat(np.arange(len(sizes)), count)
        number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start, end = edges[text] + number * step, edges[text + 1]
        last = number == count[text] - 1
        half, place = OVERLAP // 2, np.arange(WINDOW)[:, None]
        out = np.zeros(len(x), np.uint8)
        for i in range(0, len(text), TILE):
            some = slice(i, i + TILE)
            where = start[some] + place
            inside = where < end[some]
            labels = self.viterbi(self.emissions(np.where(inside, x[np.minimum(where, len(x) - 1)], PAD)))
            if labels.any():
                # reconcile: the first half of an overlap belongs to the earlier window
                own = inside & ((place >= half) | (number[some] == 0)) & ((place < step + half) | last[some])
                out[where[own]] = labels[own]
        return out


def _added(labels: np.ndarray, x: np.ndarray, edges: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Spans of equal labels within each text, blanks at their ends cut off."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(edges) - 1)]
    if not labels.any():
        return out
    turn = np.concatenate([[True], labels[1:] != labels[:-1]])
    turn[edges[1:-1][edges[1:-1] < len(labels)]] = True
    starts = np.flatnonzero(turn)
    ends = np.concatenate([starts[1:], [len(labels)]])
    digits = np.concatenate([[0], np.cumsum(x == 1)])
    blank = (x == CLASSES[32]) | (x == CLASSES[10]) | (x == CLASSES[9])
    for a, b in zip(starts[labels[starts] > 0], ends[labels[starts] > 0]):
        kind = int(labels[a]) - 1
        while a < b and blank[a]:
            a += 1
        while b > a and blank[b - 1]:
            b -= 1
        if b - a >= LEAST_CHARS and digits[b] - digits[a] >= LEAST_DIGITS:
            d = int(np.searchsorted(edges, a, "right")) - 1
            out[d].append((kind, int(a - edges[d]), int(b - edges[d])))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """Fit a tagger on the base spans of a bounded sample: at most TRAIN_DOCS documents,
    chosen by a hash of the id among those with a digit or @, the first TRAIN_CHARS
    characters of each. Without a labelled span there is no tagger."""
    rows = docs.where(F.col(text_col).rlike("[0-9@]")).select(
        F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << 40)).alias("h"), F.substring(text_col, 1, TRAIN_CHARS).alias("t"))
    n = rows.count()
    part = rows.where(F.col("h") < min(1.0, (3 * TRAIN_DOCS + 20) / max(n, 1)) * (1 << 40)).limit(6 * TRAIN_DOCS).collect()
    rng = np.random.default_rng(11)
    xs, ys = [], []
    for _, text in sorted((r["h"], r["t"]) for r in part)[:TRAIN_DOCS]:
        x, y = classes(text), np.zeros(len(text), np.uint8)
        spans = base_spans(text)
        for kind, a, b in reversed(spans):
            y[a:b] = kind + 1
        x, y = (np.concatenate([v, np.zeros(TRAIN_WINDOW, np.uint8)]) for v in (x, y))
        # windows around each of at most eight spans, and two anywhere
        starts = [max(0, a - int(rng.integers(0, 40))) for _, a, _ in spans[:8]] + [int(s) for s in rng.integers(0, len(text), 2)]
        for s in starts:
            s = min(s, len(text))
            xs.append(x[s:s + TRAIN_WINDOW])
            ys.append(y[s:s + TRAIN_WINDOW])
    if not ys or not np.stack(ys).any():
        return None
    return Tagger().fit(np.stack(xs), np.stack(ys), STEPS)


def find(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, base) per row: arrays of (kind, start, end) ordered by kind (as in
    KINDS) and start; offsets count code points, ends are exclusive. ``base`` are the
    spans of the fixed patterns; ``spans`` has those and the tagger's spans that overlap
    none of them.

    Null and empty texts have no spans. Repeated rows are read alike; a null id stays
    null; an empty table gives no rows; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(tagger)

    def read(batches):
        tagger = held.value
        for batch in (part for whole in batches for part in slices(whole, 1, 500_000)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            every = base
            if tagger is not None:
                x = classes("".join(texts))
                edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                with np.errstate(over="ignore"):
                    added = _added(tagger.tag(x, edges), x, edges)
                every = [sorted(b + [s for s in a if all(s[2] <= o[1] or s[1] >= o[2] for o in b)]) if a else b for a, b in zip(added, base)]
            named = lambda spans: [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in row] for row in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named(every), kind), pa.array(named(base), kind)], ["doc_id", "spans", "base"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        read, f"doc_id long, spans {spans}, base {spans}")


def joined(spans):
    """Column: kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind in brackets (overlapping spans merge)."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
