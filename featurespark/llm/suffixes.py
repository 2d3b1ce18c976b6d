"""Suffix sorting by induced sorting in external memory, with common prefixes.

Suffixes that begin a rise after a fall (the LMS suffixes) are sorted first: their
substrings get names, and the string of names is sorted by the same procedure, until
it fits the memory limit. All other suffixes are induced from them in two scans. The
scans run over one queue for each first character, in which the entry order is the
suffix order, so that the queues together are the priority queue of the induction:
the next entry is the front of the first non-empty one. Entries are tuples (suffix,
common prefix with the entry before); a tuple induced from two scanned suffixes has
one more than the least common prefix between them. Queues beyond the memory limit
are written to a scratch file of the task, and read once, front to back.

Order and prefixes are exact up to DEPTH characters; longer agreement counts as DEPTH.
"""

from __future__ import annotations

import tempfile

import numpy as np

DEPTH = 100
#: entries of one step of a scan
STEP = 1 << 16


class Queues:
    """First-in-first-out queues of (suffix, common prefix) tuples by character. Beyond
    ``limit`` bytes everything held is moved to a scratch file."""

    def __init__(self, limit: int):
        self.limit, self.held, self.file = limit, 0, None
        self.parts: dict[int, list] = {}

    def push(self, char: int, suffixes: np.ndarray, prefixes: np.ndarray) -> None:
        self.parts.setdefault(char, []).append((suffixes, prefixes))
        self.held += suffixes.nbytes + prefixes.nbytes
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts.values():
            for i, part in enumerate(parts):
                if not isinstance(part[0], int):
                    at = self.file.tell()
                    self.file.write(part[0].tobytes())
                    self.file.write(part[1].tobytes())
                    parts[i] = (at, len(part[0]))
        self.held = 0

    def _load(self, part):
        if not isinstance(part[0], int):
            return part
        at, n = part
        self.file.seek(at)
        return np.frombuffer(self.file.read(4 * n), np.int32), np.frombuffer(self.file.read(n), np.uint8)

    def count(self, char: int) -> int:
        return len(self.parts.get(char, ()))

    def read(self, char: int, first: int = 0, last: int | None = None):
        """Tuples of the parts first to last of a queue, in blocks of about STEP."""
        yield from self._blocks(self.parts.get(char, [])[first:last])

    def backwards(self, char: int):
        """All tuples of a queue in reverse order, in blocks of about STEP."""
        for block in self._blocks(self.parts.get(char, [])[::-1], -1):
            yield block

    def _blocks(self, parts: list, way: int = 1):
        group, size = [], 0
        for i, part in enumerate(parts):
            group.append(self._load(part))
            size += len(group[-1][0])
            if size >= STEP or i + 1 == len(parts):
                yield tuple(np.concatenate(v)[::way] for v in zip(*group[::way]))
                group, size = [], 0

    def close(self) -> None:
        if self.file:
            self.file.close()


def _packed(x: np.ndarray) -> np.ndarray:
    """For every place, its next characters (four of 16 bits or two of 32) as one number;
    beyond the end the largest character."""
    bits = 8 * x.dtype.itemsize
    out = np.zeros(len(x), np.uint64)
    for k in range(64 // bits):
        out <<= np.uint64(bits)
        out[:len(x) - k] |= x[k:]
        out[max(0, len(x) - k):] |= np.uint64((1 << bits) - 1)
    return out


def _within(packed: np.ndarray, at: np.ndarray, offset: int, ends: np.ndarray, bits: int) -> np.ndarray:
    """The characters of each slice from ``offset`` on; beyond a slice's end the largest."""
    step = 64 // bits
    place = np.minimum(at + offset, len(packed) - 1)
    left = np.clip(ends - at - offset, 0, step)
    beyond = np.array([(1 << bits * (step - k)) - 1 for k in range(step + 1)], np.uint64)
    return packed[place] | beyond[left]


def _refine(rank: np.ndarray, active: np.ndarray, key: np.ndarray, whole: bool = False) -> np.ndarray:
    """Split the groups of equal rank of ``active`` by ``key``; a rank is the place of its
    group's first member. ``whole``: keys of a smaller rank are smaller. Returns the members
    of groups that are still larger than one."""
    old = rank[active]
    order = np.argsort(key) if whole or old.min() == old.max() else np.lexsort((key, old))
    active, key, old = active[order], key[order], old[order]
    new = np.ones(len(active), bool)
    new[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1])
    top = np.ones(len(active), bool)
    top[1:] = old[1:] != old[:-1]
    place = np.arange(len(active))
    inside = place - np.maximum.accumulate(np.where(top, place, 0))
    start = np.maximum.accumulate(np.where(new, place, 0))
    rank[active] = old + inside[start]
    alone = new & np.concatenate([new[1:], [True]])
    return active[~alone]


def _names(packed: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each LMS place to the next (both ends included). A
    longer substring sorts before its own prefix: there the prefix ends in a rise."""
    ends = np.concatenate([at[1:] + 1, [len(packed)]])
    rank, active, offset = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(active):
        active = _refine(rank, active, _within(packed, at[active], offset, ends[active], bits))
        offset += 64 // bits
        active = active[at[active] + offset <= ends[active]]     # one block past the end shows the end
    return np.unique(rank, return_inverse=True)[1]


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``names`` by their first 128 names, in memory."""
    n = len(names)
    counts = np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names]
    active, step = np.flatnonzero(counts[names] > 1), 1
    while len(active) and step < 128:
        ahead = active + step
        key = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        # one number for the group and the key: ranks are below 2**31
        active = _refine(rank, active, (rank[active] << 32) | key, True)
        step *= 2
    return np.argsort(rank, kind="stable")


def _common(packed: np.ndarray, bits: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of the suffix pairs (a, b), at most DEPTH. Suffixes differ before
    either ends: the end mark is nowhere else."""
    out, active, offset, step = np.zeros(len(a), np.int64), np.arange(len(a)), 0, 64 // bits
    while len(active) and offset < DEPTH:
        differ = packed[a[active] + offset] ^ packed[b[active] + offset]
        same = differ == 0
        out[active[same]] = offset + step
        differ = differ[~same]
        lead = np.zeros(len(differ), np.int64)
        for k in range(1, step):
            lead += (differ >> np.uint64(64 - bits * k)) == 0
        out[active[~same]] = offset + lead
        active = active[same]
        offset += step
    return np.minimum(out, DEPTH).astype(np.uint8)


class _Least:
    """Least value of any range of an array, by a table of doubled ranges."""

    #: largest power of two in a length, for lengths of one step
    LEVEL = np.concatenate([[0, 0], np.log2(np.arange(2, STEP + 2)).astype(np.int64)])

    def __init__(self, values: np.ndarray, longest: int):
        """``longest``: the longest range that will be asked for."""
        levels = int(self.LEVEL[longest]) + 1
        self.width = len(values)
        table = np.empty((levels, self.width), values.dtype)
        table[0] = values
        for k in range(1, levels):
            half = 1 << (k - 1)
            np.minimum(table[k - 1, :-half], table[k - 1, half:], out=table[k, :-half])
        self.table = table.reshape(-1)

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of values[low..high], low <= high."""
        level = self.LEVEL[high - low + 1]
        row = level * self.width
        return np.minimum(self.table[row + low], self.table[row + high - (1 << level) + 1])


class _Scan:
    """One direction of the induction: pushes the suffix before each scanned one if it has
    the wanted type, with the common prefix carried along."""

    def __init__(self, x, wanted, queues, prefixes: bool):
        self.x, self.wanted, self.queues, self.prefixes = x, wanted, queues, prefixes
        self.since = np.full(int(x.max()) + 1, -1, np.int16) if prefixes else None

    def step(self, at: np.ndarray, common: np.ndarray) -> None:
        if self.prefixes and len(at) > STEP:
            for i in range(0, len(at), STEP):
                self.step(at[i:i + STEP], common[i:i + STEP])
            return
        chosen = np.flatnonzero((at > 0) & self.wanted[at - 1])
        before = at[chosen] - 1
        chars = self.x[before]
        order = np.argsort(chars, kind="stable")
        chosen, before, chars = chosen[order], before[order], chars[order]
        first = np.ones(len(chars), bool)
        first[1:] = chars[1:] != chars[:-1]
        heads = np.flatnonzero(first)
        edges = np.append(heads, len(chars))
        if self.prefixes:
            carried = np.zeros(len(chars), np.int64)
            run = np.minimum.accumulate(common)
            later = np.flatnonzero(~first)
            if len(later):
                low, high = chosen[later - 1] + 1, chosen[later]
                carried[later] = 1 + _Least(common, int((high - low).max()) + 1)(low, high).astype(np.int64)
            seen = self.since[chars[heads]]
            carried[heads] = np.where(seen < 0, 0, 1 + np.minimum(seen, run[chosen[heads]]))
            carried = np.minimum(carried, DEPTH).astype(np.uint8)
            if len(common):
                self.since = np.where(self.since < 0, -1, np.minimum(self.since, run[-1])).astype(np.int16)
                rest = np.append(np.minimum.accumulate(common[::-1])[::-1], DEPTH)
                self.since[chars[heads]] = rest[chosen[edges[1:] - 1] + 1]
        else:
            carried = np.zeros(len(chars), np.uint8)
        before = before.astype(np.int32)
        for a, b in zip(edges[:-1], edges[1:]):
            self.queues.push(int(chars[a]), before[a:b], carried[a:b])


def _types(x: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last (the end mark) is."""
    n = len(x)
    differs = np.append(x[:-1] != x[1:], True)
    rises = np.append(x[:-1] < x[1:], True)
    at = np.where(differs, np.arange(n, dtype=np.int32), np.int32(n))
    return rises[np.minimum.accumulate(at[::-1])[::-1]]


def _induce(x: np.ndarray, limit: int, prefixes: bool):
    """Blocks (suffixes, common prefixes with the one before) of all suffixes of x in
    descending order. x ends in 0, which is nowhere else."""
    rising = _types(x)
    lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    packed, bits = _packed(x), 8 * x.dtype.itemsize
    if len(lms) > 1:
        order = np.empty(len(lms), np.int64)
        order[_names_order(packed, bits, lms, limit)] = lms
        lms = order
    common = np.zeros(len(lms), np.uint8)
    if prefixes and len(lms) > 1:
        common[1:] = _common(packed, bits, lms[:-1], lms[1:])
    chars = np.unique(x)
    seeds = np.searchsorted(x[lms], chars), np.searchsorted(x[lms], chars, "right")
    falls, rises = Queues(limit), Queues(limit)

    def joint(a, b) -> int:
        return int(_common(packed, bits, np.array([a]), np.array([b]))[0]) if prefixes and a is not None else 0

    scan = _Scan(x, ~rising, falls, prefixes)
    for c, low, high in zip(chars.tolist(), *(s.tolist() for s in seeds)):
        last, done = None, 0
        while done < (count := falls.count(c)):
            for at, shared in falls.read(c, done, count):
                scan.step(at, shared)
                last = at[-1]
            done = count
        if low < high:
            shared = common[low:high].copy()
            shared[0] = joint(last, lms[low])
            scan.step(lms[low:high], shared)
    scan = _Scan(x, rising, rises, prefixes)
    for c in chars[::-1].tolist():
        last, done = None, 0
        if c == 0:
            yield np.array([len(x) - 1], np.int32), np.zeros(1, np.uint8)
            break
        while done < (count := rises.count(c)):
            for at, shared in rises.read(c, done, count):
                yield at, shared
                scan.step(at, shared)
                last = at[-1]
            done = count
        between = None
        for at, shared in falls.backwards(c):
            # stored with the smaller neighbour; scanned downwards, with the larger one
            turned = np.concatenate([[joint(last, at[0]) if between is None else between], shared[:-1]]).astype(np.uint8)
            between = int(shared[-1])
            yield at, turned
            scan.step(at, turned)
    falls.close()
    rises.close()


def _names_order(packed: np.ndarray, bits: int, lms: np.ndarray, limit: int) -> np.ndarray:
    """Rank of each LMS suffix, from the order of the string of their substrings' names."""
    names = _names(packed, bits, lms)
    if names.max() + 1 == len(names):
        return names
    if 64 * len(names) <= limit:
        order = _doubled(names)
    else:
        order = np.concatenate([at for at, _ in _induce(names.astype(np.uint32), limit, False)])[::-1]
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    return rank


def descending(text: np.ndarray, limit: int = 256_000_000):
    """Blocks (suffixes, common prefixes with the suffix before, at most DEPTH) of all
    suffixes of the bytes ``text`` in descending order, within about ``limit`` bytes of
    queues besides the text itself and its types."""
    x = np.zeros(len(text) + 1, np.uint16)
    x[:-1] = text
    x[:-1] += 1
    for at, common in _induce(x, limit, True):
        keep = at < len(text)
        yield at[keep], common[keep]
