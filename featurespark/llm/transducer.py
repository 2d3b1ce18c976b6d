"""Minimal acyclic transducer from a sorted vocabulary to lexicographic ordinals."""

from __future__ import annotations

import io

import numpy as np


#: cells of the table that finds arcs at once; a larger automaton searches its sorted arcs
DENSE_CELLS = 8_000_000


class Transducer:
    """Automaton whose arcs carry outputs: along the path of a term they sum up to its place
    in byte order. States that accept the same rest of a term are one state.

    Arcs are sorted by ``key``, 256 * state + byte; arc 0 leads to state 0, the dead end.
    """

    def __init__(self, root: int, final: np.ndarray, key: np.ndarray, target: np.ndarray, output: np.ndarray):
        self.root, self.final, self.key, self.target, self.output = root, final, key, target, output
        used = np.unique(key[1:] & 255)
        self.classes = np.zeros(256, np.int32)           # class 0: a byte of no term
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width, self.table = len(used) + 1, None
        if len(final) * self.width <= DENSE_CELLS:
            self.table = np.zeros(len(final) * self.width, np.int32)
            self.table[(key[1:] >> 8) * self.width + self.classes[key[1:] & 255]] = np.arange(1, len(key))

    @classmethod
    def build(cls, terms: list[bytes]) -> "Transducer":
        """``terms`` ascend strictly in byte order."""
        known: dict[tuple, int] = {}
        arcs: list[tuple] = [()]                 # frozen states: ((byte, state), ...); 0 is the dead end
        final, below = [False], [0]              # and the number of terms each accepts
        path: list[list] = [[False, []]]         # open states along the last term: [final, arcs]
        last = b""

        def freeze(state: list) -> int:
            key = (state[0], tuple(state[1]))
            at = known.get(key)
            if at is None:
                at = known[key] = len(arcs)
                arcs.append(key[1])
                final.append(state[0])
                below.append(state[0] + sum(below[to] for _, to in key[1]))
            return at

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                at = freeze(path.pop())
                path[-1][1].append((last[len(path) - 1], at))

        for term in terms:
            common = 0
            while common < min(len(last), len(term)) and last[common] == term[common]:
                common += 1
            close(common)
            path.extend([False, []] for _ in range(len(term) - common))
            path[-1][0] = True
            last = term
        close(0)
        root = freeze(path[0])
        key, target, output = [-1], [0], [0]
        for state, out in enumerate(arcs):
            place = int(final[state])
            for byte, to in out:
                key.append(state * 256 + byte), target.append(to), output.append(place)
                place += below[to]
        return cls(root, np.array(final), np.array(key, np.int64), np.array(target, np.int32), np.array(output, np.int32))

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.final, self.key, self.target, self.output, self.table) if a is not None)

    def to_bytes(self) -> bytes:
        to = io.BytesIO()
        np.savez_compressed(to, root=self.root, final=self.final, key=self.key, target=self.target, output=self.output)
        return to.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> "Transducer":
        held = np.load(io.BytesIO(blob))
        return cls(int(held["root"]), held["final"], held["key"], held["target"], held["output"])

    def _arcs(self, state: np.ndarray, byte: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[state * self.width + symbol]
        wanted = state.astype(np.int64) * 256 + byte
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, at, 0)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ordinal of each term ``data[start:end]``, -1 for a term outside the vocabulary. All
        terms advance together, a byte at a time; those at a dead end drop out."""
        found = np.full(len(starts), -1, np.int64)
        live, at, state, sums = np.arange(len(starts)), starts, np.full(len(starts), self.root, np.int32), np.zeros(len(starts), np.int64)
        symbols = self.classes[data]
        end = ends
        while len(live):
            arc = self._arcs(state, data[at], symbols[at])
            state, sums, at = self.target[arc], sums + self.output[arc], at + 1
            over = at == end
            accepted = over & self.final[state]
            found[live[accepted]] = sums[accepted]
            going = ~over & (state > 0)
            live, at, end, state, sums = live[going], at[going], end[going], state[going], sums[going]
        return found
