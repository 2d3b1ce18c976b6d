"""Key tuples at given ranks of the ascending order, without sorting the table.

A rank is bracketed by two tuples of a bounded sample around it. One pass counts the rows below
and inside each bracket, which proves on which side of the bracket the rank lies; the next
sample comes from that part alone. A bracket shrinks by about the square root of the sample's size
each time, and ends when its few rows are read whole or its bounds meet (a value that many rows
share); where samples no longer tighten it, it is split at one value, which always does. Only samples and counts move: no row is shuffled.
"""

from __future__ import annotations

import datetime
import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ntz_lit

#: tuples that are sampled for all ranks together
SAMPLE_ROWS = 200_000


def literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType) and value is not None:
        return ntz_lit(value)
    if isinstance(kind, T.TimestampType) and value is not None:
        # by microseconds, whatever the session's time zone
        since = value.astimezone(datetime.timezone.utc) - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
        return F.timestamp_micros(F.lit(since // datetime.timedelta(microseconds=1)))
    return F.lit(value).cast(kind)


def order_of(values: tuple) -> tuple:
    """Spark's ascending order: NULL first, NaN last."""
    return tuple((0,) if v is None else (2,) if isinstance(v, float) and math.isnan(v) else (1, v) for v in values)


@dataclass(frozen=True)
class Bracket:
    """Bounds (None: open) around ``rank``, and the rows below and inside."""

    rank: int
    below: int
    inside: int
    low: tuple | None = None
    high: tuple | None = None
    low_open: bool = False
    high_open: bool = False

    def settled(self) -> bool:
        return self.low is not None and self.high is not None and order_of(self.low) == order_of(self.high)


class Selection:
    def __init__(self, df: DataFrame, keys: list[Column], sample_rows: int = SAMPLE_ROWS):
        self.df = df.select(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"))
        self.kinds = [f.dataType for f in self.df.schema["key"].dataType.fields]
        self.key, self.sample_rows = F.col("key"), sample_rows

    def tuple_of(self, values: tuple) -> Column:
        return F.struct(*[literal(v, kind).alias(f"k{i}") for i, (v, kind) in enumerate(zip(values, self.kinds))])

    def _under(self, b: Bracket) -> Column:
        if b.low is None:
            return F.lit(False)
        low = self.tuple_of(b.low)
        return self.key <= low if b.low_open else self.key < low

    def _within(self, b: Bracket) -> Column:
        if b.high is None:
            return ~self._under(b)
        high = self.tuple_of(b.high)
        return ~self._under(b) & (self.key < high if b.high_open else self.key <= high)

    def _counts(self, brackets: list[Bracket]) -> list[tuple[int, int]]:
        row = self.df.agg(*[c for i, b in enumerate(brackets) for c in (
            F.count_if(self._under(b)).alias(f"u{i}"), F.count_if(self._within(b)).alias(f"w{i}"))]).first()
        return [(row[f"u{i}"], row[f"w{i}"]) for i in range(len(brackets))]

    def around(self, tuples: list[tuple]) -> list[tuple[int, int]]:
        """(rows below, rows equal) of each tuple."""
        return self._counts([Bracket(0, 0, 0, t, t) for t in tuples])

    def _samples(self, brackets: list[Bracket], rows: int, seed: int) -> list[list[tuple]]:
        """About ``rows`` tuples inside each bracket, ascending; all of them where there are no more."""
        chance = [1.0 if b.inside <= rows else rows / b.inside for b in brackets]
        drawn = F.array_compact(F.array(*[F.when(self._within(b) & (F.rand(seed + i) < p if p < 1 else F.lit(True)), F.lit(i))
                                          for i, (b, p) in enumerate(zip(brackets, chance))]))
        out: list[list[tuple]] = [[] for _ in brackets]
        for r in self.df.select("key", drawn.alias("of")).where(F.size("of") > 0).collect():     # bounded by the sample
            for i in r["of"]:
                out[i].append(tuple(r["key"]))
        return [sorted(s, key=order_of) for s in out]

    def at(self, ranks: list[int], n: int) -> list[tuple]:
        """The tuple at each 1-based rank of the ``n`` rows."""
        done: dict[int, tuple] = {}
        open_ = [Bracket(r, 0, n) for r in dict.fromkeys(ranks)]
        seed = 0
        while open_:
            rows, seed = max(1000, self.sample_rows // len(open_)), seed + 101
            narrowed = []
            for b, sample in zip(open_, self._samples(open_, rows, seed)):
                if b.inside <= rows:
                    done[b.rank] = sample[b.rank - b.below - 1]
                    continue
                share = (b.rank - b.below) / b.inside
                margin = 4 * math.sqrt(len(sample) * share * (1 - share)) + 3
                left, right = math.floor(share * len(sample) - margin), math.ceil(share * len(sample) + margin)
                new = b
                if 0 <= left < len(sample):
                    new = replace(new, low=sample[left], low_open=False)
                if 0 <= right < len(sample):
                    new = replace(new, high=sample[right], high_open=False)
                if new == b and sample:
                    # one value fills the part up to its edge: count that value alone
                    pivot = sample[min(max(math.floor(share * len(sample)), 0), len(sample) - 1)]
                    new = replace(b, low=pivot, high=pivot, low_open=False, high_open=False)
                narrowed.append((b, new))
            open_ = []
            for (old, new), (below, inside) in zip(narrowed, self._counts([new for _, new in narrowed]) if narrowed else ()):
                if new.rank <= below:                                   # left of the new bounds
                    new = replace(old, inside=below - old.below, high=new.low, high_open=True)
                elif new.rank > below + inside:                         # right of them
                    gone = below + inside - old.below
                    new = replace(old, below=below + inside, inside=old.inside - gone, low=new.high, low_open=True)
                else:
                    new = replace(new, below=below, inside=inside)
                    if new.settled():
                        done[new.rank] = new.low
                        continue
                open_.append(new)
        return [done[r] for r in ranks]
