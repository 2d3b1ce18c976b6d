"""Source divergence against counters, and the transducer against a dictionary."""
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from featurespark.llm import divergence, transducer

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_audit(rows, least, top):
    docs = [(lang or "", source or "", [lower(t) for t in TERM.findall(text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        frequency = Counter(t for _, _, ts in mine for t in set(ts))
        kept = sorted((t for t, n in frequency.items() if n >= least), key=str.encode)
        counts = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, ts in mine:
            counts[s].update(t for t in ts if frequency[t] >= least)
        whole = sum(counts.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in counts.items()}
        q = {t: 1 + 10**9 * (whole[t] + 5) // (sum(whole.values()) + 5 * len(kept)) for t in kept}
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((q[t] - p[s][t], t) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, -v, i + 1) for part, ranked in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_odd_rows_and_empty_table(spark, odd, none):
    for name in ("idx", "count", "total", "terms", "p", "q", "item", "value", "rank"):
        odd = odd.withColumn(name, F.lit(1))
    rows = [tuple(r) for r in odd.select("lang", "source", "text").collect()]
    assert rows_of(divergence.audit(odd, 2)) == plain_audit(rows, 2, 50)
    assert rows_of(divergence.audit(odd)) == plain_audit(rows, 30, 50)
    assert divergence.audit(none).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    assert rows_of(divergence.audit(docs, 3, 20)) == plain_audit(rows, 3, 20)


def test_shards_blocks_and_tiles_do_not_show(spark, monkeypatch):
    """One term a shard, one transducer a block, few sources and terms a task: as in one piece."""
    words = ["alpha", "Beta", "beta gamma", "éa", "ALPHA delta", "z" * 300]
    rows = [(f"l{i % 2}", f"s{i % 7}", " ".join(words[(i * j) % 6] for j in range(1, 5))) for i in range(60)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    monkeypatch.setattr(divergence, "TILE_TERMS", 3)
    recounted = divergence.recounted
    monkeypatch.setattr(divergence, "recounted", lambda texts, words: recounted(texts, words, 3, 400))
    assert rows_of(divergence.audit(df, 5)) == plain_audit(rows, 5, 50)


def test_shares_are_exact_beyond_64_bits(spark):
    cases = [(10**13, 3 * 10**14 + 7, 50_000), (0, 1, 1), (2**40, 2**41, 3), (9_300_000_000, 9_300_000_001, 1), (0, 0, 0)]
    got = [r["p"] for r in spark.createDataFrame(cases, "c long, n long, v long").repartition(1).select(divergence.share("c", "n", "v").alias("p")).collect()]
    assert got == [1 + 10**9 * (c + 5) // (n + 5 * v) if v else None for c, n, v in cases]


@pytest.mark.parametrize("cells", [transducer.DENSE_CELLS, 0])
@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=40), st.lists(st.binary(min_size=1, max_size=7).map(lambda b: bytes(97 + x % 4 for x in b)), max_size=20))
def test_ordinals(cells, terms, others):
    before, transducer.DENSE_CELLS = transducer.DENSE_CELLS, cells
    try:
        terms = sorted(terms)
        machine = transducer.Transducer.from_bytes(transducer.Transducer.build(terms).to_bytes())
    finally:
        transducer.DENSE_CELLS = before
    asked = terms + others
    ends = np.cumsum([len(t) for t in asked], dtype=np.int64)
    starts = ends - np.array([len(t) for t in asked], np.int64)
    got = machine.ordinals(np.frombuffer(b"".join(asked), np.uint8), starts, ends)
    place = {t: i for i, t in enumerate(terms)}
    assert got.tolist() == [place.get(t, -1) for t in asked]


def test_equal_endings_share_states():
    endings = transducer.Transducer.build(sorted(a + b for a in (b"walk", b"talk", b"jump") for b in (b"", b"ed", b"ing", b"s")))
    # root, alk, ump and its first letter, the stem's end, e, in, the end
    assert len(endings.final) - 1 == 12


class Task:
    """A table of one partition whose Arrow function runs here; ``out`` is what leaves it."""

    def __init__(self, spark, rows):
        self.sparkSession, self.rows = spark, pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "text"), r)) for r in rows])

    def where(self, condition):
        return self

    def mapInArrow(self, function, schema):
        self.out = [r for b in function(iter([self.rows, self.rows])) for r in b.to_pylist()]
        return self.sparkSession.createDataFrame([tuple(r.values()) for r in self.out], schema)


@pytest.mark.parametrize("held", [1_000_000, 5])
def test_a_task_adds_up_its_slices(spark, monkeypatch, held):
    """A term leaves a task once for many slices, and passes a transducer once for a slice."""
    monkeypatch.setattr(divergence, "SLICE", 60)
    monkeypatch.setattr(divergence, "HELD_ROWS", held, raising=False)
    walked, ordinals = [], transducer.Transducer.ordinals
    monkeypatch.setattr(transducer.Transducer, "ordinals", lambda self, data, starts, ends: walked.append(len(starts)) or ordinals(self, data, starts, ends))
    task = Task(spark, [(f"l{i % 2}", f"s{i % 3}", "beta Alpha beta, gamma beta") for i in range(30)])
    docs = divergence.document_counts(task)
    assert {tuple(r) for r in docs.collect()} == {(f"l{i}", t, 30) for i in range(2) for t in ("alpha", "beta", "gamma")}
    assert len(task.out) == 6 or held == 5
    block = [(f"l{i}", 0, transducer.Transducer.build([b"alpha", b"beta"]).to_bytes()) for i in range(2)]
    counts = divergence._recount(task, block).groupBy("lang", "source", "idx").agg(F.sum("count"))
    assert {tuple(r) for r in counts.collect()} == {(f"l{i}", f"s{j}", t, n) for i in range(2) for j in range(3) for t, n in ((0, 10), (1, 30))}
    assert (len(task.out) == 12 or held == 5) and max(walked) <= 3
