"""Registered queries against SQL or plain Python, and the pipeline stage by stage."""
import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from featurespark.llm import queries
from tools.oracle_check import check

from .test_operators import brute_bytes, brute_components, brute_words, plain_spans, shingles, words

SF = "/root/testdata/sf0.001"


def documents(spark, sf=SF):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(entry.oracle_sql()) >= set(queries.ORACLE)


def test_sql_twins(spark):
    results = check(list(queries.ORACLE), "/root/testdata/sf0.01", spark)
    assert {k: v[0] for k, v in results.items()} == dict.fromkeys(queries.ORACLE, "ok")


def test_op1(spark):
    want = {}
    for i, t in documents(spark):
        spans = plain_spans(t)
        text = ",".join(f"{queries.pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        want[i] = [sum(s[0] == k for s in spans) for k in range(4)] + [sha(text.encode())]
    got = queries.op1_pii(spark, SF).collect()
    assert {r["doc_id"]: [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]] for r in got} == want
    assert all(len([s for s in r["spans"].split(",") if s]) == sum(r[1:5]) + r["n_added"] for r in got)


def test_op3_op4_op6_against_plain_python(spark):
    docs = documents(spark)
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op3_substring_dedup(spark, SF).collect()}
    assert got == {(i, n, k, sha(t.encode())) for i, n, k, t in brute_words(docs, 13)}
    assert sorted((tuple(r) for r in queries.op4_ngram_jaccard(spark, SF).collect()), key=repr) == brute_components(docs, 4, 85)
    got = {tuple(r) for r in queries.op6_suffix_array_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == {(i, n, k, len(s), sha(b)) for i, n, k, s, b in brute_bytes(docs)}


def test_op7_separates_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op7_lm_scoring(spark, sf).join(labels, "doc_id").groupBy("quality").agg(F.avg("ce_diff").alias("d")).collect()
    by = {r["quality"]: r["d"] for r in out}
    assert by[1] < by[0]


def test_op8_round_trip(spark):
    assert queries.op8_sentencepiece(spark, SF).where(~F.col("round_trip")).count() == 0


def plain_lines(docs):
    """Three-line windows judged on the input, first by (doc_id, position)."""
    first = {}
    for i, t in sorted(docs):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            first.setdefault(tuple(lines[p:p + 3]), (i, p))
    out = []
    for i, t in docs:
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            if first[tuple(lines[p:p + 3])] < (i, p):
                gone |= {p, p + 1, p + 2}
        if len(gone) < len(lines):
            out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    return out


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame, kept = docs, None
    for name, step in corpus_pipeline.STAGES:
        before = kept if kept is not None else documents(spark)
        frame = step(spark, frame, SF)
        if name != "sentencepiece":
            assert frame.columns == docs.columns
            kept = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
        if name == "language_id":
            assert set(kept) <= set(before) and all(any(c.isalpha() for c in t) for _, t in kept)
            assert len(kept) == sum(any(c.isalpha() for c in t) for _, t in before)
        elif name == "line_dedup":
            assert sorted(kept) == sorted(plain_lines(before))
            assert all(r["n_chars"] == len(r["text"]) for r in frame.collect() if dict(before)[r["doc_id"]] != r["text"])
        elif name == "near_duplicates":
            assert sorted(i for i, _ in kept) == sorted(i for i, _, c, _ in brute_components(before, 5, 80) if i == c)
        elif name == "decontamination":
            items = [shingles(r["text"], 5, False) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            clean = [i for i, t in before if not any(s and 100 * len(s & shingles(t, 5, False)) >= 80 * len(s) for s in items)]
            assert sorted(i for i, _ in kept) == sorted(clean)
    assert sorted(r["doc_id"] for r in frame.collect()) == sorted(i for i, _ in kept)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(whole.select("doc_id", "n_pieces").collect()) == sorted(frame.select("doc_id", "n_pieces").collect())


def test_pipeline_stages_on_odd_and_empty_tables(odd, none, spark):
    for docs in (odd, none):
        frame = docs
        for name, step in corpus_pipeline.STAGES:
            frame = step(spark, frame, SF)
            if name != "sentencepiece":
                assert frame.columns == docs.columns
        ids = [r["doc_id"] for r in frame.collect()]
        assert (ids == []) == (docs is none)
        assert 3 not in ids and 13 not in ids and 11 not in ids


@pytest.mark.parametrize("name", ["one", "three words here"])
def test_words_helper(name):
    import pyarrow as pa
    from featurespark.llm.words import Words
    texts = [name, None, "", " x", "y", "Tail\t\n"]
    w = Words(pa.array(texts), lower=True)
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    found = [bytes(w.text[a:b]).decode() for a, b in zip(w.starts, w.ends)]
    assert found == [x for t in texts for x in words(t, True)]
    assert len(set(w.hashes().tolist())) == len(set(found))
