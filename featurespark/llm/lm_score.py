"""Document scores by the difference of cross-entropies of two language models.

The target model counts the n-grams of the documents labelled good, the background
model those of all documents. Both are word bigram models of the same order, over one
vocabulary (the words of the corpus) with the same Dirichlet smoothing, so the losses
of a token can be subtracted. The counts are exact and cover the whole corpus: each
batch sends its distinct unigrams and bigrams with both counts, and gets the sums back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featurespark.llm import exchange as x
from featurespark.llm.shared import NULL_ID, batch_count, batched, bucket_count, text_bytes
from featurespark.llm.words import U64, Words, mix

BATCH_BYTES = 4_000_000
#: weight, in tokens, of the lower-order estimate
MU_WORD, MU_PAIR = 1000.0, 8.0
#: keys of the number of tokens, and of documents with any (the count of the border mark)
TOTAL, BORDER = U64(0x7F4A7C159E3779B9), U64(0x85EBCA6BC2B2AE35)
#: a corpus's counts; those of one batch fit 32 bits
COUNTS = np.dtype([("target", "<i8"), ("all", "<i8")])
KEY_BITS = 48


class Tokens:
    """Words (A-Z lowered) of a batch and the keys of their unigrams and bigrams. The
    word before a document's first is a border mark; ``before`` is the unigram key of the
    word before each. A bigram's context counts all its occurrences, so what its
    followers leave over is the chance that a document ends there."""

    def __init__(self, table: pa.Table):
        words = Words(table["text"], lower=True)
        self.docs, self.n = words.doc, len(words.counts)
        word = words.hashes()
        firsts = words.first[:-1][words.counts > 0]
        before = np.zeros(len(word), U64)
        before[1:] = word[:-1]
        before[firsts] = U64(0x9E37)
        self.word = mix(word + U64(1))
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[firsts] = BORDER
        self.pair = mix(before * U64(0xC2B2AE3D27D4EB4F) + word)
        self.first_docs = words.doc[firsts]


def _sums(group, groups, _source, values):
    out = np.empty(len(group), COUNTS)
    for name, v in zip(COUNTS.names, values):
        out[name] = np.bincount(group, v, groups).astype(np.int64)[group]
    return out


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ce_target, ce_background, ce_diff): mean loss of a token in bits
    under both models, and target minus background; the lower, the more the document
    reads like the target documents, whose ids are the rows of ``target``.

    Null, empty and blank texts have no tokens and null scores. Rows that repeat an id
    are all target or all background; a null id is background. Without target documents
    both models agree and ce_diff is 0. An empty table gives no rows; other columns are
    not read.
    """
    spark = docs.sparkSession
    total = text_bytes(docs, text_col)
    batches, buckets = batch_count(spark, total, BATCH_BYTES), bucket_count(spark, total)
    texts = batched(docs, batches, id_col, text_col)
    wanted = target.select(F.col(target_id).cast("long").alias("id")).where("id is not null").select(
        F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"), "id")
    plan = x.Plan(buckets, KEY_BITS)

    def count(batch, table, good):
        tokens = Tokens(table)
        ids = table["id"].fill_null(NULL_ID).to_numpy()
        chosen = np.isin(ids, good["id"].to_numpy())[tokens.docs]
        target_docs = np.isin(ids, good["id"].to_numpy())[tokens.first_docs]
        special = np.array([TOTAL, BORDER], U64)
        keys, group = np.unique(plan.cut(np.concatenate([tokens.word, tokens.pair, special])), return_inverse=True)
        weight = lambda of, docs: np.bincount(group, np.concatenate([of, of, [of.sum(), docs]]), len(keys)).astype(np.uint32)
        return plan.send(batch, keys, [weight(chosen, target_docs.sum()), weight(np.ones(len(tokens.word)), len(tokens.first_docs))])

    sums = x.ask(texts, count, _sums, [np.uint32, np.uint32], wanted)

    def finish(_key, table, answer):
        tokens = Tokens(table)
        if not len(tokens.word):
            return _result(table, tokens, np.zeros(0), np.zeros(0))
        special = np.array([TOTAL, BORDER], U64)
        n = len(tokens.word)
        keys, group = np.unique(plan.cut(np.concatenate([tokens.word, tokens.pair, special])), return_inverse=True)
        held = x.replies(answer, keys, plan, COUNTS)
        word, pair, total = held[group[:n]], held[group[n:2 * n]], held[group[2 * n]]
        context = np.empty(n, COUNTS)
        context[1:] = word[:-1]
        context[tokens.before == BORDER] = held[group[2 * n + 1]]
        general = word["all"] / total["all"]
        wanted_ = (word["target"] + MU_WORD * general) / (total["target"] + MU_WORD)
        losses = [-np.log2((pair[f] + MU_PAIR * p) / (context[f] + MU_PAIR)) for f, p in (("target", wanted_), ("all", general))]
        return _result(table, tokens, *losses)

    return texts.groupBy("batch").cogroup(sums.groupBy("batch")).applyInArrow(
        finish, "doc_id long, n_tokens long, ce_target double, ce_background double, ce_diff double")


def _result(table, tokens, target, background):
    n = np.bincount(tokens.docs, minlength=tokens.n)
    none = n == 0
    a, b, diff = (np.bincount(tokens.docs, v, tokens.n) / np.maximum(n, 1) for v in (target, background, target - background))
    column = lambda v: pa.array(np.round(v, 6), mask=none)
    return pa.table({"doc_id": table["id"], "n_tokens": n.astype(np.int64), "ce_target": column(a), "ce_background": column(b), "ce_diff": column(diff)})
