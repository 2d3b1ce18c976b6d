"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from featurespark.llm import curve_search, decontaminate, divergence, exact_dedup, jaccard_join, language_id, line_dedup, lm_score, merkle, pieces, pii, substring_dedup, suffix_dedup
from featurespark.llm.shared import reach


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"op2_digests_{uuid.uuid4().hex}")
    out = exact_dedup.dedup_against_index(_table(spark, sf_dir, "documents"), index)
    index.drop()                     # the query's own; its decisions are staged
    return out


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the remaining lines joined by a line feed)."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col(out.columns[-2]).alias("n_lines"), F.col(out.columns[-1]).alias("n_removed"),
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.repeated_word_cover(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every document."""
    return jaccard_join.link_components(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (doc_id, item_id) of documents that contain a benchmark item."""
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target documents: those labelled of good quality and not toxic."""
    good = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return lm_score.score(_table(spark, sf_dir, "documents"), good)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents"), pieces.PieceModel())


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_byte_cover(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_search.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered: documents whose id, as text, has a crc32 divisible by 5."""
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_exact_dedup, op3_substring_dedup, op4_ngram_jaccard, op5_language_id, op6_suffix_array_dedup, op7_lm_scoring, op8_sentencepiece, op9_decontaminate, op10_line_dedup,
                                  op11_curve_neighbours, op12_merkle_manifest, op13_source_divergence)}

ORACLE = {
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept, text_sha256
        FROM d""",
    "op10_line_dedup": r"""
        WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        x AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM l),
        w AS (SELECT doc_id, pos, line, {'a': line, 'b': lead(line, 1) OVER d, 'c': lead(line, 2) OVER d} AS k,
                     lead(pos, 2) OVER d IS NOT NULL AS whole FROM x WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
        f AS (SELECT doc_id, pos, line, whole AND row_number() OVER (PARTITION BY whole, k ORDER BY doc_id, pos) > 1 AS later FROM w),
        g AS (SELECT *, max(later::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone FROM f),
        s AS (SELECT doc_id, count(*) AS n_lines, sum(gone)::BIGINT AS n_removed,
                     coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone = 0), '') AS kept FROM g GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN s USING (doc_id)""",
    "op3_substring_dedup": r"""
        WITH l AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
        x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM l),
        w AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS pos, ws FROM l WHERE len(ws) >= 13),
        k AS (SELECT doc_id, pos, md5(array_to_string(ws[pos:pos + 12], ' ')) AS k FROM w),
        f AS (SELECT doc_id, pos FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS least FROM k) WHERE least < doc_id),
        g AS (SELECT x.*, max(f.pos IS NOT NULL) OVER (PARTITION BY x.doc_id ORDER BY x.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
              FROM x LEFT JOIN f ON f.doc_id = x.doc_id AND f.pos = x.pos),
        s AS (SELECT doc_id, count(*) AS n_words, sum(gone::INT)::BIGINT AS n_removed,
                     coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN s USING (doc_id)""",
    "op4_ngram_jaccard": r"""
        WITH RECURSIVE l AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') AS g
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS p FROM l WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, d.c AS component_id, coalesce(k.n, 0)::BIGINT AS n_links
        FROM (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) d LEFT JOIN n USING (doc_id)
        LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM e GROUP BY a) k USING (doc_id)""",
    "op9_decontaminate": r"""
        WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
        l AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x20\x09-\x0D]+') AS ws FROM t),
        s AS (SELECT DISTINCT kind, id, array_to_string(ws[p:p + 4], ' ') AS g
              FROM (SELECT kind, id, ws, unnest(range(1, len(ws) - 3)) AS p FROM l WHERE len(ws) >= 5)),
        m AS (SELECT id, count(*) AS m FROM s WHERE kind = 'i' GROUP BY id),
        c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n FROM s d JOIN s i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' GROUP BY 1, 2)
        SELECT doc_id, item_id, m AS n_shingles, n AS n_common, n / m AS containment FROM c JOIN m ON m.id = item_id WHERE 100 * n >= 80 * m""",
    "op12_merkle_manifest": r"""
        WITH RECURSIVE c AS (SELECT *, coalesce('s' || source, '') AS k,
                   CASE WHEN doc_id IS NULL THEN false ELSE xor(list_reduce(list_concat([4294967295], flatten(list_transform(
                       string_split(doc_id::VARCHAR, ''), lambda x: [1000 + ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
                       lambda r, s: CASE WHEN s >= 0 THEN xor(r, s - 1000) ELSE xor(r >> 1, 3988292384 * (r & 1)) END), 4294967295) % 5 = 0 END AS bad
            FROM documents),
        f AS (SELECT doc_id, k, bad, concat(
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                   coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
                   coalesce(strlen(text) || ':' || text, '-') AS body FROM c),
        h AS (SELECT doc_id, k, sha256(head || body) AS leaf, CASE WHEN bad THEN
                     sha256(head || translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS changed FROM f),
        i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n FROM h),
        t(lvl, k, idx, n, hash) AS (SELECT 0, k, idx, n, leaf FROM i
            UNION ALL SELECT lvl + 1, k, idx // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY lvl, k, idx // 16, n),
        s AS (SELECT k, hash, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
        u(lvl, idx, n, hash) AS (SELECT 0, idx, n, hash FROM s
            UNION ALL SELECT lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY lvl, idx // 16, n),
        x AS (SELECT lvl, k, idx, string_agg(hash, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS l,
                     string_agg(hash, '') OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS r
              FROM t WHERE n > 1 WINDOW w AS (PARTITION BY lvl, k, idx // 16 ORDER BY idx)),
        y AS (SELECT lvl, idx, string_agg(hash, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS l,
                     string_agg(hash, '') OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS r
              FROM u WHERE n > 1 WINDOW w AS (PARTITION BY lvl, idx // 16 ORDER BY idx)),
        d AS (SELECT k, max(lvl) AS depth FROM t GROUP BY k),
        p AS (SELECT i.k, i.idx, x.lvl AS ht, coalesce(x.l, '') AS l, coalesce(x.r, '') AS r
              FROM i JOIN x ON x.k = i.k AND x.idx = i.idx // (16 ** x.lvl)::BIGINT
              UNION ALL SELECT i.k, i.idx, d.depth + y.lvl, coalesce(y.l, ''), coalesce(y.r, '')
              FROM i JOIN d ON d.k = i.k JOIN s ON s.k = i.k JOIN y ON y.idx = s.idx // (16 ** y.lvl)::BIGINT),
        z(k, idx, ht, hash) AS (SELECT k, idx, 0, coalesce(changed, leaf) FROM i
            UNION ALL SELECT z.k, z.idx, z.ht + 1, sha256(p.l || z.hash || p.r) FROM z JOIN p ON p.k = z.k AND p.idx = z.idx AND p.ht = z.ht),
        g AS (SELECT k, idx, arg_max(hash, ht) AS folded_root FROM z GROUP BY k, idx),
        q AS (SELECT k, idx, string_agg(l || r, '' ORDER BY ht) AS others FROM p GROUP BY k, idx)
        SELECT i.doc_id, i.leaf, s.hash AS subroot, u.hash AS root, sha256(coalesce(q.others, '')) AS proof_sha256, g.folded_root, g.folded_root = u.hash AS verified
        FROM i JOIN s ON s.k = i.k JOIN u ON u.n = 1 JOIN g ON g.k = i.k AND g.idx = i.idx LEFT JOIN q ON q.k = i.k AND q.idx = i.idx""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                 '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        v AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t JOIN v USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        m AS (SELECT lang, count(*)::HUGEINT AS v FROM v GROUP BY lang),
        n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (SELECT n.lang, n.source, v.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 5) // (n.n + 5 * m.v) AS p
              FROM n JOIN m ON m.lang = n.lang JOIN v ON v.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = v.term),
        w AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM c GROUP BY ALL),
        q AS (SELECT w.lang, w.term, 1 + 1000000000 * (w.c + 5) // (k.n + 5 * m.v) AS q
              FROM w JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM n GROUP BY lang) k ON k.lang = w.lang JOIN m ON m.lang = w.lang),
        a AS (SELECT x.lang, x.source, y.source AS item, coalesce(z.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
              LEFT JOIN (SELECT e.lang, e.source, f.source AS item, sum(abs(e.p - f.p)) AS value FROM p e JOIN p f ON e.lang = f.lang AND e.term = f.term AND e.source <> f.source
                         GROUP BY ALL) z ON z.lang = x.lang AND z.source = x.source AND z.item = y.source),
        b AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.c > 0 AND p.p > q.q),
        o AS (SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM a
              UNION ALL SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT FROM b)
        SELECT * FROM o WHERE part = 'pair' OR rank <= 50""",
}
