"""Each operator on odd input, against plain Python, and on an empty table."""
import hashlib
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurespark.llm import (decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, lm_score, pieces, pii,
                             substring_dedup, suffix_dedup)

from .conftest import LINES, ROWS

LAST = 1 << 62


def words(text, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingles(text, size, whole):
    w = words(text, True)
    if len(w) < size:
        return {tuple(w)} if w and whole else set()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def rows(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, repr(r)))


def test_exact_dedup(spark, odd, none):
    index = exact_dedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex}", 4)
    assert exact_dedup.dedup_against_index(none, index).count() == 0
    got = rows(exact_dedup.dedup_against_index(odd, index))
    assert len(got) == len(ROWS)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for r in got:
        texts = {hashlib.sha256(norm(t).encode()).hexdigest() for i, t, *_ in ROWS if i == r["doc_id"]}
        assert r["text_sha256"] in texts
        group = [(i, t or "") for i, t, *_ in ROWS if hashlib.sha256(norm(t).encode()).hexdigest() == r["text_sha256"]]
        assert r["group_size"] == len(group)
        assert r["keep_id"] == min(group, key=lambda g: (-len(g[1]), g[0] is None, g[0] or 0))[0]
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    # of the empty texts the blank one has the most code points
    assert {r["doc_id"]: r["keep_id"] for r in got if r["doc_id"] in (3, 4, 5)} == {3: 5, 4: 5, 5: 5}


def test_digest_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex}", 4)
    make = lambda data: spark.createDataFrame(data, "doc_id long, text string")
    exact_dedup.dedup_against_index(make([(5, "a b"), (6, "c")]), index)
    later = exact_dedup.DigestIndex(spark, index.table)
    got = rows(exact_dedup.dedup_against_index(make([(1, "ab"), (2, "d"), (3, "d ")]), later))
    assert [(r["doc_id"], r["keep_id"], r["kept"]) for r in got] == [(1, 5, False), (2, 3, False), (3, 3, True)]
    assert {r["keep_id"] for r in later.rows().collect()} == {3, 5, 6}
    plan = spark.table(index.table).select("digest").join(later.rows().select("digest").hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Exchange hashpartitioning" not in text


def test_digest_index_is_read_in_order_after_compaction(spark):
    """Three batches: the last meets all digests of the others; a bucket of one file needs no sort."""
    index = exact_dedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex}", 2)
    make = lambda ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    exact_dedup.dedup_against_index(make(range(200)), index)
    exact_dedup.dedup_against_index(make(range(100, 400)), index)
    assert index.rows().count() == 400

    def index_sorts():
        with index.in_order():
            found = spark.createDataFrame([(bytearray(b"x"),)], "digest binary")
            text = index.new(found)._jdf.queryExecution().executedPlan().toString()
        return text.count("Sort [") - 1                   # but the new digests' own
    assert index_sorts() == 1
    index.compact()
    assert index.rows().count() == 400 and index_sorts() == 0 and exact_dedup.DigestIndex(spark, index.table).buckets == 2
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"
    got = exact_dedup.dedup_against_index(spark.createDataFrame([(1000 + i, f"text  {i}") for i in range(500)], "doc_id long, text string"), index)
    assert got.where("kept").count() == 100 and index.rows().count() == 500
    index.drop()


def test_the_query_leaves_no_table(spark):
    from featurespark.llm import queries
    before = {t.name for t in spark.catalog.listTables()}
    out = queries.op2_exact_dedup(spark, "/root/testdata/sf0.001")
    assert {t.name for t in spark.catalog.listTables()} == before and out.count() == 200


def test_line_dedup(odd, none):
    assert line_dedup.dedup_lines(none).count() == 0
    out = line_dedup.dedup_lines(odd)
    assert out.columns[:-2] == odd.columns and len(set(out.columns)) == len(out.columns)
    got = rows(out.select("doc_id", "source", "text", F.col(out.columns[-2]).alias("lines"), F.col(out.columns[-1]).alias("removed")))
    assert len(got) == len(ROWS)
    by = {(r["doc_id"], r["source"]): r for r in got}
    assert by[(1, "a")]["text"] == ROWS[0][1] and by[(1, "a")]["removed"] == 0
    assert by[(2, "a")]["text"] == "an own start\nand another end" and by[(2, "a")]["removed"] == 3
    assert by[(13, "a")]["text"] == "" and by[(13, "a")]["removed"] == 4 == by[(13, "a")]["lines"]
    assert by[(None, None)]["text"] == "a document without an id"
    assert (by[(3, None)]["text"], by[(3, None)]["lines"]) == (None, 0)
    assert (by[(4, "b")]["text"], by[(4, "b")]["lines"]) == ("", 1)


def test_removing_lines_takes_time_in_proportion(spark):
    """Two equal documents of many lines, all of which repeat."""
    import time
    took = []
    for n in (20_000, 160_000):
        text = "\n".join(f"line {i}" for i in range(n))
        df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
        start = time.time()
        got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
        took.append(time.time() - start)
        assert got[1]["text"] == text and (got[2]["text"], got[2]["__n_removed"]) == ("", n)
    assert took[1] < 8 * took[0] + 10


def test_line_windows_within_a_document(spark):
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, "a\nb\nc\na\nb\nc\nd\nb\nc\n")], "doc_id long, text string")).first()
    assert got["text"] == "a\nb\nc\nd\nb\nc\n" and got["__n_removed"] == 3
    same = line_dedup.dedup_lines(spark.createDataFrame([(1, "x\nx\nx\nx\nx")], "doc_id long, text string")).first()
    assert same["text"] == "" or same["text"].count("x") == 1    # windows 2 and 3 cover lines 2 to 5
    assert same["__n_removed"] == 4


def brute_words(data, size):
    least = {}
    for i, t, *_ in data:
        w = words(t)
        for p in range(len(w) - size + 1):
            k = tuple(w[p:p + size])
            least[k] = min(least.get(k, LAST), LAST if i is None else i)
    out = []
    for i, t, *_ in data:
        w, gone = words(t), set()
        for p in range(len(w) - size + 1):
            if least[tuple(w[p:p + size])] < (LAST if i is None else i):
                gone |= set(range(p, p + size))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [4, 13])
def test_substring_dedup(odd, none, size):
    assert substring_dedup.repeated_word_cover(none, size).count() == 0
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.repeated_word_cover(odd, size).collect()]
    assert sorted(got, key=repr) == brute_words(ROWS, size)


def brute_components(data, size, percent):
    ids = [LAST if d[0] is None else d[0] for d in data]
    sets = [shingles(d[1], size, True) for d in data]
    links = [[b for b, t in enumerate(sets) if b != a and s and t and 100 * len(s & t) >= percent * len(s | t)] for a, s in enumerate(sets)]
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in range(len(data)):
            for b in links[a]:
                if label[ids[a]] < label[ids[b]]:
                    label[ids[b]], changed = label[ids[a]], True
    return sorted(((d[0], len(s), None if label[i] == LAST else label[i], len(n)) for d, s, i, n in zip(data, sets, ids, links)), key=repr)


@pytest.mark.parametrize("size,percent", [(4, 85), (2, 50), (5, 80)])
def test_jaccard_join(spark, odd, none, size, percent):
    assert jaccard_join.link_components(none, size, percent).count() == 0
    got = [tuple(r) for r in jaccard_join.link_components(odd, size, percent).collect()]
    assert sorted(got, key=repr) == brute_components(ROWS, size, percent)


def test_jaccard_chain_and_near_misses(spark, monkeypatch):
    """Links only through middle members, near misses, and grams split into blocks."""
    import random
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rng = random.Random(5)
    base = [f"t{i}" for i in range(60)]
    data = []
    for i in range(40):
        w = list(base)
        for _ in range(i // 4):
            w[rng.randrange(60)] = f"r{rng.randrange(1000)}"
        data.append((100 - i, " ".join(w)))
    got = [tuple(r) for r in jaccard_join.link_components(spark.createDataFrame(data, "doc_id long, text string"), 2, 80).collect()]
    assert sorted(got, key=repr) == brute_components(data, 2, 80)


def test_language_id(spark, odd, none):
    assert language_id.identify(none, language_id.learn(none)).count() == 0
    got = {r["doc_id"]: r for r in language_id.identify(odd, language_id.learn(odd)).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[5]["lang_pred"] == got[9]["lang_pred"] == "und"
    assert got[3]["score"] == 0.0 and got[10]["lang_pred"] == got[11]["lang_pred"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    import zlib
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def plain_bits(texts, asked):
    """Code length by walking contexts byte by byte with dictionaries."""
    from collections import Counter, defaultdict
    from math import log2
    counts = defaultdict(Counter)
    order = language_id.ORDER
    pad = lambda t: bytes(order) + t.encode()
    for t in texts:
        b = pad(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[(k, b[i - k:i])][b[i]] += 1
    total, b = 0.0, pad(asked)
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            seen = counts.get((k, b[i - k:i]))
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if b[i] in seen:
                total -= log2(seen[b[i]] / whole)
                break
            total -= log2(len(seen) / whole)
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    import pyarrow as pa
    samples = {"x": ["abracadabra cadabra", "banana"], "y": ["ñandú über", "zzz"]}
    model = language_id.Languages(samples)
    asked = ["abra zz", "über banana", "q"]
    data, offsets = language_id.utf8(pa.array(asked))
    for _ in range(2):      # computed, then remembered
        bits = model.code_lengths(data, offsets)
        for i, t in enumerate(asked):
            for j, name in enumerate(model.names):
                assert bits[i, j] == pytest.approx(plain_bits(samples[name], t), rel=1e-5)


def test_language_accuracy_on_held_out(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs, language_id.learn(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.98


def brute_bytes(data, size=100):
    seen, out = {}, []
    for i, t in sorted(((LAST if d[0] is None else d[0], d[1] or "") for d in data), key=lambda d: d[0]):
        b = t.encode()
        for p in range(len(b) - size + 1):
            seen.setdefault(b[p:p + size], (i, p))
            seen[b[p:p + size]] = min(seen[b[p:p + size]], (i, p))
    for d in data:
        i, b = LAST if d[0] is None else d[0], (d[1] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p:p + size]] < (i, p):
                gone[p:p + size] = b"\1" * size
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((d[0], len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def found_bytes(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept"]))
                   for r in suffix_dedup.repeated_byte_cover(df).collect()), key=repr)


def test_suffix_dedup(odd, none):
    assert suffix_dedup.repeated_byte_cover(none).count() == 0
    assert found_bytes(odd) == brute_bytes(ROWS)


def test_suffix_dedup_common_line_and_runs(spark):
    """A short line that nearly every text has, in different surroundings, and long runs."""
    import random
    rng = random.Random(2)
    line = "this very common line has eighty or so bytes and stands in most of the texts. "
    some = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    shared = some(150)
    data = [(i, some(rng.randrange(30)) + line + some(40) + (shared if i % 3 == 0 else "") + some(60)) for i in range(120)]
    data += [(200 + i, "z" * n) for i, n in enumerate((99, 100, 101, 350))] + [(300, "ab" * 200), (301, shared * 3)]
    assert found_bytes(spark.createDataFrame(data, "doc_id long, text string")) == brute_bytes(data)


def plain_scores(data, good):
    from collections import Counter
    from math import log2
    uni, ctx, pair = ({True: Counter(), False: Counter()} for _ in range(3))
    for i, t, *_ in data:
        w = words(t, True)
        for a, b in zip(["<s>", *w], w):
            for kind in {False, i in good and i is not None}:
                uni[kind][b] += 1
                ctx[kind][b] += 1
                ctx[kind][a] += a == "<s>"
                pair[kind][(a, b)] += 1
    n = {k: sum(v.values()) for k, v in uni.items()}
    out = []
    for i, t, *_ in data:
        w = words(t, True)
        loss = []
        for a, b in zip(["<s>", *w], w):
            general = uni[False][b] / n[False]
            p = {False: general, True: (uni[True][b] + lm_score.MU_WORD * general) / (n[True] + lm_score.MU_WORD)}
            loss.append([-log2((pair[k][(a, b)] + lm_score.MU_PAIR * p[k]) / (ctx[k][a] + lm_score.MU_PAIR)) for k in (True, False)])
        out.append((i, len(w), *([sum(x) / len(w) for x in zip(*loss)] if w else (None, None))))
    return out


def test_lm_score(spark, odd, none):
    good = spark.createDataFrame([(1,), (2,), (8,), (None,)], "doc_id long")
    assert lm_score.score(none, good).count() == 0
    got = sorted(((r["doc_id"], r["n_tokens"], r["ce_target"], r["ce_background"]) for r in lm_score.score(odd, good).collect()), key=repr)
    want = sorted(plain_scores(ROWS, {1, 2, 8}), key=repr)
    for a, b in zip(got, want):
        assert a[:2] == b[:2]
        assert a[2:] == (None, None) if b[2] is None else a[2:] == pytest.approx(b[2:], abs=2e-6)
    without = lm_score.score(odd, good.where("doc_id > 99")).where("n_tokens > 0").collect()
    assert all(r["ce_diff"] is not None for r in without)


def test_lm_counts_beyond_32_bits():
    """Sums over batches pass 2^32 and arrive whole at the batch that asked."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401
    from featurespark.llm import exchange
    plan, keys, most = exchange.Plan(2, lm_score.KEY_BITS), np.array([1, 7], np.uint64), (1 << 32) - 1
    sent = pa.concat_tables([plan.send(b, keys, [np.array([most, b], np.uint32), np.array([most, 1], np.uint32)]) for b in range(3)])
    answer = exchange.answers(lm_score._sums, [np.uint32, np.uint32])(sent)
    held = exchange.replies(answer.filter(pa.compute.equal(answer["batch"], 1)), keys, plan, lm_score.COUNTS)
    assert held["target"].tolist() == [3 * most, 3] and held["all"].tolist() == [3 * most, 3]


def test_pieces(odd, none):
    model = pieces.PieceModel()
    assert pieces.encode_documents(none, model).count() == 0
    out = pieces.encode_documents(odd, model)
    got = rows(out)
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t for i, t, *_ in ROWS if i == r["doc_id"]) or ""
        assert r["round_trip"] == ("▁" not in text)
        assert (r["n_pieces"] == 0) == (text == "")
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(out, model).collect()}
    assert back[2] == ROWS[1][1] and back[3] == "" and back[10] == ROWS[11][1]


def test_viterbi_is_the_best_path(tmp_path):
    """The reference library, told that the same pieces are a unigram model, agrees."""
    import random
    import sentencepiece
    raw = open(pieces.MODEL, "rb").read()
    # model_type in trainer_spec (field 3 of message 2): 2 (pairs) becomes 1 (unigram)
    at = raw.index(b"\x18\x02", raw.rindex("梦".encode()))
    (tmp_path / "u.model").write_bytes(raw[:at] + b"\x18\x01" + raw[at + 2:])
    other = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    model = pieces.PieceModel().start()
    rng = random.Random(4)
    texts = [t for _, t, *_ in ROWS if t and "▁" not in t and len(t) < 400] + ["".join(rng.choice("thande inß日") for _ in range(60)) for _ in range(60)]
    texts += [t + "\n" + t[::-1] for t in texts[-9:]]
    low, same = set(model.byte_id.values()), 0
    scores = {other.id_to_piece(i): other.get_score(i) for i in range(other.vocab_size())
              if not (other.is_byte(i) or other.is_control(i) or other.is_unknown(i))}
    for t in texts:
        mine, theirs = model.encode(t), other.encode(t)
        total = lambda ids: sum(model.scores[i] for i in ids if i not in model.byte_id.values())
        assert mine == model.viterbi(pieces.MARK + t.replace(" ", pieces.MARK))
        # the other adds 32-bit numbers, so its path may be a little worse
        assert total(mine) >= total(theirs)
        same += mine == theirs
        assert total(mine) - total([i for i in mine if i in low]) == pytest.approx(plain_best(t, scores, model.least, low, mine), abs=1e-6)
    assert same > 0.9 * len(texts)


def plain_best(text, scores, unknown, low, mine):
    """Score of the best path over a dictionary of pieces, without its unknown characters' share."""
    s = pieces.MARK + text.replace(" ", pieces.MARK)
    best = [0.0] + [float("-inf")] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - 16), end):
            if s[start:end] in scores:
                best[end] = max(best[end], best[start] + scores[s[start:end]])
        if s[end - 1] not in scores:
            best[end] = max(best[end], best[end - 1] + unknown)
    fallen = sum(c not in scores for c in s)
    return best[-1] - fallen * unknown


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, LINES), (2, "too short"), (3, None), (4, "one two three four five six seven second line of a different kind altogether"),
                                   (5, LINES), (None, "")], "item_id long, text string")
    assert decontaminate.contained_items(none, items).count() == 0
    assert decontaminate.contained_items(odd, items.where("item_id > 99")).count() == 0
    got = sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["n_common"]) for r in decontaminate.contained_items(odd, items).collect()), key=repr)
    want = []
    for i, t, *_ in ROWS:
        for r in items.collect():
            s = shingles(r["text"], 5, False)
            n = len(s & shingles(t, 5, False))
            if s and 100 * n >= 80 * len(s):
                want.append((i, r["item_id"], len(s), n))
    assert got == sorted(want, key=repr) and len(got) >= 8
    assert {r["doc_id"] for r in decontaminate.clean_documents(odd, items).collect()} == {3, 4, 5, 6, 7, 8, 9, 10, 11, 12, None}


def test_pii(odd, none):
    assert pii.find(none, pii.train(none)).count() == 0
    for tagger in (None, pii.train(odd)):
        got = {r["doc_id"]: r for r in pii.find(odd, tagger).collect()}
        text = ROWS[7][1]
        assert [(s["kind"], text[s["start"]:s["end"]]) for s in got[8]["base"]] == [
            ("email", "me@example.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
        assert got[3]["spans"] == got[4]["spans"] == []
        assert all(s in r["spans"] for r in got.values() for s in r["base"])


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
          "card": lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
          "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15}
    return [(k, *m.span()) for k, name in enumerate(pii.KINDS) for m in re.finditer(PLAIN[name], t) if ok[name](m[0])]


def test_pii_base_patterns_on_random_texts():
    import random
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("12a.@-+ (49)é") for _ in range(rng.randrange(1, 30)))
        assert pii.base_spans(t) == plain_spans(t), t
    number = "4111111111111111"
    for t in (f"x {number} {number}", f"{number}-{number}", "a@b.co@c.de", "1.2.3.4.5.6.7.8", "9" * 500 + ".1.2.3"):
        assert pii.base_spans(t) == plain_spans(t), t


def test_pii_windows_agree_with_one_long_window():
    """Windows reconciled over a text tag it as the whole text would be, away from chance ties."""
    import numpy as np
    rng = np.random.default_rng(0)
    tagger = pii.Tagger()
    tagger.p["move"][:] = np.eye(5) * 0.2
    x = rng.integers(1, pii.N_CLASSES, 2000).astype(np.uint8)
    parts = tagger.tag(x, np.array([0, 700, 700, 2000]))
    for a, b in ((0, 700), (700, 2000)):
        whole = tagger.viterbi(tagger.emissions(x[a:b, None]))[:, 0]
        assert (parts[a:b] == whole).mean() > 0.95


def test_pii_windows_without_labels_are_skipped_exactly():
    """The bound never skips a window whose best path has a label."""
    import numpy as np
    rng = np.random.default_rng(5)
    tagger, skipped = pii.Tagger(), 0
    for _ in range(60):
        tagger.p["move"][:] = rng.normal(0, 2, (5, 5))
        tagger.p["first"][:] = rng.normal(0, 2, 5)
        e = rng.normal(0, 1, (9, 5, 40)).astype(np.float32)
        e[:, 0] += rng.uniform(0, 6)
        gain = tagger._most_gain(e)
        best = np.zeros((9, 40), np.uint8)
        for n in range(40):                                   # plain Viterbi, window by window
            score, back = e[0, :, n] + tagger.p["first"], []
            for t in range(1, 9):
                paths = score[:, None] + tagger.p["move"]
                back.append(paths.argmax(0))
                score = paths.max(0) + e[t, :, n]
            at = int(score.argmax())
            for t in range(8, -1, -1):
                best[t, n] = at
                if t:
                    at = int(back[t - 1][at])
        assert (tagger.viterbi(e) == best).all()
        skipped += int((gain <= 0).sum())
    assert skipped > 100


def test_pii_training_lowers_the_loss():
    import numpy as np
    x, y = [], []
    rng = np.random.default_rng(1)
    for _ in range(200):
        text = "call the +1 (555) 123-4567 now or never " if rng.random() < .5 else "nothing to see in this text, move along "
        text = ("ab " * int(rng.integers(0, 6)) + text + " " * 64)[:64]
        labels = np.zeros(64, np.uint8)
        for k, a, b in pii.base_spans(text):
            labels[a:b] = k + 1
        x.append(pii.classes(text))
        y.append(labels)
    x, y = np.stack(x), np.stack(y)
    before = pii.Tagger().gradients(x.T, y.T)[0]
    tagger = pii.Tagger().fit(x, y, 40)
    assert tagger.gradients(x.T, y.T)[0] < before / 10
    assert (tagger.viterbi(tagger.emissions(x.T)).T == y).mean() > 0.99
    assert pii.masked("a 1.2.3.4 b", [("ip", 2, 9)]) == "a [ip] b"


def test_rows_without_ids_and_repeated_ids(spark):
    """A third of the rows has no id, and some ids stand for two texts."""
    import random
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    data = []
    for i in range(60):
        own = " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(25))
        data.append((None if i % 3 == 0 else i // 2, f"{own} {passage}" if i % 2 else f"{passage} {own}"))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.repeated_word_cover(df).collect()]
    assert sorted(got, key=repr) == brute_words(data, 13)
    assert found_bytes(df) == brute_bytes(data)
    assert line_dedup.dedup_lines(df).count() == lm_score.score(df, df).count() == 60
    assert jaccard_join.link_components(df).where("doc_id is null").count() == 20


def test_jaccard_rows_that_share_an_id_keep_their_links(spark):
    """Texts under one id and under none link as their own sets; nothing is joined through a null id."""
    import random
    rng = random.Random(3)
    families = [[f"f{k}w{j}" for j in range(40)] for k in range(12)]
    data = []
    for i in range(96):
        w = list(families[i % 12])
        w[rng.randrange(40)] = f"x{rng.randrange(10 ** 6)}"
        # ids 1000 and 1001 stand for two families each, and a third of the rows has no id
        data.append((None if i % 3 == 0 else 1000 + i % 2 if 12 <= i < 18 else 100 - i, " ".join(w)))
    data += [(1000, ""), (None, ""), (None, None), (None, data[1][1])]
    got = [tuple(r) for r in jaccard_join.link_components(spark.createDataFrame(data, "doc_id long, text string"), 2, 80).collect()]
    apart = [(LAST + n if i is None else i, t) for n, (i, t) in enumerate(data)]
    known = lambda i: i if i is not None and i < LAST else None
    assert sorted(got, key=repr) == sorted(((known(i), n, known(c), k) for i, n, c, k in brute_components(apart, 2, 80)), key=repr)


def test_jaccard_counts_all_links_of_a_large_group(spark, monkeypatch):
    """Near copies of one text, many of them equal: no link is lost to tiles, blocks or batches,
    and every distinct pair is verified once."""
    import random
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    monkeypatch.setattr(jaccard_join, "CELL_BYTES", 40_000)
    rng = random.Random(11)
    base = [f"t{i}" for i in range(80)]
    variants = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(80)] = f"r{rng.randrange(30)}"
        variants.append(" ".join(w))
    data = [(i, variants[rng.randrange(150)]) for i in range(300)] + [(1000 + i, f"alone {i} " + " ".join(base[:20])) for i in range(30)]
    got = [tuple(r) for r in jaccard_join.link_components(spark.createDataFrame(data, "doc_id long, text string"), 2, 85).collect()]
    assert sorted(got, key=repr) == brute_components(data, 2, 85)


def test_links_among_and_trees():
    """The suffix filter loses no link; trees connect the same nodes with few edges each."""
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool[:120], rng.integers(1, 110), replace=False)) for _ in range(60)]
    a, b = np.array([(i, j) for i in range(60) for j in range(i)]).T
    for percent in (30, 60, 90):
        good = [100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b)]
        assert jaccard_join.links_among(sets, a, b, percent).tolist() == good
    n = 500
    a, b = rng.integers(0, n, (2, 350))
    x, y = jaccard_join._trees(n, a, b)

    def parts(a, b):
        label = list(range(n))
        for _ in range(n):
            before = list(label)
            for i, j in zip(a, b):
                label[i] = label[j] = min(label[i], label[j])
            if label == before:
                return label

    assert parts(x, y) == parts(a, b) and np.bincount(np.concatenate([x, y])).max() <= 17
