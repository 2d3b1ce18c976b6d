"""Similarity join of documents on the Jaccard similarity of their word shingles.

Shingles are ordered rare first (by octave of their document frequency, then hash),
so two sets that reach the threshold share a gram in their short prefixes. Equal sets
become one class with a weight, so copies make no pairs. A class lies in a cell of
bounded size with others that share a frequent gram of its prefix. Spark joins the
classes of a prefix gram, grouped by cell and size, cut by length and position; what
meets goes to the tile of its two cells. A tile makes the pairs of its classes from the
grams' entries, and each distinct pair passes the suffix filter and is verified once, for
the number of links and for the components. A large group of near copies is many tiles;
its pairs are never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featurespark.llm import exchange as x
from featurespark.llm.components import components
from featurespark.llm.shared import NULL_ID, batch_count, batched, bucket_count, stage, text_bytes
from featurespark.llm.words import U64, Words, mix

SHINGLE, PERCENT = 4, 85
BATCH_BYTES = 2_000_000
#: entries of one gram that meet in one task
BLOCK = 1000
#: preceding prefix grams that tell whether a pair was made at an earlier gram
BEFORE = 8
#: bytes of a cell's sets and its least bytes for a set; tiles of a task
CELL_BYTES, SET_BYTES, TILES = 2_000_000, 4096, 16
#: pivots of the suffix filter
PIVOTS = 16
#: parts of a hot key in joins of narrow rows
SALTS = 16


class Sets:
    """Distinct shingles of each document of a batch: hashes sorted by (document, hash)."""

    def __init__(self, table: pa.Table, size: int):
        words = Words(table["text"], lower=True)
        hashes = words.hashes()
        grams, at = words.windows(hashes, size)
        docs = words.doc[at]
        few = np.flatnonzero((words.counts > 0) & (words.counts < size))
        whole = np.array([self._whole(hashes[words.first[d]:words.first[d + 1]]) for d in few], U64)
        grams, docs = np.concatenate([grams, whole]), np.concatenate([docs, few])
        order = np.lexsort((grams, docs))
        grams, docs = grams[order], docs[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
        self.grams, self.docs = grams[new], docs[new]
        self.n = len(words.counts)
        self.sizes = np.bincount(self.docs, minlength=self.n).astype(np.int64)
        self.edges = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ids = table["id"].fill_null(NULL_ID).to_numpy()
        self.row = self._rows()                         # the row that stands for a row's set
        self.first = (self.row == np.arange(self.n)) & (self.sizes > 0)

    @staticmethod
    def _whole(hashes: np.ndarray) -> int:
        out = len(hashes)
        for h in hashes:
            out = (out * 0xFF51AFD7ED558CCD + int(h)) % (1 << 64)
        return int(mix(np.array([out], U64))[0])

    def _rows(self) -> np.ndarray:
        """First row of the batch with the same set; empty sets stay alone."""
        sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(self.grams ^ U64(s)), dtype=U64)]) for s in (0, 0x5BD1E995)]
        self.prints = [s[self.edges[1:]] - s[self.edges[:-1]] for s in sums]
        _, first, group = np.unique(np.stack([*self.prints, self.sizes.astype(U64)], 1), axis=0, return_index=True, return_inverse=True)
        return np.where(self.sizes > 0, first[group.reshape(-1)], np.arange(self.n))

    def twins(self) -> np.ndarray:
        """Least row of the sets that stand under a row's id. All rows of an id are in one
        batch; rows without an id have nothing in common but their texts."""
        _, group = np.unique(self.ids, return_inverse=True)
        least = np.full(group.max(initial=-1) + 1, self.n, np.int64)
        np.minimum.at(least, group, self.row)
        return np.where(self.ids != NULL_ID, least[group], self.row)

    def least_ids(self) -> pa.Array:
        """Smallest id among the rows of a row's set; null if none has an id."""
        least = np.full(self.n, NULL_ID, np.int64)
        np.minimum.at(least, self.row, self.ids)
        return pa.array(least[self.row], mask=least[self.row] == NULL_ID)


def _octaves(group, groups, _source, values):
    """Reply: octave of a gram's document frequency (0: one document only)."""
    return np.floor(np.log2(np.bincount(group, values[0], groups))).astype(np.uint8)[group]


def _prefix(size, percent):
    return size - (percent * size + 99) // 100 + 1


def _least_overlap(a, b, percent):
    """Links need this many common shingles: 100 i >= percent (a + b - i)."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def _sharers(group, groups, source, values):
    """Reply: in how many classes' prefixes the gram is."""
    return np.bincount(group, values[0], groups).astype(np.int32)[group]


def _profiles(grams: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many grams of each set lie between fixed pivots (by the grams' hash)."""
    of = np.repeat(np.arange(len(start) - 1), np.diff(start))
    part = ((grams & U64(0x3FFFFFFFFFFFFFF)) >> U64(54)).astype(np.int64)
    return np.bincount(of * PIVOTS + part, minlength=(len(start) - 1) * PIVOTS).reshape(-1, PIVOTS)


def links_among(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (a, b) of ``sets`` (sorted) link: 100 * intersection >= percent *
    union, after the length and suffix filters. The suffix filter cuts all sets at the same
    pivots: no part overlaps by more than the smaller side. Pairs are in order of a."""
    sizes = np.array([len(g) for g in sets], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    grams = np.concatenate(sets) if sets else np.zeros(0, U64)
    parts = _profiles(grams, start)
    words, number = np.unique(grams, return_inverse=True)
    out = np.zeros(len(a), bool)
    seen = np.zeros(len(words), bool)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]]) if len(a) else np.zeros(1, np.int64)
    for i, j in zip(cuts[:-1], cuts[1:]):
        one, others = a[i], b[i:j]
        need = _least_overlap(sizes[one], sizes[others], percent)
        good = percent * np.maximum(sizes[others], sizes[one]) <= 100 * np.minimum(sizes[others], sizes[one])
        good &= np.minimum(parts[others], parts[one]).sum(1) >= need
        own = number[start[one]:start[one + 1]]
        seen[own] = True
        for k in np.flatnonzero(good):
            o = others[k]
            out[i + k] = np.count_nonzero(seen[number[start[o]:start[o + 1]]]) >= need[k]
        seen[own] = False
    return out


def _trees(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same of ``n`` nodes as (a, b), at most 17 at a node: the
    members of a component, in order, are a tree of 16 children each."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")
    _, first = np.unique(label[order], return_index=True)
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    below = np.flatnonzero(place)
    return order[below], order[below - place[below] + (place[below] - 1) // 16]


def _entries(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, nodes, sizes and places of a column of lists of entries."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    start = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(np.int64)
    return start, *(flat.field(f).to_numpy() for f in ("node", "size", "pos"))


def _tile_pairs(met: pa.Table, nodes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (a, b), as places in ``nodes``, that meet in a gram and pass the length and
    positional filters there, in order of a."""
    tiles = met["tile"].to_numpy()
    start, node, size, pos = _entries(met["entries"])
    r_start, r_node, r_size, r_pos = _entries(met["r_entries"])
    node, r_node = np.searchsorted(nodes, node), np.searchsorted(nodes, r_node)
    order = np.argsort(tiles, kind="stable")
    found = [np.zeros((2, 0), np.int64)]
    for rows in np.split(order, np.flatnonzero(np.diff(tiles[order])) + 1):
        members = np.unique(np.concatenate([n[s[i]:s[i + 1]] for i in rows for n, s in ((node, start), (r_node, r_start))] or [node]))
        together = np.zeros((len(members), len(members)), bool)
        for i in rows:
            one, two = slice(start[i], start[i + 1]), slice(r_start[i], r_start[i + 1])
            n, m = size[one][:, None], r_size[two][None]
            good = (percent * np.maximum(n, m) <= 100 * np.minimum(n, m)) & (
                np.minimum(n - pos[one][:, None], m - r_pos[two][None]) >= _least_overlap(n, m, percent))
            together[np.ix_(np.searchsorted(members, node[one]), np.searchsorted(members, r_node[two]))] |= good
        a, b = np.nonzero(np.tril(together | together.T, -1))
        found.append(np.stack([members[a], members[b]]))
    a, b = np.concatenate(found, 1)
    order = np.lexsort((b, a))
    return a[order], b[order]


def _verify(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, other, links): for each batch of tiles of ``met`` (tile, entries, r_entries) the
    number of links of its nodes (other is null), by the weight of their partners, and edges
    (node, other) of the same components. A batch gets each set that its entries name once,
    and verifies each distinct pair once."""
    tiles = met.agg(F.approx_count_distinct("tile")).first()[0]
    met = met.withColumn("batch", F.pmod(F.xxhash64("tile"), F.lit(-(-tiles // TILES) or 1)).cast("int"))

    def names(key, table):
        nodes = np.unique(np.concatenate([_entries(table[c])[1] for c in ("entries", "r_entries")]))
        return pa.table({"of": pa.array([key[0].as_py()] * len(nodes), pa.int32()), "named": nodes})

    named = met.groupBy("batch").applyInArrow(names, "of int, named long")
    held = named.join(sets, F.col("named") == F.col("node")).select("of", "node", "weight", "grams")

    def check(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by("node")
        nodes, weight = held["node"].to_numpy(), held["weight"].to_numpy()
        a, b = _tile_pairs(asked, nodes, percent)
        good = links_among([np.frombuffer(g.as_py(), U64) for g in held["grams"]], a, b, percent)
        a, b = a[good], b[good]
        links = np.bincount(a, weight[b], len(nodes)).astype(np.int64) + np.bincount(b, weight[a], len(nodes)).astype(np.int64)
        some = np.flatnonzero(links)
        x_, y = _trees(len(nodes), a, b)
        return pa.table({"node": pa.array(np.concatenate([nodes[some], nodes[x_]])),
                         "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(nodes[y], pa.int64())]),
                         "links": pa.concat_arrays([pa.array(links[some], pa.int64()), pa.nulls(len(x_), pa.int64())])})

    return met.groupBy("batch").cogroup(held.groupBy("of")).applyInArrow(check, "node long, other long, links long")


def _prefix_rows(table: pa.Table, percent: int):
    """Prefix grams of a batch's sets: hash, row, place, all in row order."""
    grams = [np.frombuffer(g.as_py(), U64) for g in table["grams"]]
    sizes = np.array([len(g) for g in grams], np.int64)
    heads = _prefix(sizes, percent)
    row = np.repeat(np.arange(len(grams)), heads)
    place = np.arange(len(row)) - np.repeat(np.cumsum(heads) - heads, heads)
    keys = np.concatenate([g[:h] for g, h in zip(grams, heads)]) if grams else np.zeros(0, U64)
    shared = keys >> U64(58) > 0
    return keys[shared], row[shared], place[shared], sizes


def link_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), one row for each row of ``docs``.

    The set of a document is its distinct ``size``-word shingles (A-Z lowered); with
    fewer words the whole sequence is one; null, empty and blank texts have none and
    link with nothing. Documents link at a Jaccard similarity of ``percent`` % or more;
    component_id is the smallest id reachable by links, n_links the number of other rows
    whose set links with the row's. Rows that repeat an id are in one component, which has
    the links of all of them. Rows without an id are linked by their texts only; a null id
    is larger than any other, and is null in the result. An empty table gives no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    total = text_bytes(docs, text_col)
    batches, buckets = batch_count(spark, total, BATCH_BYTES), bucket_count(spark, total)
    texts = batched(docs, batches, id_col, text_col)
    short, full = x.Plan(buckets, 40), x.Plan(buckets)

    def frequency(batch, table):
        sets = Sets(table, size)
        keys, count = np.unique(short.cut(sets.grams[sets.first[sets.docs]]), return_counts=True)
        return short.send(batch, keys, [count.astype(np.uint32)])

    octaves = x.ask(texts, frequency, _octaves, [np.uint32])

    def order(key, table, answer):
        sets = Sets(table, size)
        cut = short.cut(sets.grams)
        keys = np.unique(cut[sets.first[sets.docs]])
        octave = x.replies(answer, keys, short, np.uint8)[np.searchsorted(keys, cut)] if len(keys) else np.zeros(0, np.uint8)
        ranked = (octave.astype(U64) << U64(58)) | (sets.grams >> U64(6))
        blobs = [None] * sets.n
        for d in np.flatnonzero(sets.first):
            grams = np.sort(ranked[sets.edges[d]:sets.edges[d + 1]])
            if (grams[:_prefix(len(grams), percent)] >> U64(58)).any():
                blobs[d] = grams.tobytes()
        # a set's number, no id: ids may stand for several texts, and rows may lack one
        base = np.int64(key[0].as_py()) << 32
        return pa.table({"batch": pa.array([key[0].as_py()] * sets.n, pa.int32()), "doc_id": table["id"], "node": base + sets.row,
                         "twin": base + sets.twins(), "least": sets.least_ids(), "stands": sets.row == np.arange(sets.n),
                         "n_shingles": sets.sizes, "copies": np.bincount(sets.row, minlength=sets.n),
                         "print1": sets.prints[0].view(np.int64), "print2": sets.prints[1].view(np.int64), "grams": pa.array(blobs, pa.binary())})

    ordered = stage(texts.groupBy("batch").cogroup(octaves.groupBy("batch")).applyInArrow(
        order, "batch int, doc_id long, node long, twin long, least long, stands boolean, n_shingles long, copies long, "
               "print1 long, print2 long, grams binary"), "sets")
    classes, moved = _classes(ordered)
    weight = classes.select(F.col("class").alias("c"), F.col("weight").alias("w"))
    sets = ordered.where("grams is not null").select("batch", "node", "copies", "grams")

    def own(table, others):
        """The rows of a batch that stand for their class."""
        return table.filter(pa.array(~np.isin(table["node"].to_numpy(), others["node"].to_numpy())))

    def share(batch, table, others):
        distinct, count = np.unique(_prefix_rows(own(table, others), percent)[0], return_counts=True)
        return full.send(batch, distinct, [count.astype(np.int32)])

    sharers = x.ask(sets.select("batch", "node", "grams"), share, _sharers, [np.int32], moved)
    told = sharers.select("batch", "bucket", "reply", F.lit(None).cast("long").alias("node")).unionByName(
        moved.select("batch", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("reply"), "node"))

    def open_grams(_key, table, answer):
        is_moved = answer["node"].is_valid()
        table = own(table, answer.filter(is_moved))
        keys, row, place, sizes = _prefix_rows(table, percent)
        distinct, group = np.unique(keys, return_inverse=True)
        count = x.replies(answer.filter(answer["bucket"].is_valid()), distinct, full, np.int32)[group]
        on = count > 1
        keys, row, place, count, nodes = keys[on], row[on], place[on], count[on], table["node"].to_numpy()
        start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])[row]
        before = [keys[max(start[i], i - BEFORE):i].view(np.int64).tolist() for i in range(len(row))]
        cell = _cells(keys, row, count, nodes, sizes)
        return pa.table({"gram": keys.view(np.int64), "node": nodes[row], "size": sizes[row], "pos": place, "cell": cell[row],
                         "before": pa.array(before, pa.list_(pa.int64())), "blocks": (count + BLOCK - 1) // BLOCK})

    rows = stage(sets.select("batch", "node", "grams").groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(
        open_grams, "gram long, node long, size long, pos long, cell long, before array<long>, blocks int"), "open-grams")
    met = stage(_meetings(rows, percent), "tiles")
    known = sets.join(weight, F.col("node") == F.col("c"), "left").select("node", F.coalesce("w", "copies").alias("weight"), "grams")
    found = stage(_verify(met, known, percent), "links")

    def moved_class(df, name):
        to = moved.select(F.col("node").alias("n"), F.col("class").alias("to"))
        return df.join(to, F.col(name) == F.col("n"), "left").withColumn(name, F.coalesce("to", name)).drop("n", "to")

    same_id = ordered.where("node <> twin").select(F.col("node").alias("a"), F.col("twin").alias("b")).distinct()
    same_id = moved_class(moved_class(same_id, "a"), "b").where("a <> b")
    labels = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).union(same_id))
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))

    nodes = ordered.where("stands").select("node", "least", "copies", "n_shingles", F.col("node").alias("class"))
    nodes = moved_class(nodes, "class")
    at_class = labels.withColumnRenamed("node", "l").join(links.withColumnRenamed("node", "k"), F.col("l") == F.col("k"), "left")
    at_class = at_class.join(weight, F.col("l") == F.col("c"), "full").select(
        F.coalesce("l", "c").alias("c"), F.coalesce("label", "c").alias("label"), F.coalesce("links", F.lit(0)).alias("links"), "w")
    nodes = stage(_salted_join(nodes, at_class, "class", "c"), "classes")
    least = nodes.where("label is not null").groupBy("label").agg(F.min("least").alias("smallest")).withColumnRenamed("label", "of")
    nodes = _salted_join(nodes, least, "label", "of").select(
        F.col("node").alias("n"), F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.coalesce("links", F.lit(0)) + F.coalesce("w", "copies") - 1).otherwise(0).cast("long").alias("n_links"))
    return ordered.join(nodes, F.col("node") == F.col("n")).select("doc_id", "n_shingles", "component_id", "n_links")


def _salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join with a hot key of ``left`` in ``SALTS`` parts; ``right`` has a row per key."""
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = (F.col(left_key) == F.col(right_key)) & (F.pmod(F.xxhash64("node"), F.lit(SALTS)) == F.col("part"))
    return left.join(right, met, "left").drop("part", right_key)


def _classes(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal sets of several batches: (class, weight), the least node and the number of
    rows, and (batch, node, class) of the nodes that another one stands for. A batch sends
    one row of each set, whatever its number of copies."""
    narrow = ordered.where("stands and grams is not null").select("batch", "node", "print1", "print2", "n_shingles", "copies")
    group = narrow.groupBy("print1", "print2", "n_shingles").agg(
        F.min("node").alias("class"), F.sum("copies").alias("weight"), F.count("*").alias("nodes")).where("nodes > 1").drop("nodes")
    group = stage(group, "set-classes")
    parts = group.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("weight")
    narrow = narrow.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    moved = narrow.join(parts, ["print1", "print2", "n_shingles", "part"]).where("node <> class").select("batch", "node", "class")
    return group.select("class", "weight"), stage(moved, "moved-sets")


def _cells(keys: np.ndarray, row: np.ndarray, count: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cell of each row: classes that share the gram of the largest octave of classes, then
    of the least hash, in parts of about ``CELL_BYTES`` of sets."""
    cell = np.zeros(len(nodes), np.int64)
    order = np.lexsort((mix(keys), -np.floor(np.log2(count)), row))
    of, first = np.unique(row[order], return_index=True)
    pick = order[first]
    parts = -(-count[pick] * np.maximum(sizes[of] * 8, SET_BYTES) // CELL_BYTES)
    # parts of neighbouring sizes coincide: the next power of two
    parts = U64(1) << np.ceil(np.log2(parts)).astype(U64)
    cell[of] = mix(mix(keys[pick] ^ mix(parts)) + mix(nodes[of].view(U64)) % parts).view(np.int64)
    return cell


def _meetings(rows: DataFrame, percent: int) -> DataFrame:
    """(tile, entries, r_entries): of each gram the entries (node, size, pos) of two cells, or
    twice of one, that may hold a pair within the length and positional filters.

    The position bounds the overlap at a pair's first common gram, so a linked pair
    passes there. Where both sides are one entry and an earlier common gram is at hand,
    the pair has met before. A gram of many entries is split into blocks of cells that meet
    two by two."""
    octave = F.floor(4 * F.log2("size")).cast("int")
    groups = rows.groupBy("gram", "cell", octave.alias("octave")).agg(
        F.collect_list(F.struct("node", "size", "pos")).alias("entries"), F.min("size").alias("least"), F.max("size").alias("most"),
        F.max(F.col("size") - F.col("pos")).alias("tail"), F.max("blocks").alias("blocks"),
        F.when(F.count("*") == 1, F.first("before")).otherwise(F.array().cast("array<long>")).alias("before"))
    own = F.pmod(F.xxhash64("cell"), F.col("blocks")).cast("int")
    left = groups.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = groups.select(*[F.col(c).alias("r_" + c) for c in ("gram", "cell", "octave", "entries", "least", "most", "tail", "before")],
                          own.alias("r_block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("r_other"))
    need = F.floor((percent * (F.col("least") + F.col("r_least")) + 99 + percent) / (100 + percent))
    same = (F.col("cell") == F.col("r_cell")) & (F.col("octave") == F.col("r_octave"))
    later = (F.col("cell") > F.col("r_cell")) | ((F.col("cell") == F.col("r_cell")) & (F.col("octave") > F.col("r_octave")))
    met = ((F.col("gram") == F.col("r_gram")) & (F.col("block") == F.col("r_other")) & (F.col("other") == F.col("r_block"))
           & (later | (same & (F.size("entries") > 1)))
           & (percent * F.greatest("least", "r_least") <= 100 * F.least("most", "r_most"))
           & (F.least("tail", "r_tail") >= need) & (same | ~F.arrays_overlap("before", "r_before")))
    tile = F.xxhash64(F.least("cell", "r_cell"), F.greatest("cell", "r_cell"))
    return left.join(right, met).select(tile.alias("tile"), "entries", "r_entries")
