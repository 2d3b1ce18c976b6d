"""Line deduplication over overlapping three-line windows (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from featurespark.functions.columns import unused
from featurespark.llm.shared import id_or_last, stage

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(text: Column, size: int) -> Column:
    """(pos, struct of ``size`` lines) for every line; the last ``size`` - 1 have nulls.
    Zipped slices split a text ``size`` times in all, whatever its length."""
    shifted = [F.slice(_lines(text), k + 1, 2147483647).alias(str(k)) for k in range(size)]
    return F.posexplode(F.arrays_zip(*shifted)).alias("pos", "run")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Lines covered by a window of ``size`` consecutive lines that also starts earlier
    (smaller id, or earlier in the same document): (id, text_hash, covered),
    ``covered`` being the positions. Documents without any are absent.

    A row is addressed by its id and a hash of its text, so different texts under one
    id stay apart; a repeated row is one document. A null id comes last.
    """
    run = [F.col("run").getField(str(k)) for k in range(size)]
    # the hash is taken before lines are, or every line would hash the whole text
    texts = docs.where(F.col(text_col).isNotNull()).select(id_or_last(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    cut = stage(texts.select("id", "text_hash", _windows(F.col("text"), size)).where(run[-1].isNotNull()).select("id", "text_hash", "pos", F.xxhash64(*run).alias("a"), F.xxhash64(F.lit(1), *run).alias("b")), "line-windows")
    first = stage(cut.groupBy("a", "b").agg(F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("n"))
                  .where("n > 1").select(F.col("a").alias("ra"), F.col("b").alias("rb"), "first"), "line-first")
    later = cut.join(first, (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb"))).where(F.struct("id", "pos") > F.col("first"))
    return later.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("starts")).select(
        "id", "text_hash", F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (size - 1))))).alias("covered"))


def _kept(lines: Column, covered: Column) -> Column:
    """The lines at other places than ``covered``, in time linear in both: between two removed
    places all lines stay."""
    gone = F.array_sort(covered)
    one = F.array(F.lit(-1))
    stays = F.flatten(F.zip_with(F.concat(one, gone), F.concat(gone, F.array(F.size(lines))),
                                 lambda a, b: F.concat(F.array_repeat(F.lit(True), b - a - 1), F.array(F.lit(False)))))
    return F.array_compact(F.zip_with(lines, stays, lambda line, stay: F.when(stay, line)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with repeated line windows removed: its columns, with the remaining lines
    as text, and, last, the number of lines and of removed lines (long), ``__n_lines`` and
    ``__n_removed`` or, where ``docs`` has such columns, a name with more underscores.

    A line goes when any window that covers it starts earlier elsewhere; windows are
    judged on the input, so the first occurrence always stays whole. Lines compare
    byte for byte. Documents of fewer than ``size`` lines have no window and stay as
    they are; null text stays null with 0 lines; an empty text is one empty line.
    """
    hit_id, hit_hash, places, n_lines, n_removed = (unused(docs.columns, c) for c in ("__hit_id", "__hit_hash", "__covered", "__n_lines", "__n_removed"))
    hits = removed_lines(docs, id_col, text_col, size).select(
        F.col("id").alias(hit_id), F.col("text_hash").alias(hit_hash), F.col("covered").alias(places))
    joined = docs.join(hits, (id_or_last(id_col) == F.col(hit_id)) & (F.xxhash64(text_col) == F.col(hit_hash)), "left")
    lines, covered = _lines(F.col(text_col)), F.col(places)
    kept = F.array_join(_kept(lines, covered), "\n")
    columns = [F.when(covered.isNotNull(), kept).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(
        *columns,
        F.coalesce(F.size(F.when(F.col(text_col).isNotNull(), lines)), F.lit(0)).cast("long").alias(n_lines),
        F.when(covered.isNotNull(), F.size(covered)).otherwise(0).cast("long").alias(n_removed),
    )
