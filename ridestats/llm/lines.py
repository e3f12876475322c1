"""Repeated runs of lines, found by prefix doubling over line ids, and their removal.

Every text is a sequence of line ids (64-bit hashes of its lines with a word). As in
suffix sorting by doubling, a run of 2^(k+1) lines is named by the names of its two
halves; a run of any length l is named by the two runs of 2^k <= l lines that cover it.
Runs of one name are an LCP interval at depth l: all suffixes that agree in their first l
lines. Only equality of names is needed, so names are hashes and no global sort is.

What counts as a passage is set by words. From every line of a run that occurs elsewhere
start the shortest run forwards and backwards with ``min_words`` words; any repeated run
of that size is the union of such windows. In each interval the first occurrence (by
document id, then place) stays, all others are deleted; the windows that are deleted,
put together, are the maximal repeated runs. The first occurrence of a line is never
deleted.

All of it is DataFrame code. Lines that occur once, which is nearly all, leave after one
aggregation; what follows handles rows of a few numbers. Windows hold at most
``min_words`` lines. A line or passage in a third of the documents is a partial
aggregate, and a join whose large side Spark can split.

Null texts stay null; blank lines are no part of runs and stay. Rows that agree in id and
text are one document and get the same answer; null ids come after all others. Only the
two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ridestats.sources.scratch import stage

_WORD = r"[^\x20\x09-\x0D]+"
_DOC = ("id", "digest")


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with a word: place in the text, hash and number of words."""
    lines = docs.select(*_DOC, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    n = F.size(F.regexp_extract_all("line", F.lit(_WORD), F.lit(0)))
    found = lines.select(*_DOC, "pos", F.xxhash64("line").alias("name"), n.alias("n")).filter("n > 0")
    return found.dropDuplicates([*_DOC, "pos"])


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """For each stretch of repeated lines its names, places and windows (start, length)."""
    doc = Window.partitionBy(*_DOC).orderBy("pos")
    numbered = lines.select("*", F.row_number().over(doc).alias("number"))
    repeated = numbered.groupBy("name").agg(F.count("*").alias("times")).filter("times > 1").select("name")
    active = numbered.join(repeated, "name")
    # Neighbours in the text whose numbers follow each other form a stretch.
    stretch = active.select("*", (F.col("number") - F.row_number().over(doc)).alias("stretch"))
    by = [*_DOC, "stretch"]
    inside = Window.partitionBy(*by)
    after = stretch.select("*", F.sum("n").over(inside.orderBy("pos")).alias("after"), F.count("*").over(inside).alias("size"),
                           F.sum("n").over(inside).alias("total"), F.row_number().over(inside.orderBy("pos")).alias("at"))
    before = after.withColumn("before", F.col("after") - F.col("n"))
    reach = Window.partitionBy(*by).orderBy("before").rangeBetween(Window.unboundedPreceding, min_words - 1)
    back = Window.partitionBy(*by).orderBy(F.desc("after")).rangeBetween(Window.unboundedPreceding, min_words - 1)
    ends = before.select(
        *by, "at", "pos", "name",
        F.when(F.col("total") - F.col("before") >= min_words, F.count("*").over(reach) - F.col("at") + 1).alias("forwards"),
        F.when(F.col("after") >= min_words, F.col("at") - F.col("size") + F.count("*").over(back)).alias("backwards"))
    rows = F.sort_array(F.collect_list(F.struct("at", "pos", "name", "forwards", "backwards")))
    return ends.groupBy(*by).agg(rows.alias("rows"), F.max("forwards").alias("f"), F.max("backwards").alias("b")).filter(
        "f is not null or b is not null")


def _doubled(names: Column, width: int) -> Column:
    """Names of runs twice as long; those that reach beyond the stretch are never asked for."""
    return F.transform(names, lambda name, i: F.xxhash64(name, F.get(names, i + F.lit(width))))


def _named(stretches: DataFrame, longest: int) -> DataFrame:
    """Windows with their names, by doubling."""
    names = stretches.select(*_DOC, F.col("rows.pos").alias("pos"), F.col("rows.name").alias("names0"), F.array_distinct(F.concat(
        F.filter(F.transform("rows", lambda r: F.when(r["forwards"].isNotNull(), F.struct(r["at"].alias("at"), r["forwards"].alias("l")))), F.isnotnull),
        F.filter(F.transform("rows", lambda r: F.when(r["backwards"].isNotNull(), F.struct(
            (r["at"] - r["backwards"] + 1).cast("int").alias("at"), r["backwards"].alias("l")))), F.isnotnull))).alias("windows"))
    levels = max(0, longest.bit_length() - 1)
    for k in range(levels):
        names = names.withColumn(f"names{k + 1}", _doubled(F.col(f"names{k}"), 1 << k))
    windows = names.select("*", F.explode("windows").alias("w")).select("*", (F.col("w.at") - 1).alias("i"), F.col("w.l").cast("int").alias("l"))
    name: Column = F.lit(None).cast("long")
    for k in range(levels + 1):
        level = F.col(f"names{k}")
        both = F.xxhash64(F.col("l"), F.get(level, F.col("i")), F.get(level, F.col("i") + F.col("l") - F.lit(1 << k)))
        name = F.when((F.col("l") >= 1 << k) & (F.col("l") < 2 << k), both).otherwise(name)
    places = F.slice("pos", F.col("i") + 1, F.col("l"))
    return windows.select(*_DOC, name.alias("name"), places.alias("places"))


def repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(id, digest, removed) of the documents (id, digest, text) with later copies of passages.

    ``removed`` are the places, from 0 and ascending, of the lines to delete.
    """
    stretches = stage(_windows(_lines(docs), min_words), "line-stretches")
    longest = stretches.agg(F.coalesce(F.greatest(F.max("f"), F.max("b")), F.lit(1))).first()[0]
    windows = stage(_named(stretches, longest), "line-windows")
    here = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("digest"), F.col("places")[0].alias("pos"))
    firsts = windows.groupBy("name").agg(F.min(here).alias("first"), F.count("*").alias("times")).filter("times > 1").select("name", "first")
    copies = windows.join(firsts, "name").filter(~here.eqNullSafe(F.col("first")))
    lines = copies.select(*_DOC, F.explode("places").alias("pos"))
    return lines.groupBy(*_DOC).agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def _without(text: str, removed: str) -> Column:
    lines = F.split(text, "\n", -1)
    bounds = F.concat(F.array(F.lit(-1)), F.col(removed), F.array(F.size(lines)))
    kept = F.transform(F.sequence(F.lit(0), F.size(removed)), lambda j: F.slice(
        lines, F.get(bounds, j) + 2, F.get(bounds, j + 1) - F.get(bounds, j) - 1))
    return F.when(F.col(removed).isNull(), F.col(text)).otherwise(F.array_join(F.flatten(kept), "\n"))


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, text without later copies of passages, n_lines, n_removed, removed.

    ``removed`` are the places of deleted lines, an empty array where there are none.
    """
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
    gone = repeated_lines(own, min_words).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "removed")
    joined = own.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select(
        F.col("id").alias("doc_id"), _without("text", "removed").alias("text"),
        F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def drop_repeats(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all their columns, later copies of passages taken out of the text.

    Rows that had words and have none left are dropped.
    """
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"),
                      F.col(text_col).cast("string").alias("text"))
    gone = repeated_lines(own.select("id", "digest", "text"), min_words).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "removed")
    joined = own.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    left = joined.select("row", "removed", _without("text", "removed").alias("text")).filter(
        F.col("removed").isNull() | F.col("text").rlike(_WORD))
    return left.select(*[F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
