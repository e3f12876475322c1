"""Collocations: phrases that are far more frequent than their two parts would make them.

Texts are cut into pieces at stops, pieces into words; a suffix pointer stands at every
word, and its suffix ends with the piece or after ``words`` words. Everything is counted
per language.

1. Words are counted block by block where the texts are, then summed. Pairs of frequent
   words are counted under their hashes in a table of fixed size, summed over tasks in a
   tree; where a sum is too small, no pair of that hash is frequent.
2. A suffix is cut off at its first pair that cannot be frequent. No frequent phrase loses
   an occurrence by that, and most suffixes shrink to a single word and go. Equal suffixes
   become one row with a count.
3. Global routing by leading words: suffixes with the same leading pair go to the same bin.
   A pair with very many different suffixes is counted on the spot and routed by three
   leading words instead, and so on, so no bin has to hold what a hot word leads.
4. A bin sorts its suffix pointers by multikey three-way quicksort to the maximum depth. The
   part equal to the pivot holds the suffixes that share one more word, and its size is the
   count of that phrase; any part below the least count is abandoned unsorted.
5. Counts of phrases meet those of their parts in joins on exact whole numbers.

The tables of hashes only save work: all counts are those of the words themselves. Null and
blank texts have no words; a null language is ``und``; documents need no ids, and repeated
rows count as often as they stand. Ties in score and count are broken by phrase. No
frequent phrases, no rows. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ridestats.llm.bits import bit_table, maybe_in
from ridestats.llm.blocks import slices
from ridestats.llm.packing import coded, give_back, hashes, joined, spans, text_bytes
from ridestats.sources.scratch import stage

PART_BYTES = 4 << 20  # text worked on at a time
WORD_BITS = 24  # bits of the table of frequent words
PAIR_BITS = 23  # counters in the table of pairs
FAN_IN = 64  # tables of pairs added up by one task
BIN_ROWS = 200_000  # suffixes sorted together, and with one leading phrase before it is split
_CHUNK = 1 << 15  # counters in a row
_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK[[0x09, 0x20]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_NO_LANG = "und"


class Pieces:
    """The words of some texts, which of them follow each other in a piece, and their languages."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, ends = text_bytes(texts)
        data = _LOWER[data]
        breaks = _BREAK[data]
        solid = ~(breaks | _BLANK[data])
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        first = ends[:-1][ends[:-1] < ends[1:]]
        start[first] = solid[first]
        starts = np.flatnonzero(start)
        counts = np.diff(np.searchsorted(starts, ends))
        piece = np.cumsum(breaks)[starts]
        doc = np.repeat(np.arange(len(counts)), counts)
        self.follows = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])  # whether the next word does
        before = np.cumsum(solid)
        offsets = np.append(before[starts] - 1, before[-1] if len(before) else 0).astype(np.int64)
        self.body, self.offsets = np.ascontiguousarray(data[solid]), offsets
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(self.offsets), pa.py_buffer(self.body)])
        self.codes, self.distinct = coded(words)
        lang = langs.dictionary_encode()
        self.langs = lang.dictionary.to_pylist()
        self.lang = np.asarray(lang.indices, dtype=np.int64)[doc] if len(doc) else np.empty(0, np.int64)

    def keys(self) -> np.ndarray:
        """The hash of each word with its language."""
        return joined(_lang_hashes(self.langs)[self.lang], hashes(self.distinct)[self.codes])

    def counts(self) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
        """Distinct words and their counts, by language."""
        for number, lang in enumerate(self.langs):
            found = np.bincount(self.codes[self.lang == number], minlength=len(self.distinct))
            there = np.flatnonzero(found)
            if len(there):
                yield lang, self.distinct.take(pa.array(there)), found[there]


def _lang_hashes(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs] or [0], np.uint64)


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Pieces]:
    for batch in batches:
        for rows in slices(batch, "text", most):
            yield Pieces(rows["text"], rows["lang"])
            give_back()


def collocations(docs: DataFrame, least: int = 100, words: int = 5, top: int = 2000, lang_col: str = "lang",
                 text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Phrases of 2 to ``words`` words with ``a >= least`` occurrences; of the cuts into two
    parts with counts l and r the one with the lowest ``floor(1000 * a * n / (l * r))``
    counts, the first of equal ones; n is the number of words of the language. A phrase
    inside a longer one of the same count is left out.
    """
    if least < 1 or words < 2:
        raise ValueError("least >= 1 and words >= 2 are needed")
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(_NO_LANG)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = own.mapInArrow(_count_words(PART_BYTES), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    single = stage(counted.filter(F.col("word").isNull() | (F.col("n") >= least)), "frequent-words")
    totals, frequent = single.filter("word is null").select("lang", "n"), single.filter("word is not null")
    word_table = bit_table(frequent.mapInArrow(_word_keys, "key long"), "key", WORD_BITS)
    pair_table = _pair_table(own, word_table, least)
    suffixes = own.mapInArrow(_suffixes(word_table, pair_table, words, PART_BYTES), "lang string, suffix string, n long")
    merged = stage(suffixes.groupBy("lang", "suffix").agg(F.sum("n").alias("n")), "suffixes")
    longer = stage(_counted(merged, least, words), "frequent-phrases")
    return ranked(longer, frequent, totals, top)


def _count_words(most: int):
    """Words and counts of each part; without a word, all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, most):
            for lang, words, counts in part.counts():
                words = pa.concat_arrays([words.cast(pa.string()), pa.nulls(1, pa.string())])
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(words), pa.string()), "word": words,
                                                  "n": pa.array(np.append(counts, counts.sum()), pa.int64())})

    return run


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch["lang"].dictionary_encode()
        keys = joined(_lang_hashes(lang.dictionary.to_pylist())[np.asarray(lang.indices)], hashes(batch["word"].cast(pa.large_binary())))
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64))})


def _usable(part: Pieces, word_table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words and the next are frequent words of one piece, and the hashes of these pairs."""
    keys = part.keys()
    common = maybe_in(word_table, keys)
    at = np.flatnonzero(part.follows & common[:-1] & common[1:])
    return at, joined(keys[at], keys[at + 1])


def _pair_table(own: DataFrame, word_table: np.ndarray, least: int) -> np.ndarray:
    """A bit for each hash of pairs: whether they occur ``least`` times together."""
    bits, part_bytes, most = PAIR_BITS, PART_BYTES, max(least, 255)
    size = 1 << bits
    kind = np.uint8 if most < 256 else np.uint32
    chunk = min(size, _CHUNK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, kind)
        for part in _parts(batches, part_bytes):
            if len(part.follows):
                pairs = (_usable(part, word_table)[1] >> np.uint64(64 - bits)).astype(np.int64)
                sums = _added(sums, np.bincount(pairs, minlength=size), most)
        task = TaskContext.get().partitionId()
        for number, rows in enumerate(sums.reshape(-1, chunk)):
            if rows.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int32()), "task": pa.array([task], pa.int32()), "sums": pa.array([rows.tobytes()], pa.binary())})
        give_back()

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(chunk, kind)
        for sums in group["sums"]:
            total = _added(total, np.frombuffer(sums.as_buffer(), kind), most)
        return pa.table({"chunk": group["chunk"][:1], "task": pa.array([group["task"][0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, task int, sums binary"
    sums = stage(own.mapInArrow(count, schema), "pair-counts")
    tasks = (sums.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:  # a tree, so that no task adds up more than FAN_IN tables
        sums = sums.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("chunk", "task").applyInArrow(add, schema)
        tasks = -(-tasks // FAN_IN)

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.packbits(np.frombuffer(x.as_buffer(), kind) >= least, bitorder="little").tobytes() for x in batch["sums"]]
            yield pa.RecordBatch.from_pydict({"chunk": batch["chunk"], "bits": pa.array(found, pa.binary())})

    table = np.zeros(size // 8, np.uint8)
    for number, bits in sums.mapInArrow(flags, "chunk int, bits binary").collect():  # 2**PAIR_BITS bits
        table[number * chunk // 8 : (number + 1) * chunk // 8] = np.frombuffer(bytes(bits), np.uint8)
    return table


def _added(sums: np.ndarray, more: np.ndarray, most: int) -> np.ndarray:
    """Counts that stop at ``most``, which is no less than any count that matters."""
    return np.minimum(sums.astype(np.int64) + more, most).astype(sums.dtype)


def _suffixes(word_table: np.ndarray, pair_table: np.ndarray, words: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, most):
            n = len(part.codes)
            if n < 2:
                continue
            at, pairs = _usable(part, word_table)
            link = np.zeros(n, np.int64)  # whether the pair that begins here may be frequent
            link[at] = maybe_in(pair_table, pairs)
            reach, on = link.copy(), link.copy()
            for step in range(1, words - 1):
                on[: n - step] &= link[step:]
                on[n - step :] = 0
                reach += on
            at = np.flatnonzero(reach)
            for a in range(0, len(at), 1 << 18):
                some = at[a : a + (1 << 18)]
                yield _texts(part, some, reach[some] + 1)

    return run


def _texts(part: Pieces, at: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """The words of suffixes joined by blanks."""
    place = spans(at, sizes)
    lengths = np.diff(part.offsets)[place] + 1
    body = part.body[np.minimum(spans(part.offsets[place], lengths), len(part.body) - 1)]
    word_ends = np.cumsum(lengths)
    body[word_ends - 1] = 0x20
    last = np.cumsum(sizes) - 1
    keep = np.ones(len(body), bool)
    keep[word_ends[last] - 1] = False  # no blank behind the last word
    offsets = np.concatenate([[0], word_ends[last] - np.arange(1, len(last) + 1)]).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body[keep]))])
    lang = pa.DictionaryArray.from_arrays(pa.array(part.lang[at].astype(np.int32)), pa.array(part.langs, pa.string()))
    return pa.RecordBatch.from_pydict({"lang": lang.cast(pa.string()), "suffix": texts.cast(pa.string()), "n": pa.array(np.ones(len(at), np.int64))})


def _counted(merged: DataFrame, least: int, words: int) -> DataFrame:
    """(lang, phrase, words, f) of the phrases of two words and more with ``least`` occurrences.

    ``merged``: distinct suffixes with their counts.
    """
    bins = max(1, -(-merged.count() // BIN_ROWS))
    todo, parts = merged.withColumn("depth", F.lit(2)), []
    for depth in range(2, words):
        led = todo.withColumn("lead", F.substring_index("suffix", " ", depth))
        hot = led.groupBy("lang", "lead").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("f")).filter(F.col("rows") > BIN_ROWS)
        hot = stage(hot, "hot-leads")  # a share of 1 / BIN_ROWS of the suffixes at most
        if hot.isEmpty():
            todo = todo.withColumn("route", F.substring_index("suffix", " ", depth))
            break
        parts.append(hot.filter((F.col("f") >= least) & (F.size(F.split("lead", " ")) == depth)).select(
            "lang", F.col("lead").alias("phrase"), F.lit(depth).alias("words"), "f"))
        key = ["lang", "lead"]
        parts.append(_sorted_bins(led.join(hot.select(*key), key, "left_anti").withColumnRenamed("lead", "route"), bins, least, words))
        todo = led.join(hot.select(*key), key, "left_semi").drop("lead").withColumn("depth", F.lit(depth + 1))
    else:
        todo = todo.withColumn("route", F.col("suffix"))
    parts.append(_sorted_bins(todo, bins, least, words))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def _sorted_bins(routed: DataFrame, bins: int, least: int, words: int) -> DataFrame:
    def sort(group: pa.Table) -> pa.Table:
        split = pc.split_pattern(group["suffix"].combine_chunks().cast(pa.large_string()), " ")
        flat = split.flatten().dictionary_encode()
        sizes = np.diff(np.asarray(split.offsets))
        codes = np.full((len(sizes), words + 1), -1, np.int32)
        lang = group["lang"].combine_chunks().dictionary_encode()
        codes[:, 0] = np.asarray(lang.indices)
        inside = np.arange(words) < sizes[:, None]
        codes[:, 1:][inside] = np.asarray(flat.indices)
        weights, depths = np.asarray(group["n"]), np.asarray(group["depth"])
        found = []
        for depth in np.unique(depths).tolist():
            found += equal_parts(codes, weights, np.flatnonzero(depths == depth), depth, least)
        vocabulary, langs = flat.dictionary, lang.dictionary
        texts = [" ".join(vocabulary.take(pa.array(codes[row, 1 : depth + 1])).to_pylist()) for row, depth, _ in found]
        give_back()
        return pa.table({"lang": pa.array([langs[int(codes[row, 0])].as_py() for row, _, _ in found], pa.string()), "phrase": pa.array(texts, pa.string()),
                         "words": pa.array([d for _, d, _ in found], pa.int32()), "f": pa.array([f for _, _, f in found], pa.int64())})

    bin = F.pmod(F.xxhash64("lang", "route"), F.lit(bins))
    return routed.select("lang", "suffix", "n", "depth", bin.alias("bin")).groupBy("bin").applyInArrow(sort, "lang string, phrase string, words int, f long")


def equal_parts(codes: np.ndarray, weights: np.ndarray, rows: np.ndarray, start: int, least: int) -> list[tuple[int, int, int]]:
    """Multikey three-way quicksort: (a row, depth, count) of the equal parts from depth ``start`` on.

    ``codes`` has a row per suffix: its language, its words, and -1 behind the last one.
    Parts whose weights do not add up to ``least`` are abandoned.
    """
    found, todo = [], [(rows, 0)] if weights[rows].sum() >= least else []
    while todo:
        rows, depth = todo.pop()
        column = codes[rows, depth]
        a, b, c = int(column[0]), int(column[len(column) // 2]), int(column[-1])
        pivot = max(min(a, b), min(max(a, b), c))
        for part in (rows[column < pivot], rows[column > pivot]):
            if len(part) and weights[part].sum() >= least:
                todo.append((part, depth))
        if pivot >= 0:
            same = rows[column == pivot]
            total = int(weights[same].sum())
            if total >= least:
                if depth >= start:
                    found.append((int(same[0]), depth, total))
                if depth + 1 < codes.shape[1]:
                    todo.append((same, depth + 1))
    return found


def ranked(longer: DataFrame, frequent: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The best phrases of each language by their weakest cut; see :func:`collocations`.

    ``longer`` (lang, phrase, words, f), ``frequent`` (lang, word, n), ``totals`` (lang, n).
    """
    counts = frequent.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")).unionByName(longer.select("lang", "phrase", "f"))
    split = F.split("phrase", " ")
    # A phrase inside a longer one of its count is inside one that is longer by one word.
    inner = longer.filter("words > 2").select("lang", "f", F.explode(F.array(
        F.array_join(F.slice(split, 1, F.col("words") - 1), " "), F.array_join(F.slice(split, 2, F.col("words") - 1), " "))).alias("phrase"))
    kept = longer.join(inner.distinct(), ["lang", "phrase", "f"], "left_anti")
    cuts = kept.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.array_join(F.slice(split, F.lit(1), F.col("k")), " ")).withColumn(
        "right", F.array_join(F.slice(split, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang")
    # Whole numbers of up to 38 digits; the quotient is rounded down and fits a long.
    a, n, l, r = (f"cast({c} as decimal(16, 0))" for c in ("a", "n", "l", "r"))
    scored = cuts.withColumn("score", F.expr(f"({a} * {n} * cast(1000 as decimal(4, 0))) div ({l} * {r})"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", place).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
