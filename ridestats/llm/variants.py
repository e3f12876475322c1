"""Spelling variants: words of a corpus that are one edit apart, grouped under the most frequent.

Words are counted where the texts are; only distinct words of a task are shuffled.

Reduced-alphabet generation. A fixed hash maps letters to a few symbols, a word to a
reduced word. One edit of a word is one edit of its reduced word, or none where a letter
gives way to one with the same symbol. So every word generates the full one-edit
neighbourhood of its reduced word over the symbols (itself, deletions, replacements,
insertions: some 16 entries a letter, whatever the real alphabet), and a join with the
reduced vocabulary finds all candidates, which are verified on the original strings. An
entry is a 64-bit polynomial hash, so a neighbour costs one number however long the word
is; equal hashes of different reduced words only add candidates. Each neighbour is made
once: runs of a symbol lose their first, and grow at their front.

Entries that no reduced word has are left out early by a bit table of fixed size
(``BITS``). A table that is full lets everything through: then the join alone decides.

Joins are merged, by hint: Spark goes by the size of files or of what a step reads, and would send
all neighbourhoods to the driver and every task where the vocabulary's file is small.

Forms point to words at least twice as frequent, so chains of forms have at most the
logarithm of the largest count as length and are followed by pointer doubling.

Null and empty texts have no words; null ids count as empty strings; repeated rows are rows
of their own. Of near words with equal counts the smallest stands first. No words, no rows.
Only the two named columns are read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ridestats.llm.bits import bit_table, maybe_in
from ridestats.llm.packing import give_back, mix
from ridestats.sources.scratch import stage

SYMBOLS = 8  # of the reduced alphabet
BITS = 26  # the table of reduced words has 2**26 bits, 8 MB
AT_ONCE = 1 << 21  # neighbours made at a time
LETTERS = "a-zÀ-ÿ"  # of words, A-Z lowered
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOLD = 97  # one run in so many loses a letter


def runs(docs: DataFrame, least: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word) of every occurrence: runs of letters, one in 97 of them with a letter deleted, by a hash of id and run."""
    lowered = F.translate(F.col(text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    found = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    hashed = each.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % _FOLD == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least)


def variant_groups(words: DataFrame, least: int = 3, factor: int = 2, symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word with ``least`` occurrences or more.

    n_near: words exactly one insertion, deletion or replacement away. form: the one of
    them with the largest count, if that is at least ``factor`` times the word's; form_n
    its count. root: the last word on the way from form to form, the word itself without.
    """
    if not 1 < symbols < 200 or factor < 2:
        raise ValueError("two symbols and a factor of two at least are needed")
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    vocabulary = stage(counted.withColumn("at", F.monotonically_increasing_id()), "vocabulary")  # numbers stay as written
    reduced = stage(vocabulary.select("word", "at").mapInArrow(_reduced(symbols), "at long, key long"), "reduced-words")
    table = bit_table(reduced, "key", BITS)
    asked = vocabulary.select("word", "at").mapInArrow(_neighbours(symbols, table), "at long, key long")
    met = asked.join(reduced.select("key", F.col("at").alias("near_at")).hint("merge"), "key").filter("at <> near_at")
    own = vocabulary.select("at", "word")
    other = vocabulary.select(F.col("at").alias("near_at"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = met.select("at", "near_at").join(own.hint("merge"), "at").join(other.hint("merge"), "near_at").filter(F.levenshtein("word", "near", 1) == 1)
    near = pairs.groupBy("at").agg(F.count_distinct("near_at").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    judged = vocabulary.join(near.hint("merge"), "at", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best")["down"]).alias("best_n"), F.col("best")["near"].alias("best"))
    holds = F.col("best_n") >= factor * F.col("n")
    forms = stage(judged.select("word", "n", "n_near", F.when(holds, F.col("best")).alias("form"), F.when(holds, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(forms.filter("form is not null").select("word", F.col("form").alias("root")), forms, factor)
    return forms.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame, forms: DataFrame, factor: int) -> DataFrame:
    """(word, root) of words with a form; a round doubles the way looked ahead."""
    largest = forms.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    longest, seen = largest.bit_length(), 1  # a form doubles the count at least
    while seen < longest:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stage(links.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        seen *= 2
    return links


def _symbols(words: pa.Array, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (from 1) of all words one after the other, and the words' lengths."""
    joined = [w.encode("latin-1") for w in words.to_pylist()]
    lengths = np.fromiter(map(len, joined), np.int64, len(joined))
    return np.frombuffer(b"".join(joined), np.uint8) % np.uint8(symbols) + np.uint8(1), lengths


def _by_length(batch: pa.RecordBatch, symbols: int, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and symbols, a matrix, of words of one length; ``wide`` entries a letter fit in memory."""
    letters, lengths = _symbols(batch["word"], symbols)
    starts, numbers = np.cumsum(lengths) - lengths, np.asarray(batch["at"])
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        step = max(1, AT_ONCE // (length * wide))
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            yield numbers[some], letters[starts[some][:, None] + np.arange(length)].astype(np.uint64)


def _ends(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all beginnings (1 of the empty one) and all ends of words, and the powers of the base."""
    m, length = letters.shape
    head, tail, power = np.ones((m, length + 1), np.uint64), np.zeros((m, length + 1), np.uint64), np.ones(length + 2, np.uint64)
    with np.errstate(over="ignore"):
        power[1:] = np.multiply.accumulate(np.full(length + 1, _BASE))
        for i in range(length):
            head[:, i + 1] = head[:, i] * _BASE + letters[:, i]
            tail[:, length - 1 - i] = tail[:, length - i] + letters[:, length - 1 - i] * power[i]
    return head, tail, power


def own_key(letters: np.ndarray) -> np.ndarray:
    """The hash of each reduced word."""
    head = np.ones(len(letters), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(letters.shape[1]):
            head = head * _BASE + letters[:, i]
    return mix(head)


def neighbours(letters: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the reduced words with one edit or none, each of them once."""
    m, length = letters.shape
    head, tail, power = _ends(letters)
    before = np.concatenate([np.zeros((m, 1), np.uint64), letters], axis=1)  # the letter in front of a place
    wide = max(1, AT_ONCE // m)
    with np.errstate(over="ignore"):
        yield np.arange(m), mix(head[:, length])
        for a in range(0, length + 1, wide):
            at = np.arange(a, min(a + wide, length + 1))
            inner = at[at < length]
            keys = head[:, inner] * power[length - 1 - inner] + tail[:, inner + 1]
            yield _chosen(keys, letters[:, inner] != before[:, inner])
            for s in range(1, symbols + 1):
                s = np.uint64(s)
                keys = (head[:, inner] * _BASE + s) * power[length - 1 - inner] + tail[:, inner + 1]
                yield _chosen(keys, letters[:, inner] != s)
                keys = (head[:, at] * _BASE + s) * power[length - at] + tail[:, at]
                yield _chosen(keys, before[:, at] != s)


def _chosen(keys: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, _ = np.nonzero(which)
    return rows, mix(keys[which])


def _reduced(symbols: int):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, letters in _by_length(batch, symbols, 1):
                yield _keyed(numbers, own_key(letters))
            give_back()

    return reduce


def _neighbours(symbols: int, table: np.ndarray):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, letters in _by_length(batch, symbols, 2):
                for rows, keys in neighbours(letters, symbols):
                    there = maybe_in(table, keys)
                    if there.any():
                        yield _keyed(numbers[rows[there]], keys[there])
            give_back()

    return ask


def _keyed(numbers: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"at": pa.array(numbers, pa.int64()), "key": pa.array(keys.view(np.int64))})


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`variant_groups` of the :func:`runs` of all texts."""
    return variant_groups(runs(docs, 5, id_col, text_col), 3, 2)
