"""Interpolated modified Kneser-Ney model of word n-grams, and scores of whole texts.

Counting. Blocks of documents reduce their n-grams to sorted arrays of distinct 64-bit
hashes with counts. Arrays are cut by hash range, so a shard holds an even share however
often an n-gram occurs; a shard merges the arrays of all blocks. That is done from the
highest order down: the shard that merged an n-gram tells exactly one block that it owns
it, and owners add up continuation counts (distinct words to the left) and the counts of
their contexts for the next lower order.

Model. One row per shard and order in the shared folder: ascending hashes and, in the
same order, the counts. Workers write a shard's arrays to a file of their own, map it
into memory and search it by bisection; the file has no name and is gone with the worker.
No worker ever needs more than one shard at a time.

Disk. What blocks ask is written once per order, in ``ROUNDS`` rounds over blocks, and merged in
as many rounds over ranges of shards; texts are scored in rounds over blocks again. Each round's shuffle goes before
the next begins, and what was asked goes when it is merged, so what is held at a time are
the blocks, the model and the answers to the blocks.

Definitions. Tokens of a text: ``order - 1`` start marks (never predicted), its words in
lower case (A-Z only), one end mark. The count of an n-gram of the highest order is its
number of occurrences in training texts, of lower orders the number of distinct tokens in
front of it. ``p(w|ctx) = max(a - D(a), 0) / sum(a) + (D1 n1 + D2 n2 + D3 n3) / sum(a) *
p(w|shorter ctx)`` with discounts from the counts of counts of each order (0.5, 1, 1.5
where these give none); below unigrams stands the uniform 1 / (V + 1). Without training
texts all scores are uniform.

Null texts count as empty: one token, the end. Null ids are kept; every input row gives
one row. Only the named columns are read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ridestats.llm.blocks import cut, runs_of, shard_count, text_size
from ridestats.llm.packing import (
    give_back, joined, pack_ints, pack_sorted, split_words, unpack_ints, unpack_sorted, unpack_strings, word_hashes,
)
from ridestats.sources.scratch import delete_folder, stage

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)  # hashes of the two marks
ROUNDS = 4
BLOCK_BYTES = 4 << 20  # text in a block
_ASKED = "shard int, block long, keys binary, cols array<binary>"
_TOLD = "shard int, block long, keys binary, cols array<binary>, owned binary, stats array<long>"
# Columns of lower orders: continuation count, then of the n-gram as a context the sum of
# counts and how many counts are 1, 2 and more; for single words also occurrences.
ADJUSTED, TOTAL, ONES, TWOS, MORE, SEEN = range(6)


@dataclass(frozen=True)
class Order:
    """What is known of all n-grams of one order."""

    discounts: tuple[float, float, float]
    total: int  # sum of counts
    ones: int
    twos: int
    more: int


@dataclass(frozen=True)
class KneserNey:
    shards: tuple[DataFrame, ...]  # by order, from single words up
    orders: tuple[Order, ...]
    n_shards: int
    train_tokens: int
    vocabulary: int


class _Block:
    """Tokens of a block's documents with the hashes of the n-grams that end at each."""

    def __init__(self, row, order: int):
        counts = unpack_ints(row["counts"]).astype(np.int64)
        codes = unpack_ints(row["codes"]).astype(np.int64)
        words = word_hashes(unpack_strings(row["words"]))
        self.vocabulary = np.append(words, [START, END])
        self.lengths = counts + order  # start marks, words, end
        ends = np.cumsum(self.lengths)
        starts = ends - self.lengths
        tokens = np.full(int(ends[-1]) if len(ends) else 0, len(words), np.int64)
        tokens[ends - 1] = len(words) + 1
        where = np.arange(len(codes)) + np.repeat(order - 1 + order * np.arange(len(counts)), counts)
        tokens[where] = codes
        self.predicted = np.sort(np.concatenate([where, ends - 1]))
        # Tokens that are predicted or just in front of one, and their places among these.
        used = np.zeros(len(tokens), bool)
        used[self.predicted] = used[self.predicted - 1] = True
        self.used = np.flatnonzero(used)
        self.place = np.cumsum(used) - 1
        self.n_tokens = counts + 1
        self.train = np.repeat(unpack_ints(row["flags"]).astype(bool), self.n_tokens)
        self.tokens = tokens
        self.grams = [self.vocabulary[tokens]]
        for _ in range(order - 1):
            before = self.grams[-1]
            longer = np.zeros_like(before)
            longer[1:] = joined(before[:-1], self.grams[0][1:])
            self.grams.append(longer)
        self._distinct: dict[int, tuple] = {}

    def distinct(self, m: int, top: bool):
        """Ascending distinct m-grams, and where the predicted tokens and their contexts are."""
        if m not in self._distinct:
            if m == 1:  # the distinct words are known
                by_hash = np.argsort(self.vocabulary)
                rank = np.empty(len(by_hash), np.int64)
                rank[by_hash] = np.arange(len(by_hash))
                keys, at = self.vocabulary[by_hash], rank[self.tokens]
                self._distinct[m] = keys, at[self.predicted], at[self.predicted - 1]
            elif top:
                self._distinct[m] = *np.unique(self.grams[m - 1][self.predicted], return_inverse=True), None
            else:
                keys, at = np.unique(self.grams[m - 1][self.used], return_inverse=True)
                self._distinct[m] = keys, at[self.place[self.predicted]], at[self.place[self.predicted - 1]]
        return self._distinct[m]


def _rows(row_table: pa.Table) -> list[dict]:
    return row_table.to_pylist()


def _cut_by_range(block: int, keys: np.ndarray, cols: list[np.ndarray], n_shards: int) -> Iterator[pa.RecordBatch]:
    shards = ((keys >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)
    for shard, a, b in runs_of(shards):
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int64()),
             "keys": pa.array([pack_sorted(keys[a:b])], pa.binary()),
             "cols": pa.array([[pack_ints(c[a:b]) for c in cols]], pa.list_(pa.binary()))})


def mapped(values: np.ndarray) -> np.ndarray:
    """The values in a nameless file of this worker, mapped into memory."""
    if not len(values):
        return values
    with tempfile.TemporaryFile() as f:
        values.tofile(f)
        f.flush()
        return np.memmap(f, values.dtype, "r", shape=values.shape)


def _found(store: np.ndarray, cols: list[np.ndarray], keys: np.ndarray) -> list[np.ndarray]:
    """Columns of the keys in a mapped shard; 0 for unknown ones."""
    at = np.searchsorted(store, keys)
    at[at == len(store)] = 0
    hit = store[at] == keys if len(store) else np.zeros(len(keys), bool)
    return [np.where(hit, c[at], 0) if len(store) else np.zeros(len(keys), np.uint32) for c in cols]


def _merge(group: pa.Table) -> pa.Table:
    """Merge a shard: the model row, and an answer for every block that asked."""
    asked = [(r["block"], unpack_sorted(r["keys"]), [unpack_ints(c) for c in r["cols"]]) for r in _rows(group)]
    asked.sort(key=lambda r: r[0])
    store, at = np.unique(np.concatenate([k for _, k, _ in asked]), return_inverse=True)
    cols = [np.bincount(at, np.concatenate([c[i] for _, _, c in asked])).astype(np.uint64) for i in range(len(asked[0][2]))]
    wide = [c.astype(np.uint32) if c.max() < 2**32 else c for c in cols]
    main = cols[0]
    stats = [*((main == i).sum() for i in (1, 2, 3, 4)), (main >= 3).sum(), main.sum(), cols[-1].sum(), (cols[-1] > 0).sum()]
    shard = group["shard"][0].as_py()
    known = np.any([c > 0 for c in cols], axis=0)
    out = [(shard, None, pack_sorted(store[known]), [pack_ints(c[known]) for c in wide], None, [int(x) for x in stats])]
    store, wide = mapped(store), [mapped(c) for c in wide]
    free = np.asarray(main > 0).copy()
    for block, keys, _ in asked:
        place = np.searchsorted(store, keys)
        own = free[place]
        free[place] = False
        out.append((shard, block, None, [pack_ints(np.asarray(c)) for c in _found(store, wide, keys)],
                    pack_ints(np.packbits(own)), None))
    give_back()
    return _told(out)


def _told(out: list[tuple]) -> pa.Table:
    kinds = {"shard": pa.int32(), "block": pa.int64(), "keys": pa.binary(), "cols": pa.list_(pa.binary()),
             "owned": pa.binary(), "stats": pa.list_(pa.int64())}
    return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(kinds.items())})


def _collected(answers: list[dict], keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """A block's answers in the order of its keys: columns, and which keys it owns."""
    answers = sorted(answers, key=lambda r: r["shard"])
    cols, owned = [[] for _ in (answers[0]["cols"] if answers else [])], []
    for r in answers:
        parts = [unpack_ints(c) for c in r["cols"]]
        for c, part in zip(cols, parts):
            c.append(part)
        if r["owned"] is not None:
            owned.append(np.unpackbits(unpack_ints(r["owned"]))[: len(parts[0])])
    cols = [np.concatenate(c) for c in cols]
    if cols and len(cols[0]) != len(keys):
        raise RuntimeError("a block's n-grams differ from those it asked for")
    return cols, np.concatenate(owned).astype(bool) if owned else np.zeros(len(keys), bool)


_BLOCK = ("block", "flags", "counts", "codes", "words")


def _ask_top(order: int, n_shards: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, order)
                keys, at, _ = b.distinct(order, True)
                counts = np.bincount(at, b.train, len(keys)).astype(np.uint32)
                yield from _cut_by_range(row["block"], keys, [counts], n_shards)
                give_back()

    return ask


def _ask_lower(m: int, order: int, n_shards: int):
    """What a block adds to order ``m``, from the answers for order ``m + 1``."""

    def ask(own: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = _rows(own)
        b = _Block(row, order)
        above, at_above, _ = b.distinct(m + 1, m + 1 == order)
        cols, owned = _collected(_rows(answers), above)
        keys, words, contexts = b.distinct(m, False)
        # One place where each distinct longer n-gram that is predicted ends.
        place = np.full(len(above), -1, np.int64)
        place[at_above] = np.arange(len(at_above))
        mine = np.flatnonzero(owned & (place >= 0))
        a, place = cols[ADJUSTED][mine], place[mine]
        n, at = len(keys), contexts[place]
        out = [np.bincount(words[place], minlength=n), np.bincount(at, a, n),
               *(np.bincount(at[x], minlength=n) for x in (a == 1, a == 2, a >= 3))]
        if m == 1:
            out.append(np.bincount(words, b.train, n))
        batches = list(_cut_by_range(row["block"], keys, [c.astype(np.uint32) for c in out], n_shards))
        give_back()
        return pa.Table.from_batches(batches)

    return ask


def _discounts(t1: int, t2: int, t3: int, t4: int) -> tuple[float, float, float]:
    if min(t1, t2, t3, t4) > 0:
        y = t1 / (t1 + 2 * t2)
        found = (1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3)
        if all(0 < d <= i for i, d in enumerate(found, 1)):
            return found
    return 0.5, 1.0, 1.5


def fit(blocks: DataFrame, n_shards: int, order: int = 2) -> tuple[KneserNey, list[DataFrame]]:
    """The model of the flagged documents, and by order the answers to all blocks."""
    if order < 2:
        raise ValueError("an order of 2 at least is needed")
    shards, orders, answers, words = [], [], [], (0, 0)
    for m in range(order, 0, -1):
        if m == order:
            asked = [blocks.select(*_BLOCK).mapInArrow(_ask_top(order, n_shards), _ASKED)]
        else:
            asked = [own.cogroup(told).applyInArrow(_ask_lower(m, order, n_shards), _ASKED)
                     for own, told in _by_part(blocks.select(*_BLOCK), answers[0])]
        told = _merged(asked, n_shards, m)
        model = told.filter(F.col("part").isNull()).select("shard", "keys", "cols", "stats")
        sums = model.agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(8)]).first()
        t1, t2, t3, t4, more, total, seen, kinds = sums
        shards.insert(0, model)
        orders.insert(0, Order(_discounts(t1, t2, t3, t4), total, t1, t2, more))
        answers.insert(0, told.filter(F.col("part").isNotNull()).select("shard", "block", "cols", "owned", "part"))
        if m == 1:
            words = seen, kinds
    return KneserNey(tuple(shards), tuple(orders), n_shards, *words), answers


def _merged(asked: list[DataFrame], n_shards: int, m: int) -> DataFrame:
    """What shards say, in folders by round of blocks; model rows have none."""
    rounds = min(ROUNDS, n_shards)
    of_shard = F.floor(F.col("shard").cast("long") * rounds / n_shards).cast("int")
    written, told = [stage(part.withColumn("round", of_shard), f"asked-{m}", "round") for part in asked], []
    every = reduce(DataFrame.unionByName, written)
    for number in range(rounds):
        own = every.filter(F.col("round") == number).drop("round").groupBy("shard").applyInArrow(_merge, _TOLD)
        told.append(stage(own.withColumn("part", _part("block")), f"grams-{m}", "part"))
        for part in written:  # what this round has answered
            delete_folder(part.sparkSession, f"{part.staged_at}/round={number}")
    return reduce(DataFrame.unionByName, told)


def _by_part(blocks: DataFrame, told: DataFrame):
    """Blocks and what they were told, grouped by block, round by round."""
    for number in range(ROUNDS):
        yield tuple(df.filter(F.col("part") == number).drop("part").groupBy("block") for df in (blocks.withColumn("part", _part("block")), told))


def _part(block: str) -> Column:
    """The round in which a block is scored; null for none."""
    return F.when(F.col(block).isNotNull(), F.pmod(F.xxhash64(block), F.lit(ROUNDS)).cast("int"))


def _discounted(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return counts - np.array((0.0, *discounts))[np.minimum(counts, 3).astype(np.int64)]


def _scores(b: _Block, told: list[tuple[np.ndarray, ...]], model: KneserNey) -> tuple[np.ndarray, np.ndarray]:
    """log10 p of each predicted token, and how often it occurs in training."""
    order = len(model.orders)
    p = np.full(len(b.predicted), 1 / (model.vocabulary + 1))
    seen = np.zeros(len(b.predicted), np.uint64)
    for m in range(1, order + 1):
        _, at, _ = b.distinct(m, m == order)
        cols, known = told[m - 1], model.orders[m - 1]
        a = cols[ADJUSTED][at]
        if m == 1:
            seen = cols[SEEN][at]
            total, ones, twos, more = (np.full(len(p), x, np.float64) for x in (known.total, known.ones, known.twos, known.more))
        else:
            context = b.distinct(m - 1, False)[2]
            total, ones, twos, more = (told[m - 2][i][context].astype(np.float64) for i in (TOTAL, ONES, TWOS, MORE))
        d1, d2, d3 = known.discounts
        some = total > 0
        total[~some] = 1
        share = (d1 * ones + d2 * twos + d3 * more) / total
        p = np.where(some, _discounted(a, known.discounts) / total + share * p, p)
    return np.log10(p), seen


def _score(model_facts: KneserNey, kind: str):
    order = len(model_facts.orders)

    def score(own: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = _rows(own.drop_columns(["ids"]))
        b, answers = _Block(row, order), _rows(answers)
        told = [_collected([r for r in answers if r["m"] == m], b.distinct(m, m == order)[0])[0] for m in range(1, order + 1)]
        logs, seen = _scores(b, told, model_facts)
        starts = np.cumsum(b.n_tokens) - b.n_tokens
        base = np.log10((seen + 1.0) / (model_facts.train_tokens + model_facts.vocabulary + 1.0))
        give_back()
        sums = [np.add.reduceat(x, starts) for x in (logs, base, (seen > 0).astype(np.int64))]
        return pa.table({"doc_id": own["ids"].combine_chunks().flatten(),
                         "train": pa.array(unpack_ints(row["flags"]).astype(bool)),
                         "n_tokens": pa.array(b.n_tokens, pa.int64()), "n_known": pa.array(sums[2], pa.int64()),
                         "base_score": pa.array(sums[1]), "score": pa.array(sums[0])})

    return score, f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(blocks: DataFrame, answers: list[DataFrame], model: KneserNey) -> DataFrame:
    told = None
    for m, df in enumerate(answers, 1):
        df = df.select("block", "shard", "cols", F.lit(None).cast("binary").alias("owned"), F.lit(m).alias("m"), "part")
        told = df if told is None else told.unionByName(df)
    facts = KneserNey((), model.orders, model.n_shards, model.train_tokens, model.vocabulary)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    scored = [stage(own.cogroup(some).applyInArrow(*_score(facts, kind)), "scores") for own, some in _by_part(blocks.select(*_BLOCK, "ids"), told)]
    return reduce(DataFrame.unionByName, scored)


def fit_and_score(docs: DataFrame, train: Column, order: int = 2, id_col: str = "doc_id",
                  text_col: str = "text") -> tuple[DataFrame, KneserNey]:
    """Scores of all texts under the model of those where ``train`` holds, and the model.

    Rows: doc_id, train, n_tokens, n_known (tokens seen in training), base_score (log10
    probability under add-one single words), score (log10 probability under the model).
    """
    n_shards = shard_count(text_size(docs, text_col))
    blocks = cut(docs, split_words, id_col, text_col, train, "lm-blocks", BLOCK_BYTES)
    model, answers = fit(blocks, n_shards, order)
    return _scored(blocks, answers, model), model


def score(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of other texts under a fitted model; rows as in :func:`fit_and_score`."""
    order, n_shards = len(model.orders), model.n_shards
    blocks = cut(docs, split_words, id_col, text_col, None, "lm-texts", BLOCK_BYTES)

    def ask(m: int):
        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield from _cut_by_range(row["block"], _Block(row, order).distinct(m, m == order)[0], [], n_shards)

        return asked

    def answer(width: int):
        def told(asked: pa.Table, shard: pa.Table) -> pa.Table:
            known = _rows(shard)
            store = mapped(unpack_sorted(known[0]["keys"]) if known else np.empty(0, np.uint64))
            cols = [mapped(unpack_ints(c)) for c in known[0]["cols"]] if known else [np.empty(0, np.uint32)] * width
            return _told([(r["shard"], r["block"], None, [pack_ints(np.asarray(c)) for c in _found(store, cols, unpack_sorted(r["keys"]))], None, None)
                          for r in _rows(asked)])

        return told

    answers = []
    for m in range(1, order + 1):  # each order's answers are written once, all rounds read them
        asked = blocks.select(*_BLOCK).mapInArrow(ask(m), _ASKED)
        width = 6 if m == 1 else 1 if m == order else 5
        told = (asked.groupBy("shard").cogroup(model.shards[m - 1].select("shard", "keys", "cols").groupBy("shard"))
                       .applyInArrow(answer(width), _TOLD).select("shard", "block", "cols", "owned", _part("block").alias("part")))
        answers.append(stage(told, f"answers-{m}", "part"))
    return _scored(blocks, answers, model)


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds ``perplexity`` per document: 10 to the mean negative log10 probability of a token."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
