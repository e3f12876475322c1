"""Token sequences of documents packed into as few fixed-size sequences as possible.

A document is the ids of its words and an end id; only longer ones are cut into full
pieces and a rest. What packing needs to know of the pieces is how many there are of each
length, at most ``size`` numbers whatever the corpus. From these the driver plans
patterns: which lengths share a sequence, and how many sequences look like that. The plan
starts with best fit, longest first, and is improved by a local search between underfull
sequences: move a piece, exchange one for one or two for one, whenever the sum of squared
fills grows, until sequences run empty.

The pieces themselves stay distributed: each gets a running number among those of its
length (counts per task, summed up), and the number says which sequence of which pattern
it goes to and where. No task sees more than its own rows and the plan, which has at most
a few entries per length.

Making and numbering pieces are jobs of their own: as one, each task would hold two Python
workers, and all of them would come to hold a tokenizer, as Spark deals out idle workers in turn.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ridestats.llm.blocks import slices
from ridestats.llm.packing import coded, give_back, spans, split_words, text_bytes
from ridestats.sources.scratch import small_batches, stage, unstage

PART_BYTES = 6 << 20
BATCH_BYTES = 4 << 20  # that a worker is sent at a time
END_ID = 0
MET_WORDS = 250_000  # words whose ids a worker keeps
ENCODE_WORDS = 8_192  # words that the library encodes at a time; what it returns of one takes over a kilobyte


@lru_cache(maxsize=1)
def _tokenizer(content: bytes) -> tuple:
    """The tokenizer, ids of words that this worker has met, and where added tokens may stand."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(content)
    added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    if any(re.search(r"[\s.,]", token) for token in added):
        raise ValueError("added tokens with blanks, stops or commas cannot be found word by word")
    if not added:
        return tokenizer, {}, None
    found, begins = re.compile("|".join(map(re.escape, added)).encode(), re.I), {token[:2].encode() for token in added}
    plain = not any(b.isalpha() for token in begins for b in token.decode())

    def stands_in(text: bytes) -> bool:  # in any case; how tokens begin rules most texts out
        return (not plain or any(b in text for b in begins)) and found.search(text) is not None

    return tokenizer, {}, stands_in


def _encoded(words: list[bytes], content: bytes) -> list[bytes]:
    """Ids of each word, four bytes each. Met words are looked up, up to a number of them."""
    tokenizer, met, _ = _tokenizer(content)
    ids = list(map(met.get, words))
    new = [i for i, found in enumerate(ids) if found is None]
    for at in range(0, len(new), ENCODE_WORDS):
        some = new[at : at + ENCODE_WORDS]
        for i, encoded in zip(some, tokenizer.encode_batch_fast([words[i].decode() for i in some], add_special_tokens=False)):
            ids[i] = array("I", encoded.ids).tobytes()
    for i in new[: max(0, MET_WORDS - len(met))]:
        met[words[i]] = ids[i]
    return ids


def _ids(texts: pa.Array, content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, each with its end id, and their lengths.

    The tokenizer drops white space, and no token spans it or goes from a letter on to a
    stop, so a text's ids are those of its words; each distinct word of a part is encoded
    once. It lowers case after composing characters: A-Z may be lowered before, unless
    there are combining marks (lead bytes CC and CD) to compose with. Added tokens, such
    as an end mark written out, are found by the tokenizer inside words as in the whole
    text; it does so before it lowers case, so parts with their strings are not lowered.
    """
    data, ends = text_bytes(texts)
    added = _tokenizer(content)[2]
    as_is = ((data == 0xCC) | (data == 0xCD)).any() or added is not None and added(data.tobytes())
    words, counts = split_words(data, ends, lower=not as_is, stops=True)
    del data
    codes, distinct = coded(words)
    del words
    encoded = _encoded(distinct.to_pylist(), content)
    per_word = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
    flat = np.frombuffer(b"".join(encoded), np.uint32)
    del encoded, distinct
    starts = np.cumsum(per_word) - per_word
    sizes = per_word[codes]
    ends = np.cumsum(counts)
    before = np.concatenate([[0], np.cumsum(sizes)])
    lengths = before[ends] - before[ends - counts] + 1
    out = np.full(int(lengths.sum()), END_ID, np.uint32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(lengths) - 1] = False
    out[inside] = flat[spans(starts[codes], sizes)]
    return out, lengths


def pieces(docs: DataFrame, tokenizer: bytes, size: int = 2048, with_ids: bool = False, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of every row, in no order.

    ``tokenizer`` is the content of a tokenizers file. A null or blank text is its end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", PART_BYTES):
                ids, lengths = _ids(rows["text"], tokenizer)
                n_pieces = -(-lengths // size)
                doc = np.repeat(np.arange(len(lengths)), n_pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = number * size
                length = np.minimum(size, lengths[doc] - start)
                at = (np.cumsum(lengths) - lengths)[doc] + start
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                columns = [rows["doc_id"].take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    ends = np.append(at, len(ids))  # pieces lie one after the other
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                give_back()

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pack(items: DataFrame, size: int = 2048, length_col: str = "length") -> DataFrame:
    """All columns of the items and their place: sequence_id and offset (longs).

    Lengths are whole numbers from 1 to ``size``; anything else is an error. Columns of
    the items called like one that is added are replaced.
    """
    keep = [c for c in items.columns if c not in ("sequence_id", "offset")]
    items = items.select(*keep)
    columns = items.columns
    task, rank, base = (_free(columns, name) for name in ("task", "rank", "base"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, used = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            lengths = np.asarray(batch.column(length_col).cast(pa.int64()))
            if batch.column(length_col).null_count or ((lengths < 1) | (lengths > size)).any():
                raise ValueError(f"lengths must lie between 1 and {size}")
            order = np.argsort(lengths, kind="stable")
            firsts = np.searchsorted(lengths[order], lengths[order])
            ranks = np.empty(len(lengths), np.int64)
            ranks[order] = np.arange(len(lengths)) - firsts + used[lengths[order]]
            used += np.bincount(lengths, minlength=size + 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(lengths), own)), pa.array(ranks)], names=[*columns, task, rank])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    with small_batches(items.sparkSession, BATCH_BYTES):
        made = stage(items, "pieces")
        numbered = stage(made.mapInArrow(number, f"{fields}, `{task}` long, `{rank}` long"), "numbered-pieces")
    unstage(made)
    length = F.col(length_col).cast("long")
    counts = stage(numbered.groupBy(length.alias("n"), F.col(task).alias("t")).agg(F.count("*").alias("c")), "piece-counts")
    histogram = np.zeros(size + 1, np.int64)
    for row in counts.groupBy("n").agg(F.sum("c").alias("c")).collect():  # at most ``size`` rows
        histogram[row.n] = row.c
    before = F.sum("c").over(Window.partitionBy("n").orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(F.col("n").alias("_n"), F.col("t").alias("_t"), F.coalesce(before, F.lit(0)).alias(base))
    ranked = numbered.join(bases, (length == F.col("_n")) & (F.col(task) == F.col("_t"))).select(
        *columns, (F.col(rank) + F.col(base)).alias(rank))
    runs = _runs(plan(histogram, size), size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column(length_col).cast(pa.int64()))
            ranks = np.asarray(batch.column(rank))
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for n in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == n)
                firsts, sequences, copies, offsets = runs[n]
                at = np.searchsorted(firsts, ranks[mine], side="right") - 1
                within = ranks[mine] - firsts[at]
                sequence[mine] = sequences[at] + within // copies[at]
                offset[mine] = offsets[at] + within % copies[at] * n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def _free(columns: list[str], name: str) -> str:
    while name in columns:
        name += "_"
    return name


Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def _runs(patterns: dict[Pattern, int], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, ascending first ranks with sequence, copies per sequence and offset."""
    runs: dict[int, list] = {}
    taken = np.zeros(size + 1, np.int64)
    sequence = 0
    for pattern, times in sorted(patterns.items(), reverse=True):
        offset = 0
        for n, copies in pattern:
            runs.setdefault(n, []).append((taken[n], sequence, copies, offset))
            taken[n] += copies * times
            offset += n * copies
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in runs.items()}


def plan(histogram: np.ndarray, size: int) -> dict[Pattern, int]:
    """How many sequences hold which lengths, for ``histogram[n]`` pieces of length n."""
    bins = _Bins(size)
    for n in range(size, 0, -1):
        bins.best_fit(n, int(histogram[n]))
    bins.improve()
    return {tuple(sorted(p.items(), reverse=True)): c for p, c in bins.patterns()}


class _Bins:
    """Sequences by pattern; those of one pattern are counted, not listed."""

    def __init__(self, size: int):
        self.size = size
        self.by_room: list[dict[Pattern, int]] = [{} for _ in range(size + 1)]

    def patterns(self) -> list[tuple[dict[int, int], int]]:
        return [(dict(p), c) for group in self.by_room for p, c in group.items() if p]

    def _add(self, pattern: dict[int, int], count: int) -> None:
        if count and pattern:
            key = tuple(sorted(pattern.items()))
            group = self.by_room[self.size - sum(n * c for n, c in key)]
            group[key] = group.get(key, 0) + count

    def _take(self, room: int, key: Pattern, count: int) -> None:
        left = self.by_room[room][key] - count
        if left:
            self.by_room[room][key] = left
        else:
            del self.by_room[room][key]

    def best_fit(self, n: int, count: int) -> None:
        """Put ``count`` pieces of length n where the least room is left that holds them."""
        room = n
        while count and room <= self.size:
            group = self.by_room[room]
            if not group:
                room += 1
                continue
            key, free = next(iter(group.items()))
            each = min(room // n, count)
            bins = min(free, count // each)
            self._take(room, key, bins)
            pattern = dict(key)
            pattern[n] = pattern.get(n, 0) + each
            self._add(pattern, bins)
            count -= bins * each
        each = self.size // n
        self._add({n: each}, count // each)
        self._add({n: count % each} if count % each else {}, 1)

    def improve(self) -> None:
        """Empty the least filled sequences into the others, until no change is left.

        From the emptiest pattern on, the change with the largest growth of the sum of
        squared fills is made: move a piece, or exchange one or two pieces for a shorter
        one. A change is made for as many sequences of the two patterns as there are. The
        sum grows with every change, so the search ends: when no pattern has a change
        left, or when there are no more sequences than the pieces need at least.
        """
        least = -(-sum(n * c * times for p, times in self.patterns() for n, c in p.items()) // self.size)
        bins = sum(c for group in self.by_room for c in group.values())
        others = _Others(self.size)
        for room in range(1, self.size):
            for key in self.by_room[room]:
                others.add(room, key)
        seen: dict[Pattern, int] = {}  # up to which entry nothing was found for a pattern
        before = -1
        while before < others.last:  # patterns of the last round have not met its new ones
            before = others.last
            todo = [(-room, key) for room in range(1, self.size) for key in self.by_room[room]]
            heapq.heapify(todo)
            while todo and bins > least:
                room, key = -todo[0][0], todo[0][1]
                count = self.by_room[room].get(key, 0)
                change = others.best(room, key, count, seen.get(key, 0)) if count else None
                if change is None:
                    seen[key] = others.last
                    heapq.heappop(todo)
                    continue
                other, parts, gives = change
                known = {k: self.by_room[self.size - _fill(k)].get(k, 0) for k in (key, other)}
                left, full, times = self._exchange(room, key, self.size - _fill(other), other, parts, gives)
                bins -= 0 if left else times
                for k in (key, other):
                    if k not in self.by_room[self.size - _fill(k)]:
                        others.drop(k)
                for k in {left, full} - {()}:
                    at = self.size - _fill(k)
                    if not 0 < at < self.size:
                        continue
                    if others.holds(k):  # a second sequence of a pattern can be exchanged with the first
                        if self.by_room[at][k] > 1 and known.get(k, 0) < 2:
                            others.drop(k)
                            others.add(at, k)
                    else:
                        others.add(at, k)
                    heapq.heappush(todo, (-at, k))

    def _exchange(self, room: int, donor: Pattern, other: int, key: Pattern, parts: tuple[int, ...], gives: int) -> tuple[Pattern, Pattern, int]:
        """The change for as many sequences as there are; both new patterns and that number."""
        same = donor == key and room == other
        times = self.by_room[room][donor] // 2 if same else min(self.by_room[room][donor], self.by_room[other][key])
        if same:
            self._take(room, donor, 2 * times)
        else:
            self._take(room, donor, times)
            self._take(other, key, times)
        left, full = dict(donor), dict(key)
        for n in parts:
            left[n] -= 1
            full[n] = full.get(n, 0) + 1
        if gives:
            full[gives] -= 1
            left[gives] = left.get(gives, 0) + 1
        for pattern in (left, full):
            self._add({n: c for n, c in pattern.items() if c}, times)
        return *(tuple(sorted((n, c) for n, c in p.items() if c)) for p in (left, full)), times


def _fill(key: Pattern) -> int:
    return sum(n * c for n, c in key)


class _Others:
    """What sequences may take part in a change: room, and a piece they give back (0: none).

    Entries are numbered as they come, so that a pattern without a change need only be
    held against those that are new. Dropped ones stay, without room, until they are many.
    """

    def __init__(self, size: int):
        self.size, self.last, self.n, self.dead = size, 0, 0, 0
        self.number, self.room, self.take = (np.zeros(1024, np.int64) for _ in range(3))
        self.keys: list[Pattern | None] = []
        self.at: dict[Pattern, int] = {}

    def holds(self, key: Pattern) -> bool:
        return key in self.at

    def add(self, room: int, key: Pattern) -> None:
        end = self.n + len(key) + 1
        if end > len(self.room):
            self.number, self.room, self.take = (np.concatenate([x, np.zeros(max(len(x), end), np.int64)]) for x in (self.number, self.room, self.take))
        self.last += 1
        self.at[key] = self.n
        self.number[self.n : end], self.room[self.n : end] = self.last, room
        self.take[self.n : end] = (0, *(n for n, _ in key))
        self.keys += [key] * (len(key) + 1)
        self.n = end

    def drop(self, key: Pattern) -> None:
        at = self.at.pop(key, None)
        if at is None:
            return
        end = at + len(key) + 1
        self.room[at:end], self.take[at:end] = -1, 0
        self.dead += end - at
        if self.dead > max(1000, self.n // 2):
            live = np.flatnonzero(self.room[: self.n] >= 0)
            for x in (self.number, self.room, self.take):
                x[: len(live)] = x[live]
            self.keys = [self.keys[i] for i in live.tolist()]
            self.n, self.dead = len(live), 0
            self.at = {}
            for i, k in enumerate(self.keys):
                self.at.setdefault(k, i)

    def best(self, room: int, donor: Pattern, count: int, seen: int) -> tuple[Pattern, tuple[int, ...], int] | None:
        """Other pattern, pieces given, piece taken; None if nothing newer than ``seen`` grows.

        For one other the growth, gain * (its fill - own fill + gain), is the largest for the
        largest gain that there is room for, wherever it is above 0.
        """
        first = int(np.searchsorted(self.number[: self.n], seen, side="right"))
        if first == self.n:
            return None
        rooms, takes = self.room[first : self.n], self.take[first : self.n]
        single = {n: (n,) for n, _ in donor}
        double = {a + b: (a, b) for a, x in donor for b, _ in donor if a < b or a == b and x > 1} | single
        limit, gain = rooms + takes, np.zeros(len(rooms), np.int64)
        for sums, mine in ((single, takes == 0), (double, takes > 0)):
            offers = np.array([0, *sorted(sums)], np.int64)
            given = offers[np.maximum(np.searchsorted(offers, limit[mine], side="right") - 1, 0)]
            gain[mine] = given - takes[mine]
        growth = gain * (room - rooms + gain)
        growth[(gain <= 0) | (rooms < 0)] = 0
        if count == 1 and self.at.get(donor, -1) >= first:
            at = self.at[donor] - first
            growth[at : at + len(donor) + 1] = 0
        at = int(np.argmax(growth))
        if growth[at] <= 0:
            return None
        take = int(takes[at])
        return self.keys[first + at], (double if take else single)[int(gain[at]) + take], take
