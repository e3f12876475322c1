"""Documents as blocks of coded words, kept in the shared folder.

Operators that must look up something for every distinct word or n-gram of the corpus
(byte-pair encoding, n-gram counts, shingle frequencies) work on blocks of documents
of bounded size: a block knows its distinct words and holds its texts as codes. Only
distinct things of a block are shuffled to the shard that owns them; answers go back to
the block in the same order. A hot word costs one entry per block, not one row per
occurrence, and a shard's size does not depend on how often a word occurs.

Where several jobs need the blocks, they are written once to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ridestats.llm.packing import coded, give_back, pack_ints, pack_strings, text_bytes
from ridestats.sources.scratch import stage

BLOCK_BYTES = 8 << 20  # text in a block; a longer single text makes a block of its own
BLOCK_ROWS = 1 << 17  # rows in a block
ROW_BITS, NUMBER_BITS = 18, 24  # of a row in its block and of a block in its partition; the rest numbers partitions
SHARD_BYTES = 24 << 20  # text per shard of the words or n-grams

Splitter = Callable[[np.ndarray, np.ndarray], tuple[pa.Array, np.ndarray]]


def text_size(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def shard_count(n_bytes: int) -> int:
    return max(1, -(-n_bytes // SHARD_BYTES))


def cut(docs: DataFrame, split: Splitter, id_col: str = "doc_id", text_col: str = "text",
        flag: Column | None = None, label: str | None = "blocks",
        block_bytes: int | None = None) -> DataFrame:
    """Blocks (block, ids, flags, counts, codes, words) of all documents.

    ``counts`` are the words of each document, ``codes`` index ``words``. A null text has
    no words; null and repeated ids are kept as they are. Without a label the blocks are
    not written but dealt out by number; every use in one plan reads the same exchange.
    A block depends on its input partition alone, so a repeated task makes it again.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                         (F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))).alias("flag"))
    kind, most = narrow.schema["id"].dataType.simpleString(), block_bytes or BLOCK_BYTES
    most_rows = BLOCK_ROWS

    def one(block: int, batch: pa.Table) -> pa.RecordBatch:
        texts = batch["text"].combine_chunks()
        words, counts = split(*text_bytes(texts))
        codes, distinct = coded(words)
        ids = batch["id"].combine_chunks()
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
             *[pa.array([x], pa.binary()) for x in (
                 pack_ints(np.asarray(batch["flag"].combine_chunks().cast(pa.uint8()))),
                 pack_ints(counts.astype(np.uint32)), pack_ints(codes), pack_strings(distinct))]],
            names=["block", "ids", "flags", "counts", "codes", "words"],
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size, rows = TaskContext.get().partitionId(), 0, [], 0, 0
        if task >> 63 - ROW_BITS - NUMBER_BITS:
            raise ValueError("too many partitions for block numbers")
        for batch in batches:
            for part in (piece for some in _rows(batch, most_rows) for piece in slices(some, "text", most)):
                held.append(part)
                size, rows = size + part.column("text").nbytes, rows + part.num_rows
                if size >= most or rows >= most_rows:
                    if number >> NUMBER_BITS:
                        raise ValueError("too many blocks in a partition")
                    yield one(task << NUMBER_BITS | number, pa.Table.from_batches(held))
                    number, held, size, rows = number + 1, [], 0, 0
                    give_back()
        if held:
            yield one(task << NUMBER_BITS | number, pa.Table.from_batches(held))
        give_back()

    schema = f"block long, ids array<{kind}>, flags binary, counts binary, codes binary, words binary"
    made = narrow.mapInArrow(blocks, schema)
    return stage(made, label) if label else made.repartition("block")


def _rows(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a part has about ``most`` bytes of text, or one row."""
    texts = batch.column(column)
    if texts.nbytes <= most or batch.num_rows < 2:
        yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), column, most)
    yield from slices(batch.slice(half), column, most)


def runs_of(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of the shards that ascending entries name; the others cost nothing."""
    cuts = (np.flatnonzero(np.diff(shards)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(shards)]):
        if a < b:
            yield int(shards[a]), a, b
