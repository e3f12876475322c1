"""Byte-level BPE over a whole corpus: each distinct word is encoded once.

Texts are cut into words (a blank and what follows it) inside blocks. The distinct words
of a block go, packed, to the shard of their hash; a shard merges the words of all
blocks, encodes each distinct word once and answers every block in its own order. Blocks
put the ids back by position. What is shuffled grows with distinct words per block, not
with occurrences, so a word that makes up a third of the corpus costs one entry per block.

Decoding joins ids to the token-byte table, whose size is that of the vocabulary.

Null texts count as empty and give no ids. Null and repeated document ids are kept, one
result row per input row. Only the two named columns are read, so others cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from ridestats.llm.blocks import cut, runs_of, shard_count, text_size
from ridestats.llm.packing import give_back, hashes, pack_ints, pack_strings, spans, split_pieces, unpack_ints, unpack_strings

_AT_ONCE = 1 << 18  # words whose ids are put together at a time


@lru_cache(maxsize=2)
def _ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


@lru_cache(maxsize=2)
def _encoder(content: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=_ranks(content), special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(content: bytes) -> np.ndarray:
    """Token-byte table: bytes by id, None where no token has the id."""
    ranks = _ranks(content)
    table = np.full(max(ranks.values(), default=-1) + 1, None, object)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _by_owner(words: bytes, n_shards: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a block, an order that brings those of a shard together, and the shards in it."""
    pieces = unpack_strings(words)
    shards = (hashes(pieces) % np.uint64(n_shards)).astype(np.int64)
    order = np.argsort(shards, kind="stable")
    return pieces, order, shards[order]


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids (id_col, ids) of every whole text."""
    n_shards = shard_count(text_size(docs, text_col))
    blocks = cut(docs, split_pieces, id_col, text_col, label=None)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch["block"].to_pylist(), batch["words"]):
                pieces, order, shards = _by_owner(words.as_py(), n_shards)
                for shard, a, b in runs_of(shards):
                    yield pa.RecordBatch.from_pydict(
                        {"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int64()),
                         "words": pa.array([pack_strings(pieces.take(pa.array(order[a:b])))], pa.binary())})
                give_back()

    def answer(group: pa.Table) -> pa.Table:
        asked = [unpack_strings(x.as_py()) for x in group["words"]]
        merged = pa.chunked_array(asked).combine_chunks().dictionary_encode()
        encoder = _encoder(ranks, pattern)
        ids = [encoder.encode_ordinary(w.decode()) for w in merged.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, starts = np.fromiter((i for x in ids for i in x), np.uint32, lengths.sum()), np.cumsum(lengths) - lengths
        codes, at, out = np.asarray(merged.indices), 0, []
        for words in asked:
            own = codes[at : at + len(words)]
            at += len(words)
            out.append((pack_ints(lengths[own].astype(np.uint32)), pack_ints(flat[spans(starts[own], lengths[own])])))
        give_back()
        return pa.table({"block": group["block"], "shard": group["shard"],
                         "lengths": pa.array([x for x, _ in out], pa.binary()),
                         "ids": pa.array([x for _, x in out], pa.binary())})

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    answers = blocks.mapInArrow(ask, "shard int, block long, words binary").groupBy(
        "shard").applyInArrow(answer, "block long, shard int, lengths binary, ids binary")

    def reassemble(own: pa.Table, answers: pa.Table) -> pa.Table:
        codes, counts = unpack_ints(own["codes"][0].as_py()), unpack_ints(own["counts"][0].as_py())
        pieces, order, _ = _by_owner(own["words"][0].as_py(), n_shards)
        by = np.argsort(np.asarray(answers["shard"])).tolist()
        ids = [unpack_ints(answers["ids"][i].as_py()) for i in by]
        ids = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        told = [unpack_ints(answers["lengths"][i].as_py()) for i in by]
        told = np.concatenate(told) if told else np.empty(0, np.uint32)
        lengths, starts = np.empty(len(pieces), np.int32), np.empty(len(pieces), np.int64)
        lengths[order] = told
        starts[order] = np.cumsum(told, dtype=np.int64) - told
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        after = np.concatenate([[0], np.cumsum(lengths[codes], dtype=np.int64)])[ends]
        out = np.empty(after[-1], np.int32)
        at = 0
        for a in range(0, len(codes), _AT_ONCE):
            some = codes[a : a + _AT_ONCE]
            found = ids[spans(starts[some], lengths[some])]
            out[at : at + len(found)] = found
            at += len(found)
        values = pa.LargeListArray.from_arrays(pa.array(after), pa.array(out))
        give_back()
        return pa.table({id_col: own["ids"].combine_chunks().flatten(), "ids": values.cast(pa.list_(pa.int32()))})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        reassemble, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes (id_col, bytes) of token ids; null ids give null. An id without a token is an error."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(ranks)
        for batch in batches:
            texts = [None if not x.is_valid else b"".join(table[np.asarray(x.values)].tolist()) for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.binary())], names=[id_col, "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(
        join, f"`{id_col}` {kind}, bytes binary")
