"""Arrays as compact binary values, and words as codes.

Blocks of documents, word lists and sorted hash arrays travel through Spark as binary
columns: one row holds what would otherwise be a hundred thousand rows. Everything here
is plain numpy and Arrow on one bounded block.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
_ZSTD = pa.Codec("zstd", compression_level=1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_STOP, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".,")] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_ONES = np.uint64(0xFFFF_FFFF_FFFF_FFFF)
_LONG = 256  # bytes of words that are hashed one by one
# Bytes after which a cut before a blank is safe for byte-pair patterns: not a blank of
# any kind, nor the first byte of one outside ASCII.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xE1] = True
_SOLID[0xE4:0xF5] = True


def give_back() -> None:
    """Return freed memory to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def pack_ints(values: np.ndarray) -> bytes:
    """Byte planes of the values, compressed; the type is kept."""
    values = np.ascontiguousarray(values)
    kind = values.dtype.str.encode().ljust(4)
    if not len(values):
        return kind + (0).to_bytes(8, "little")
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return kind + len(values).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def unpack_ints(data) -> np.ndarray:
    data = bytes(data)
    kind, n = np.dtype(data[:4].strip().decode()), int.from_bytes(data[4:12], "little")
    if not n:
        return np.empty(0, kind)
    raw = _ZSTD.decompress(data[12:], n * kind.itemsize, asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned values as differences."""
    return pack_ints(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data) -> np.ndarray:
    gaps = unpack_ints(data)
    return np.cumsum(gaps, dtype=gaps.dtype)


def pack_strings(words: pa.Array) -> bytes:
    words = words.cast(pa.large_binary())
    lengths = pack_ints(np.asarray(pc.binary_length(words), dtype=np.uint32))
    start, end = _ends(words)
    body = np.frombuffer(words.buffers()[2] or b"", np.uint8)[start:end]
    packed = _ZSTD.compress(np.ascontiguousarray(body), asbytes=True) if end > start else b""
    return len(lengths).to_bytes(8, "little") + lengths + packed


def unpack_strings(data) -> pa.Array:
    data = bytes(data)
    n = int.from_bytes(data[:8], "little")
    lengths = unpack_ints(data[8 : 8 + n])
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    body = _ZSTD.decompress(data[8 + n :], int(offsets[-1])) if offsets[-1] else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), body])


def _ends(words: pa.Array) -> tuple[int, int]:
    if not len(words):
        return 0, 0
    offsets = np.frombuffer(words.buffers()[1], np.int64)
    return int(offsets[words.offset]), int(offsets[words.offset + len(words)])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (plus the end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(data: np.ndarray, ends: np.ndarray, lower: bool = True, stops: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts, and how many each text has.

    With ``stops``, full stops and commas behind an ASCII letter begin a word of their own.
    """
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    start[first] = solid[first]
    if stops:
        start[1:] |= _STOP[data[1:]] & _LETTER[data[:-1]]
    starts = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(starts, ends))
    before = np.cumsum(solid, dtype=np.int32 if len(solid) < 1 << 31 else np.int64)
    offsets = np.empty(len(starts) + 1, np.int64)
    offsets[:-1] = before[starts] - 1
    offsets[-1] = before[-1] if len(before) else 0
    return _strings(data[solid], offsets), counts


def split_pieces(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts cut before each blank that a visible character follows.

    A byte-pair pattern of the usual kind takes at most one blank in front of a word, so
    none of its matches spans such a cut and no match depends on what lies beyond it.
    """
    start = np.zeros(len(data), bool)
    start[:-1] = _SPACE[data[:-1]] & _SOLID[data[1:]]
    start[ends[1:-1][ends[1:-1] < len(data)] - 1] = False  # the next byte is another text's
    start[ends[:-1][ends[:-1] < ends[1:]]] = True
    starts = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(starts, ends))
    return _strings(data, np.append(starts, len(data)).astype(np.int64)), counts


def _strings(body: np.ndarray, offsets: np.ndarray) -> pa.Array:
    body, offsets = np.ascontiguousarray(body), np.ascontiguousarray(offsets)
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)]
    )


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words, the most frequent word being 0, and the distinct words."""
    if not len(words):
        return np.empty(0, np.uint32), words
    pairs = words.dictionary_encode()
    codes = np.asarray(pairs.indices)
    order = np.argsort(-np.bincount(codes, minlength=len(pairs.dictionary)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return rank[codes], pairs.dictionary.take(pa.array(order))


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words.to_pylist()), np.uint64, len(words))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word from its bytes, eight at a time for all words; unlike :func:`hashes`."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    start, end = int(offsets[0]), int(offsets[-1])
    body = np.zeros(end - start + 8, np.uint8)  # eight bytes can be read from every place
    if end > start:
        body[:-8] = np.frombuffer(words.buffers()[2], np.uint8)[start:end]
    eight = np.ndarray(len(body) - 7, "<u8", body, strides=(1,))
    at, left = offsets[:-1] - start, np.diff(offsets)
    out = mix(left.astype(np.uint64) + np.uint64(0x57C5_9D2F))  # words that differ in zero bytes at the end
    short = left <= _LONG
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh64_intdigest(body[at[i] : at[i] + left[i]])
    todo = np.flatnonzero(short & (left > 0))
    while len(todo):
        rest = left[todo]
        some = eight[at[todo]] & (_ONES >> (np.uint64(8) * (8 - np.minimum(rest, 8)).astype(np.uint64)))
        out[todo] = joined(out[todo], some)
        todo = todo[rest > 8]
        at[todo] += 8
        left[todo] -= 8
    return out


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    values = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        values ^= values >> np.uint64(30)
        values *= np.uint64(0xBF58476D1CE4E5B9)
        values ^= values >> np.uint64(27)
        values *= np.uint64(0x94D049BB133111EB)
        values ^= values >> np.uint64(31)
    return values


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hash of ordered pairs of 64-bit hashes."""
    with np.errstate(over="ignore"):
        return mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) + np.uint64(0x632BE59BD9B4E019))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, .. for lengths[0], then those of the next span."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
