"""Vectorised text primitives over Arrow string buffers: one NumPy pass over a chunk of whole texts, no loop per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX_A, _MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * _MIX_A
    x = x ^ (x >> U64(27))
    x = x * _MIX_B
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, n of each at least."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            full = np.full(size, base, U64)
            full[0] = 1
            _powers[k] = np.cumprod(full)
    return _powers[0], _powers[1]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets) of runs of whole texts of about `limit` bytes; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def parts(batches: Iterator[pa.RecordBatch], column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `limit` bytes of the text in a column, so that work on a slice has bounded memory."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def word_spans(buf: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the words and the row of each; a word never crosses a text's end."""
    n = len(buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    keep = ~separator[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, keep[:-1]
    start = np.flatnonzero(keep & (~before | edge[:n]))
    before[-1], before[:-1] = False, keep[1:]
    end = np.flatnonzero(keep & (~before | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums from which span_hashes reads the polynomial hash of any span."""
    sums = np.empty(len(buf) + 1, U64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * powers(len(buf) + 1)[0][: len(buf)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same for equal spans in any text."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, at every start from which k words follow."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    p = powers(k + 1)[0]
    out = np.zeros(n, U64)
    for i in range(k):
        out += words[i : i + n] * p[i + 1]
    return mix(out)
