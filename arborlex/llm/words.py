"""Vectorised word primitives over Arrow string columns.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; no UTF-8
sequence holds such bytes inside a character, so byte-wise splitting equals
splitting the text.  Nothing here loops over words in Python but for those of
32 bytes or more: word boundaries, word hashes (XXH64) and hashes of word
windows are whole-array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The five primes of XXH64.
_XXH = tuple(map(U64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)))
_MULT = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_POWERS: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element-wise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``m**i`` and ``m**-i`` modulo 2**64 for i < n."""
    m = _MULT[seed % 2]
    have = _POWERS.get(seed % 2)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(size, U64(m)), np.full(size, U64(pow(m, -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS[seed % 2] = have = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n + 1 word offsets of the rows."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = inside[edge]
    edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edge] = inside[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def _short_hashes(raw: np.ndarray, s: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of raw[s : s + n] for lengths n below 32; raw has eight bytes more than any word needs."""
    p1, p2, p3, p4, p5 = _XXH
    wide = np.ndarray(len(raw) - 7, "<u8", raw.data, strides=(1,))
    h = U64(seed) + p5 + n.astype(U64)
    for j in range(3):
        i = np.flatnonzero(n >= 8 * j + 8)
        if not len(i):
            break
        h[i] = _turn(h[i] ^ (_turn(wide[s[i] + 8 * j] * p2, 31) * p1), 27) * p1 + p4
    at = s + (n & ~7)
    i = np.flatnonzero(n & 4)
    h[i] = _turn(h[i] ^ ((wide[at[i]] & U64(0xFFFFFFFF)) * p1), 23) * p2 + p3
    at += n & 4
    for j in range(3):
        i = np.flatnonzero((n & 3) > j)
        h[i] = _turn(h[i] ^ (raw[at[i] + j].astype(U64) * p5), 11) * p1
    h ^= h >> U64(33)
    h *= p2
    h ^= h >> U64(29)
    h *= p3
    return h ^ (h >> U64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, seed: int = 0) -> np.ndarray:
    """XXH64 of every word's bytes; ``fold`` lower-cases A-Z first.

    Words of 32 bytes or more go to the library one by one, the others are hashed together, a
    megabyte or so at a time, cut between words.
    """
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + (1 << 20))))
        lo = int(starts[i])
        raw = data[lo : int(ends[i:j].max())]
        raw = np.concatenate([_LOWER[raw] if fold else raw, np.zeros(8, np.uint8)])
        s, n = starts[i:j] - lo, ends[i:j] - starts[i:j]
        long = np.flatnonzero(n >= 32)
        h = _short_hashes(raw, s, np.where(n < 32, n, 0), seed)
        if len(long):
            body = raw.data
            h[long] = [xxhash.xxh64_intdigest(body[x : x + m], seed) for x, m in zip(s[long].tolist(), n[long].tolist(), strict=True)]
        out[i:j] = h
        i = j
    return out


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of the len(words) - k + 1 windows of k consecutive words, across rows."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, step = np.empty(n, U64), 1 << 17
    up, down = _powers(seed, step + k)
    for i in range(0, n, step):
        j = min(n, i + step)
        part = words[i : j + k - 1]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[i:j] = mix((sums[k : k + j - i] - sums[: j - i]) * down[: j - i])
    return out


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' item offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def whole_windows(offsets: np.ndarray, k: int) -> np.ndarray:
    """True for each of the items at which a window of k items of one row starts."""
    end = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(len(end)) + k <= end


def pack(a: np.ndarray) -> bytes:
    """A compressed array: byte planes, then zstd."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return a.dtype.str.encode().ljust(4) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(b: bytes) -> np.ndarray:
    dtype = np.dtype(b[:4].decode().strip())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """pack() of the steps of an ascending array of unsigned integers."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    a = unpack(b)
    return np.cumsum(a, dtype=a.dtype)


def small(a: np.ndarray) -> np.ndarray:
    """The array in the narrowest unsigned type that holds it."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else U64)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int):
    """Cuts a batch into runs of rows whose texts hold about ``most_bytes`` at most."""
    n = batch.num_rows
    if not n:
        return
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(length, dtype=np.int64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most_bytes, "right")))
        yield batch.slice(i, j - i)
        i = j
