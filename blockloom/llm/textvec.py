"""Vectorised work on UTF-8 buffers: spans, hashes, segmentation.

All functions take the raw bytes of an Arrow string column, so no Python string is made for
a document.  Spans are hashed eight bytes at a time with a finaliser after every step; there is
no polynomial whose factors texts could share.
"""

from __future__ import annotations

import ctypes
import unicodedata
from functools import lru_cache, wraps
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U64 = np.uint64
#: Bytes of text handled at once; a longer single document is handled alone.
CHUNK_BYTES = 1 << 20
#: Longer spans are hashed one by one.
LONG_SPAN = 1024
WINDOWS_TOGETHER = 1 << 15
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)).astype(np.uint64)


def hashes(at: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]; equal bytes give equal hashes wherever they stand.  at is lanes(data)."""
    return several_hashes(at, data, starts, ends, 1)[0]


def several_hashes(at: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> list[np.ndarray]:
    """hashes() and further ones independent of it, n in all."""
    size = ends - starts
    out = [mix(size.astype(np.uint64) + U64(0x9E3779B97F4A7C15 + 2 * k)) for k in range(n)]
    if len(far := np.flatnonzero(size > LONG_SPAN)):
        raw = memoryview(np.ascontiguousarray(data))
        for k in range(n):
            out[k][far] = [int.from_bytes(blake2b(raw[a:b], digest_size=8, person=b"%d" % k).digest(), "little") for a, b in zip(starts[far].tolist(), ends[far].tolist())]
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    place, left, value = starts[live], size[live], [o[live] for o in out]
    while len(live):
        lane = at[place] & _MASK[np.minimum(left, 8)]
        value = [mix(v ^ lane) for v in value]
        done = left <= 8
        for o, v in zip(out, value):
            o[live[done]] = v[done]
        on = ~done
        live, place, left, value = live[on], place[on] + 8, left[on] - 8, [v[on] for v in value]
    return out


def windows(at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the bytes place..place+width-1 of every place at which so many follow; width is at least 8.  at is lanes(data)."""
    n = max(0, len(at) - width)
    out = np.empty(n, np.uint64)
    for a in range(0, n, WINDOWS_TOGETHER):  # what is worked on stays in the cache
        m = min(WINDOWS_TOGETHER, n - a)
        out[a : a + m] = _windows(at[a : a + m + width - 8], width)[:m]
    return out


def _windows(at: np.ndarray, width: int) -> np.ndarray:
    n, out, have = len(at) - width + 8, at, 8
    while 2 * have <= width:
        out, have = _two(out[: len(out) - have], out[have:]), 2 * have
    if have < width:
        out = _two(out[:n], out[width - have :][:n])
    return mix(out)


def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * U64(0x9FB21C651E98DF25)
    x ^= x >> U64(31)
    x += b
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def trim() -> None:
    """Gives memory that numpy and Arrow have freed back to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run):
    """A function of batches that ends with trim()."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.dtype(np.int64 if wide else np.int32)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def packed(column: pa.Array) -> pa.Array:
    """Each text on its own as a zstd frame, for a shuffle: about two thirds of what the shuffle's codec leaves."""
    data, offsets = buffers(column)
    squeeze, raw, at = zstandard.ZstdCompressor(level=1).compress, memoryview(np.ascontiguousarray(data)), offsets.tolist()
    return pa.array([squeeze(raw[a:b]) for a, b in zip(at, at[1:])], pa.binary())


def unpacked(column: pa.Array) -> list[bytes]:
    """The texts of packed(), as bytes; null gives an empty text."""
    back = zstandard.ZstdDecompressor().decompress
    return [back(x) if x is not None else b"" for x in column.to_pylist()]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges [i, j) of documents with about limit bytes each, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def parts(column: pa.Array, limit: int = CHUNK_BYTES):
    """(i, j, bytes, offsets) of the column's documents i..j-1."""
    data, offsets = buffers(column)
    for i, j in chunks(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start+length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


# --- words between ASCII white space ---------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of ``[^\\x20\\x09-\\x0D]+``: starts, ends, and for each document its first word."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(_SPACE[data], out=inside[:n])
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside[:n].copy()
    follows = inside[1:].copy()
    follows[cuts[1:] - 1] = False
    last &= ~follows
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


# --- the pieces of the byte-level BPE pattern --------------------------------------------------

_S, _L, _N, _O = 0, 1, 2, 3


@lru_cache(None)
def _page(page: int) -> np.ndarray:
    out = np.empty(4096, np.uint8)
    for k in range(4096):
        c = chr(page * 4096 + k)
        kind = unicodedata.category(c)
        white = kind in ("Zs", "Zl", "Zp") or c in "\t\n\x0b\x0c\r\x85"
        out[k] = _S if white else {"L": _L, "N": _N}.get(kind[0], _O)
    return out


def classes(data: np.ndarray) -> np.ndarray:
    """Of each byte, the class of its character: white space, letter, number, other."""
    out = _page(0)[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        b0, b1, b2, b3 = (padded[lead + k].astype(np.int64) for k in range(4))
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        code = np.where(size == 2, (b0 & 31) << 6 | b1 & 63, np.where(size == 3, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
        kind, page = np.empty(len(lead), np.uint8), code >> 12
        for p in np.unique(page):
            at = page == p
            kind[at] = _page(int(p))[code[at] & 4095]
        for k in range(4):
            at = size > k
            out[lead[at] + k] = kind[at]
    return out


def bpe_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the matches of the byte-level BPE pattern, and for each document its first match.

    The matches tile every document, so a match ends where the next one starts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind, edge = classes(data), np.zeros(n + 1, bool)
    edge[offsets] = True
    blank = data == 0x20
    change = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= edge[:n]
    space = kind == _S
    begins_char = (data & 0xC0) != 0x80
    cut = change.copy()
    # A plain space belongs to the run of other characters that follows it.
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    cut &= ~(after_blank & ~space) | edge[:n]
    # Of several white-space characters before a run, the last one stands apart.
    final = np.flatnonzero(change[1:] & space[:-1] & ~edge[1:n])
    while len(bad := np.flatnonzero(~begins_char[final])):
        final[bad] -= 1
    cut[final] = True
    # 's 't 're 've 'm 'll 'd at the start of a match; the match before ends at the apostrophe.
    mark = np.flatnonzero((data == 0x27) & cut)
    if len(mark):
        wide = np.concatenate([data, np.zeros(2, np.uint8)])
        far = np.concatenate([edge, np.ones(2, bool)])
        one, two = wide[mark + 1], wide[mark + 2]
        short = ~far[mark + 1] & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = one.astype(np.int64) << 8 | two
        long = ~far[mark + 1] & ~far[mark + 2] & np.isin(pair, [0x7265, 0x7665, 0x6C6C])
        for hit, size in ((short, 2), (long, 3)):
            at = mark[hit]
            cut[at + 1] = False
            after = at + size
            after = after[after < n]
            cut[after] |= ~(after_blank[after] & ~space[after])
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets, "left")
