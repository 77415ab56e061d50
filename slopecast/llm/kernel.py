"""NumPy helpers that run inside tasks on Arrow batches of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # bytes of text handled by one set of NumPy calls
_RNG = np.random.default_rng(20240601)
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
BASE_INV = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_table(members: bytes) -> np.ndarray:
    """A 256-entry membership table."""
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


SPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
NOT_SPACE = ~SPACE
# letters and digits of ASCII and every byte of a longer UTF-8 sequence
WORD_BYTES = byte_table(
    b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, CHUNK_BYTES), np.uint64(base), np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if len(have) <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have[:n]


def raw_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null text has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def text_chunks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets into them): runs of whole rows of about ``CHUNK_BYTES``."""
    data, off = raw_text(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(member: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``member``, also cut at the positions ``cuts``."""
    n = len(member)
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    before = np.concatenate(([False], member[:-1]))
    after = np.concatenate((member[1:], [False]))
    starts = np.flatnonzero(member & (~before | edge[:n]))
    ends = np.flatnonzero(member & (~after | edge[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes hash alike wherever they stand."""
    n = len(data)
    if not n or not len(starts):
        return np.zeros(len(starts), np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * _powers(BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(BASE_INV, n)[starts])


def rows_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each byte position lies in (empty rows hold none)."""
    return np.searchsorted(offsets, positions, "right") - 1


def hashed_words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased text: (hashes, rows, starts, ends)."""
    starts, ends = spans(member[data], offsets)
    return span_hashes(LOWER[data], starts, ends), rows_of(starts, offsets), starts, ends


def ngram_hashes(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions of first words) of the n-word shingles that stay within a row."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:m].copy()
    for k in range(1, n):
        out = out * np.uint64(BASE) + h[k : k + m]
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix(out[at]), at


def distinct_in_rows(rows: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of rows 0..n-1, row by row, and the rows' offsets into them."""
    bits = np.uint64(max(1, n.bit_length()))
    order = np.argsort((rows.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits))
    r, v = rows[order], h[order]
    if len(v):
        keep = np.concatenate(([True], (v[1:] != v[:-1]) | (r[1:] != r[:-1])))
        r, v = r[keep], v[keep]
    return v, np.searchsorted(r, np.arange(n + 1))


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of rows 0..n in the sorted array ``rows``."""
    return np.searchsorted(rows, np.arange(n + 1))
