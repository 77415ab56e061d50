"""Orders of many short texts by MD5, worked out on whole columns."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFT = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ONE_BLOCK = 55  # bytes of a message that MD5 takes in one go


def _md5(words: Sequence[np.ndarray | int], n: int) -> list[np.ndarray]:
    """The four words of the MD5 of ``n`` messages of one block; a word that all messages share is a number."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            g = 7 * i % 16
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        np.add(t, a, out=t)
        w = words[g]
        if isinstance(w, int):
            np.add(t, np.uint32((w + _K[i]) & 0xFFFFFFFF), out=t)
        else:
            np.add(t, w, out=t)
            np.add(t, np.uint32(_K[i]), out=t)
        s = _SHIFT[i // 16][i % 4]
        np.left_shift(t, np.uint32(s), out=u)
        np.right_shift(t, np.uint32(32 - s), out=t)
        np.bitwise_or(t, u, out=t)
        np.add(t, b, out=a)  # what was a is not needed again
        a, b, c, d = d, a, b, c
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), _START, strict=True)]


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Eight bytes of a digest as one number that sorts as they do."""
    return (first.byteswap().astype(np.uint64) << np.uint64(32)) | second.byteswap()


class Digests:
    """Texts (``data`` and the ``off``sets between them) that are ordered by the MD5 of themselves and an ending.

    Texts of one length share their layout: only the words that hold their own bytes are columns. Longer ones than
    fit a block of MD5 are hashed one by one, ``chunk`` at a time.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, chunk: int):
        self.data, self.off, self.chunk, self.rows = data, off.astype(np.int64), chunk, len(off) - 1
        sizes = np.diff(self.off)
        self.groups = []
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            whole = None if len(rows) == self.rows else rows
            if size > _ONE_BLOCK:
                self.groups.append((size, rows, whole, None))
                continue
            columns = np.zeros((-(-size // 4), len(rows)), "<u4")
            places = columns.view(np.uint8).reshape(len(columns), len(rows), 4)
            for k in range(size):
                places[k // 4, :, k % 4] = data[self.off[rows] + k]
            self.groups.append((size, rows, whole, columns))

    @classmethod
    def of(cls, texts: Sequence[bytes], chunk: int) -> Digests:
        return cls(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), chunk)

    def _digests(self, size: int, rows: np.ndarray, columns: np.ndarray | None, tail: bytes) -> tuple[np.ndarray, np.ndarray]:
        """High and low half of the digests of some texts of one length; ``columns``: their words."""
        if columns is None or size + len(tail) > _ONE_BLOCK:
            at = self.off[rows].tolist()
            raw = b"".join([hashlib.md5(self.data[i : i + size].tobytes() + tail).digest() for i in at])
            both = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)
            return both[:, 0], both[:, 1]
        end = bytearray(64)
        end[size : size + len(tail) + 1] = tail + b"\x80"
        end[56:] = (8 * (size + len(tail))).to_bytes(8, "little")
        fixed = np.frombuffer(bytes(end), "<u4").tolist()
        words: list[np.ndarray | int] = [columns[k] | np.uint32(w) if k < len(columns) else w for k, w in enumerate(fixed)]
        a, b, c, d = _md5(words, len(rows))
        return _pair(a, b), _pair(c, d)

    def order(self, tail: bytes) -> np.ndarray:
        """Positions of the texts by the MD5 of text and ``tail``, equal ones as they stand.

        The first bits of a digest are sorted together with the position; what they do not tell apart is ordered by whole digests.
        """
        bits = np.uint64(max(1, (self.rows - 1).bit_length()))
        mask = (np.uint64(1) << bits) - np.uint64(1)
        keys = np.arange(self.rows, dtype=np.uint64)
        for size, rows, whole, columns in self.groups:
            for k in range(0, len(rows), self.chunk):
                some = slice(k, k + self.chunk)
                high, _ = self._digests(size, rows[some], None if columns is None else columns[:, some], tail)
                at = some if whole is None else rows[some]
                keys[at] |= high & ~mask
        keys.sort()
        first = keys >> bits
        same = first[1:] == first[:-1]
        keys &= mask
        out = keys.view(np.int64)
        if same.any():
            tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
            out[tied] = self._by_whole(out[tied], tail)
        return out

    def _by_whole(self, positions: np.ndarray, tail: bytes) -> np.ndarray:
        found = np.sort(positions)
        high, low = np.empty(len(found), np.uint64), np.empty(len(found), np.uint64)
        for size, rows, _, columns in self.groups:
            mine = np.flatnonzero(np.isin(found, rows, assume_unique=True))
            for k in range(0, len(mine), self.chunk):
                some = mine[k : k + self.chunk]
                at = np.searchsorted(rows, found[some])
                high[some], low[some] = self._digests(size, rows[at], None if columns is None else columns[:, at], tail)
        return found[np.lexsort((low, high))]
