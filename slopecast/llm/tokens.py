"""Token ids of whole texts, by the ``tokenizers`` library with a memory of pieces.

Both kinds of byte-level vocabulary cut a text into short pieces (a word, a number, a run of
marks) before they merge bytes, so the ids of a text are the ids of its pieces in a row. NumPy
cuts plain Latin text into those pieces, a new piece goes to the library's model once, and a
known one is looked up by a 64-bit hash. Texts with other characters are cut only at white
space, where that is safe, and their words go through the whole library; a text with unusual
white space goes to it in one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .kernel import byte_table, rows_of, span_hashes, text_chunks

MAX_PIECES = 250_000  # remembered per Python worker; later new pieces are encoded each time
# fixed values: the printable stand-ins of bytes in byte-level vocabularies
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARS = np.arange(256, dtype="<u2")
BYTE_CHARS[[b for b in range(256) if b not in _SHOWN]] = 256 + np.arange(256 - len(_SHOWN))

_PLAIN = byte_table(b" \n")
_CONTROL_SPACE = byte_table(b"\x09\x0b\x0c\x0d\x1c\x1d\x1e\x1f")
SPACE, LETTER, DIGIT, MARK = range(4)
_KIND = np.full(256, MARK, np.uint8)
_KIND[list(b"\x09\x0a\x0b\x0c\x0d\x20")] = SPACE
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[ord("A") : ord("Z") + 1] = _KIND[ord("a") : ord("z") + 1] = _KIND[0x80:] = LETTER
_WHOLE_WORD = np.uint64(0xA5A5A5A5A5A5A5A5)  # keeps hashes of words apart from those of pieces


def _flagged(at: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[rows_of(np.flatnonzero(at), offsets)] = True
    return out


def _odd_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of other white space than single spaces and line ends between two other characters."""
    n = len(data)
    space = _PLAIN[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    odd = _CONTROL_SPACE[data] | (space & (edge[:n] | edge[1:]))
    odd[1:] |= space[1:] & space[:-1]
    if (data >= 0xC2).any():
        a, b, c = data, np.append(data[1:], 0), np.append(data[2:], [0, 0])[:n]
        odd |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        odd |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        odd |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8F) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        odd |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        odd |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return odd


def _not_latin(data: np.ndarray) -> np.ndarray:
    """Bytes of characters that are neither ASCII nor a Latin letter of two bytes, and of special tokens' starts."""
    n = len(data)
    after, before = np.append(data[1:], 0), np.append([0], data[:-1])
    letter = (data == 0xC3) & (after != 0x97) & (after != 0xB7)
    tail = (data >= 0x80) & (data < 0xC0) & (before == 0xC3)
    return ((data >= 0x80) & ~letter & ~tail) | ((data == ord("<")) & (after == ord("|"))) | ((data >= 0x1C) & (data <= 0x1F)) if n else np.zeros(0, bool)


class Encoder:
    """Ids of texts; keep one per Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # byte-level pieces keep the space before a word; the other kind lower-cases and drops all white space
        self.keeps_space = spec["pre_tokenizer"]["type"] == "ByteLevel"
        self.known: dict[int, int] = {}
        self.pool = np.zeros(1 << 19, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.n = self.used = 0

    def _add(self, ids: list[list[int]]) -> int:
        """Append entries to the pool; the index of the first."""
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        first, total = self.n, int(lens.sum())
        while self.n + len(ids) > len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length))
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.start[first : first + len(ids)] = self.used + np.cumsum(lens) - lens
        self.length[first : first + len(ids)] = lens
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.n, self.used = first + len(ids), self.used + total
        return first

    def _lower(self, data: np.ndarray) -> np.ndarray:
        """Lower case of ASCII and two-byte Latin letters."""
        upper = (data >= ord("A")) & (data <= ord("Z"))
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        return data + (upper.astype(np.uint8) << 5)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces (and runs of white space) of Latin text begin."""
        n = len(data)
        kind = _KIND[data]
        cut = np.ones(n + 1, bool)
        cut[1:n] = kind[1:] != kind[:-1]
        if not self.keeps_space:
            cut[:n] |= kind == DIGIT  # one digit a piece
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        for i in np.flatnonzero(data == ord("'")):  # a contraction is a piece where the apostrophe begins one
            before = SPACE if edge[i] else kind[i - 1]
            if before == MARK or (before == SPACE and self.keeps_space and not edge[i] and data[i - 1] == 32):
                continue
            near = bytes(data[i + 1 : i + 3]).decode("latin-1")
            size = 2 if near[:1] in ("s", "t", "m", "d") and near else 3 if near in ("re", "ve", "ll") else 0
            if size and not edge[i + 1 : i + size].any():
                cut[i + 1 : i + size] = False
                cut[i] = cut[i + size] = True
        if self.keeps_space:
            # a single space belongs to what follows it; a line end stands alone
            after_space = np.flatnonzero(data[:-1] == 32) + 1
            cut[after_space] = False
            cut[after_space - 1] = True
        cut[offsets] = True
        return cut

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, whether a span is a piece) of all spans with ids."""
        n, rows = len(data), len(offsets) - 1
        other = _flagged(_not_latin(data), offsets, rows)
        odd = _flagged(_odd_space(data, offsets), offsets, rows) if self.keeps_space else np.zeros(rows, bool)
        size = np.diff(offsets)
        latin = np.repeat(~other & ~odd, size)
        cut = self._pieces(data, offsets)
        words = np.zeros(n + 1, bool)
        words[:n] = _PLAIN[data]
        words[1:] |= data == 10 if self.keeps_space else _PLAIN[data]
        words[:n] &= ~np.repeat(odd, size)
        cut[:n] = np.where(latin, cut[:n], words[:n])
        cut[offsets] = True
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n)
        if not self.keeps_space:
            full = np.where(latin[starts], _KIND[data[starts]] != SPACE, ~_PLAIN[data[starts]])
            starts, ends = starts[full], ends[full]
        return starts, ends, latin[starts]

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the rows, offsets of the rows' ids)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends, piece = self._cut(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        folded = data if self.keeps_space else self._lower(data)
        h = np.where(piece, span_hashes(folded, starts, ends), span_hashes(data, starts, ends) ^ _WHOLE_WORD)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        get = self.known.get
        keys = distinct.tolist()
        at = np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        kept, kept_used = self.n, self.used
        if len(new):
            shown, raw = BYTE_CHARS[folded].tobytes().decode("utf-16-le"), data.tobytes()
            model, encode, ids = self.tok.model.tokenize, self.tok.encode, []
            s, e, p = starts[first[new]].tolist(), ends[first[new]].tolist(), piece[first[new]].tolist()
            for a, b, is_piece in zip(s, e, p, strict=True):
                if is_piece:
                    ids.append([t.id for t in model(shown[a:b])])
                else:
                    ids.append(encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids)
            at[new] = self._add(ids) + np.arange(len(new))
        where, lens = self.start[at][inverse], self.length[at][inverse]
        done = np.cumsum(lens)
        out = self.pool[np.repeat(where - (done - lens), lens) + np.arange(int(done[-1]))]
        row_off = np.concatenate(([0], done))[np.searchsorted(starts, offsets)]
        if len(new):
            short = new[(ends - starts)[first[new]] <= 64][: max(0, MAX_PIECES - kept)] if kept < MAX_PIECES else new[:0]
            if len(short) == len(new):
                self.known.update(zip(distinct[new].tolist(), at[new].tolist(), strict=True))
            elif len(short):
                self.n, self.used = kept, kept_used
                place = self._add([ids[i] for i in np.searchsorted(new, short)])
                self.known.update(zip(distinct[short].tolist(), range(place, place + len(short)), strict=True))
            else:
                self.n, self.used = kept, kept_used
        return out, row_off

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of every row in order; a null text has none."""
        for i, j, data, off in text_chunks(texts):
            ids, at = self.encode_chunk(data, off)
            for k in range(j - i):
                yield i + k, ids[at[k] : at[k + 1]]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
