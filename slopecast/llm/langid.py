"""Language identification by cross-parsing entropy.

Each language is a suffix automaton of labelled text. A text is parsed against it greedily: the
longest stretch that occurs anywhere in the language's sample is one phrase, then the next
begins. A text in that language falls into few long phrases. Phrases are priced at the log of
the sample's length (the cost of pointing into it) and divided by the text's length, which
estimates the cross entropy; the language with the smallest estimate wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from .kernel import raw_text
from .sampling import smallest_hashes

SAMPLE_DOCS = 160  # labelled documents per language that the automaton is made of, chosen by hash
SAMPLE_CHARS = 200  # characters of each, from a place chosen by hash
BLOCK = 512  # a phrase also ends at each multiple of so many characters, so that blocks are parsed side by side
CHUNK_CHARS = 1 << 20
LETTERS = 120  # letters of one code, the most frequent of all samples; the others are spelt with two
UNKNOWN = "und"

Model = tuple[tuple[str, tuple[str, ...]], ...]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """Samples per language: at most ``docs`` stretches of at most ``chars`` characters each.

    That bound is all that reaches the driver. Rows with a null text or language are not used.
    """
    named = labelled.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    picked = smallest_hashes(named, "text", docs, ["lang"])
    room = F.greatest(F.lit(1), F.char_length("text") - chars + 1)
    part = F.substring(F.col("text"), (F.col("key") % room + 1).cast("int"), F.lit(chars))
    found: dict[str, list[str]] = {}
    for r in picked.select("lang", part.alias("part")).collect():
        found.setdefault(r["lang"], []).append(r["part"])
    return tuple((k, tuple(sorted(v))) for k, v in sorted(found.items()))


def suffix_automaton(codes: Iterable[int], width: int) -> np.ndarray:
    """Transitions [state, code] of the automaton of all substrings; 0 (the start) means none."""
    nxt: list[list[int]] = [[0] * width]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append([0] * width)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and not nxt[p][c]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q][:])
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p][c] == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return np.array(nxt, np.int32)


class Parser:
    """All languages' automata in one table."""

    def __init__(self, model: Model):
        counts: dict[str, int] = {}
        for _, parts in model:
            for ch in "".join(parts).lower():
                if ch.isalpha():
                    counts[ch] = counts.get(ch, 0) + 1
        known = sorted(sorted(counts), key=lambda c: -counts[c])
        known, rare = known[:LETTERS], sorted(known[LETTERS:])
        # 0: other characters, runs of which count once; 1..n: letters; n+1: letters of no sample; n+2: the gap between
        # samples; then as many first codes, and as many second ones, as tell the rare letters apart
        code_of = {c: i + 1 for i, c in enumerate(sorted(known))}
        self.other, self.gap = len(code_of) + 1, len(code_of) + 2
        side = math.isqrt(max(0, len(rare) - 1)) + 1 if rare else 0
        self.width = self.gap + 1 + 2 * side
        self.codes, self.second = np.zeros(0x110000, np.uint16), np.zeros(0x110000, np.uint16)
        self.codes[[i for i in range(0x110000) if chr(i).isalpha()]] = self.other
        for c, k in code_of.items():
            self.codes[ord(c)] = k
            if len(c.upper()) == 1:
                self.codes[ord(c.upper())] = k
        for i, c in enumerate(rare):
            for x in {c, c.upper()}:
                if len(x) == 1:
                    self.codes[ord(x)], self.second[ord(x)] = self.gap + 1 + i // side, self.gap + 1 + side + i % side
        self.names = [k for k, _ in model]
        tables, self.price, base, self.bases = [], [], 0, []
        for _, parts in model:
            seq: list[int] = []
            for p in parts:
                seq += [*self.fold(np.array([ord(c) for c in p], np.uint32)).tolist(), self.gap]
            t = suffix_automaton(seq, self.width)
            tables.append(np.where(t > 0, t + base, 0).astype(np.int32))
            self.bases.append(base)
            base += len(t)
            self.price.append(float(np.log2(max(2, len(seq)))))
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(self.width, np.int32)
        self.roots = np.array([t[0] for t in tables], np.int32).reshape(-1, self.width)

    def spell(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of code points, and the offsets into them."""
        c, second = self.codes[points], self.second[points]
        two = second > 0
        if not two.any():
            return c, offsets
        added = np.concatenate(([0], np.cumsum(two)))
        at = np.arange(len(c)) + added[:-1]
        out = np.empty(len(c) + added[-1], np.uint16)
        out[at], out[at[two] + 1] = c, second[two]
        return out, offsets + added[offsets]

    def fold(self, points: np.ndarray) -> np.ndarray:
        c, _ = self.spell(points, np.zeros(1, np.int64))
        return c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))] if len(c) else c

    def phrases(self, blocks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases [language, block]; ``blocks`` is [position, block], longest block first."""
        n, w = len(self.names), self.width
        state = np.zeros((n, blocks.shape[1]), np.int32)
        count = np.zeros((n, blocks.shape[1]), np.int32)
        live = np.searchsorted(-lengths, -np.arange(blocks.shape[0]), "left")  # blocks longer than each position
        for t in range(blocks.shape[0]):
            m = live[t]
            c = blocks[t, :m]
            s = state[:, :m]
            go = self.table[s * w + c]
            stop = (s == 0) | (go == 0)
            count[:, :m] += stop
            state[:, :m] = np.where(stop, self.roots[:, c], go)
        return count


@lru_cache(maxsize=4)
def parser(model: Model) -> Parser:
    return Parser(model)


def _judge(p: Parser, points: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[float], list[int]]:
    """(language, score, phrases) of each text, given as code points and offsets."""
    n = len(offsets) - 1
    c, offsets = p.spell(points, offsets)
    keep = np.ones(len(c), bool)
    if len(c):
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        keep[offsets[:-1][offsets[:-1] < len(c)]] = True
    at = np.concatenate(([0], np.cumsum(keep)))[offsets]
    seq, letters = c[keep], np.concatenate(([0], np.cumsum(c[keep] > 0)))
    has = letters[at[1:]] > letters[at[:-1]]
    size = np.where(has, np.diff(at), 0)
    per = -(-size // BLOCK)
    row = np.repeat(np.arange(n), per)
    start = at[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * BLOCK
    length = np.minimum(BLOCK, at[:-1][row] + size[row] - start)
    order = np.argsort(-length, kind="stable")
    row, start, length = row[order], start[order], length[order]
    total = np.zeros((len(p.names), n))
    if len(row):
        steps = np.arange(length[0])[:, None]
        blocks = np.append(seq, 0)[np.minimum(start[None, :] + steps, len(seq))]
        got = p.phrases(blocks, length)
        for k in range(len(p.names)):
            total[k] = np.bincount(row, got[k], n)
    langs, scores, counts = [], [], []
    price = np.array(p.price)[:, None]
    cost = total * price / np.maximum(size, 1) if len(p.names) else total
    for i in range(n):
        if not has[i] or not p.names:
            langs.append(UNKNOWN), scores.append(0.0), counts.append(0)
            continue
        best = int(np.argmin(cost[:, i]))
        rest = np.delete(cost[:, i], best)
        langs.append(p.names[best])
        scores.append(float(1 - cost[best, i] / rest.min()) if len(rest) else 1.0)
        counts.append(int(total[best, i]))
    return langs, scores, counts


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``lang_pred``, ``score`` and ``n_phrases`` (under the winner).

    ``score`` is the relative lead over the runner-up, 0 to 1; with one language it is 1. Ties
    go to the first name in order. A null text, one without letters, and any text under an empty
    model are ``und`` with score 0. Whole texts are read, in blocks of ``BLOCK`` characters.
    Repeated rows are judged alike; columns named like the three new ones are replaced.
    """
    new = ("lang_pred", "score", "n_phrases")
    rest = [c for c in docs.columns if c != text and c not in new]
    kinds = (T.StringType(), T.DoubleType(), T.LongType())
    out = T.StructType([*docs.select(*rest).schema.fields, *[T.StructField(c, k) for c, k in zip(new, kinds, strict=True)]])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most SAMPLE_DOCS * SAMPLE_CHARS per language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(shared.value)
        for b in batches:
            langs, scores, counts = [], [], []
            data, off = raw_text(b.column(len(rest)))
            i = 0
            while i < len(off) - 1:
                j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_CHARS, "right")) - 1)
                raw = data[off[i] : off[j]]
                # a character starts at each byte that does not continue one
                chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[off[i : j + 1] - off[i]]
                points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
                for a, x in zip((langs, scores, counts), _judge(p, points, chars), strict=True):
                    a += x
                i = j
            cols = [b.column(k) for k in range(len(rest))] + [pa.array(langs, pa.string()), pa.array(scores), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*rest, *new])

    return docs.select(*rest, text).mapInArrow(run, out)
