"""Spelling variants of the words of a corpus, found with PartEnum signatures.

A word's letters form a multiset, a binary vector with one place per letter and occurrence (the
first a, the second a, ...). One inserted, deleted or replaced letter changes at most two places.
PartEnum deals the places out to ``PARTS`` parts by hash: vectors at a Hamming distance of two
differ in at most two parts, so leaving out each pair of parts in turn and signing the rest gives
two such words an equal signature at least once. Words meet in an equi-join on signatures, and
what meets is verified by its edit distance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release, reused
from .kernel import LOWER, byte_table, mix, rows_of, span_hashes, spans, text_chunks

LEAST_LETTERS = 6  # code points of a word
LEAST_COUNT = 5  # occurrences of a word in the corpus
RATIO = 5  # how much more often a form must occur than its variant
DAMAGE = 199  # runs whose hash this divides lose a letter
PARTS = 8
HELD_WORDS = 1 << 18  # distinct words that a task counts before it emits them

_ASCII_LETTER = byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_C3 = 0xC3  # the first byte of the code points 00C0 to 00FF
_NEAR = 1 << 16  # bytes up to which CRCs are combined from tables; longer runs are hashed in one


def _crc_step() -> np.ndarray:
    """What a zero byte turns each low byte of a CRC-32 into."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_STEP = _crc_step()


def _word_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes of letters A-Z, a-z and U+00C0 to U+00FF."""
    first = data == _C3
    member = _ASCII_LETTER[data] | first
    member[1:] |= first[:-1]
    return member


def _prefixed(crcs: np.ndarray, sizes: np.ndarray, rows: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """CRC-32 of prefix + word from the CRC-32 of both: the prefix's is carried over the word's bytes."""
    out = np.empty(len(rows), np.uint32)
    order = np.argsort(sizes, kind="stable")
    carried, done = prefix.copy(), 0
    lens = sizes[order]
    for n in np.unique(lens):
        while done < n:
            carried = _STEP[carried & 0xFF] ^ (carried >> np.uint32(8))
            done += 1
        mine = order[np.searchsorted(lens, n) : np.searchsorted(lens, n, "right")]
        out[mine] = carried[rows[mine]]
    return out ^ crcs


class _Counter:
    """Counts of words by 64-bit hash, with bounded memory."""

    def __init__(self):
        self.count: dict[int, int] = {}
        self.word: dict[int, bytes] = {}

    def add(self, keys: list[int], counts: list[int], words: list[bytes]) -> None:
        get = self.count.get
        for k, n, w in zip(keys, counts, words, strict=True):
            have = get(k)
            if have is None:
                self.word[k] = w
            self.count[k] = n + (have or 0)

    def flush(self) -> pa.RecordBatch:
        words = pa.array([self.word[k].decode("utf-8") for k in self.count], pa.string())
        out = pa.RecordBatch.from_arrays([words, pa.array(list(self.count.values()), pa.int64())], names=["word", "n"])
        self.count, self.word = {}, {}
        return out


def _without(word: bytes, k: int) -> bytes:
    s = word.decode("utf-8")
    return (s[:k] + s[k + 1 :]).encode("utf-8")


def count_chunk(ids: list, data: np.ndarray, off: np.ndarray, into: _Counter, least: int, damage: int | None) -> None:
    """Add the words of some whole texts, damaged where their hash says so, to ``into``."""
    starts, ends = spans(_word_bytes(data), off)
    letters = np.concatenate(([0], np.cumsum(data != _C3)))  # a letter's last byte is never C3
    n_letters = letters[ends] - letters[starts]
    long = n_letters >= least
    starts, ends, n_letters = starts[long], ends[long], n_letters[long]
    if not len(starts):
        return
    low = LOWER[data]
    raw = low.tobytes()
    h = span_hashes(low, starts, ends)
    distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    counts = np.bincount(inverse, minlength=len(distinct))
    if damage:
        rows, sizes = rows_of(starts, off), ends - starts
        prefixes = [f"{'' if d is None else d}:".encode() for d in ids]
        crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))[inverse]
        small = sizes <= _NEAR
        hashed = np.empty(len(starts), np.uint32)
        carried = np.fromiter(map(zlib.crc32, prefixes), np.uint32, len(prefixes))
        hashed[small] = _prefixed(crc[small], sizes[small], rows[small], carried)
        for i in np.flatnonzero(~small):
            hashed[i] = zlib.crc32(prefixes[rows[i]] + words[inverse[i]])
        hit = np.flatnonzero(hashed % damage == 0)
        counts -= np.bincount(inverse[hit], minlength=len(distinct))
        hit = hit[n_letters[hit] > least]
        if len(hit):
            at = (hashed[hit] % n_letters[hit]).tolist()
            cut = [_without(words[w], k) for w, k in zip(inverse[hit].tolist(), at, strict=True)]
            ends_of = np.cumsum([len(c) for c in cut])
            joined = np.frombuffer(b"".join(cut), np.uint8)
            keys = span_hashes(joined, ends_of - np.array([len(c) for c in cut]), ends_of)
            into.add(keys.tolist(), [1] * len(cut), cut)
    kept = np.flatnonzero(counts)
    into.add(distinct[kept].tolist(), counts[kept].tolist(), [words[i] for i in kept.tolist()])


def word_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = 1, damage: int | None = None
) -> DataFrame:
    """``word``, ``n``: the maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased.

    Words of fewer than ``least_letters`` code points or ``least_count`` occurrences are left out.
    With ``damage``, a run whose unsigned CRC-32 of ``<doc_id>:<run>`` is divisible by it first
    loses the code point at that hash modulo its length. A null text has no words, a null id is
    written as nothing. Repeated rows count as often as they stand. Tasks count before they emit.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counter()
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, j, data, off in text_chunks(b.column(1)):
                count_chunk(ids[i:j], data, off, held, least_letters, damage)
                if len(held.count) >= HELD_WORDS:
                    yield held.flush()
        yield held.flush()

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def signatures(words: pa.Array, parts: int = PARTS) -> np.ndarray:
    """(words, pairs of parts) array: a hash of the letter multiset outside each pair of parts."""
    texts = words.to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((letters, row))
    row, letters = row[order], letters[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (letters[1:] != letters[:-1])
    nth = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    place = mix((letters << np.uint64(32)) + nth.astype(np.uint64) + np.uint64(1))
    part = (place >> np.uint64(40)).astype(np.int64) % parts
    total = np.zeros((len(texts), parts), np.uint64)
    np.add.at(total, (row, part), mix(place))
    total = mix(total + np.arange(1, parts + 1, dtype=np.uint64))
    every = total.sum(1)
    pairs = list(combinations(range(parts), 2))
    return np.stack([mix(every - total[:, a] - total[:, b] + np.uint64(k)) for k, (a, b) in enumerate(pairs)], 1)


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """``a``, ``b``: all pairs of ``words`` (word; distinct) one inserted, deleted or replaced code point apart, a before b."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = signatures(b.column(0), parts).view(np.int64)
            again = pa.array(np.repeat(np.arange(b.num_rows), sig.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(again), pa.array(sig.ravel())], names=["word", "sig"])

    signed = words.select("word").mapInArrow(run, "word string, sig long")
    a, b = signed.withColumnRenamed("word", "a"), signed.withColumnRenamed("word", "b")
    close = (F.col("a") < F.col("b")) & (F.abs(F.char_length("a") - F.char_length("b")) <= 1)
    # Spark takes the signed words for as few as the words, so it would broadcast 28 rows for each
    met = a.hint("merge").join(b, "sig").where(close & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: forms (word, form) followed to their end, reach doubling each round. All grow with the vocabulary, so none is broadcast."""
    now = reused(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = reused(now.hint("merge").join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        moved = not step.where("moved").isEmpty()
        release(now)
        now = step.drop("moved")
        if not moved:
            return now


def spelling_variants(words: DataFrame, ratio: int = RATIO, parts: int = PARTS) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every row of ``words`` (word, n).

    Two words are near if exactly one inserted, deleted or replaced code point tells them apart.
    The form of a word is its near word of largest ``n`` (of several, the first in code-point
    order) if that is at least ``ratio`` times the word's ``n``, else null; the root is where
    forms lead, the word itself without one. ``n_near`` counts near words. Null words are left
    out, an empty table gives an empty one. Every side of a join grows with the vocabulary, and
    compressed files say little of its size in memory: none is broadcast.
    """
    words = reused(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = reused(near_words(words, parts), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = both.hint("merge").join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = words.hint("merge").join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    enough = F.col("form_n") >= ratio * F.col("n")
    judged = reused(judged.withColumns({"form": F.when(enough, F.col("form")), "form_n": F.when(enough, F.col("form_n"))}), "judged")
    out = judged.hint("merge").join(_roots(judged.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spelling_variants(word_counts(docs, least_count=LEAST_COUNT, damage=DAMAGE))


# CRC-32 from its table: every list_reduce folds a list whose first element is the start value
OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS raw FROM documents),
low AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS k
  FROM runs WHERE length(raw) >= 6 GROUP BY ALL),
bytes AS (SELECT doc_id, r, k, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''),
  lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 + unicode(ch)::BIGINT // 64, 128 + unicode(ch)::BIGINT % 64] END)) AS b FROM low),
hashed AS (SELECT r, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[xor(c % 256, x) + 1], c // 256)), 4294967295) AS h FROM bytes, crc),
damaged AS (SELECT CASE WHEN h % 199 = 0 THEN substring(r, 1, (h % length(r))::INT) || substring(r, (h % length(r))::INT + 2) ELSE r END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cuts AS (SELECT word, n, i, substring(word, 1, i::INT) || substring(word, i::INT + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.cut = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.cut = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM near GROUP BY word),
judged AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
  CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS reached, 0 AS k FROM judged UNION ALL
  SELECT c.word, j.form, c.k + 1 FROM chain c JOIN judged j ON j.word = c.reached AND j.form IS NOT NULL)
SELECT j.word, j.form, c.root, j.n, j.n_near, j.form_n FROM judged j JOIN (SELECT word, arg_max(reached, k) AS root FROM chain GROUP BY word) c ON c.word = j.word
"""
