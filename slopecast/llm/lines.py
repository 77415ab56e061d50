"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity in the corpus; two lines as similar
as asked share a word within their prefixes, the rarest few words of each. Prefix words meet in
an equi-join. Length and positional filters discard pairs that cannot reach the similarity, and
so does a 128-bit parity sketch: every word in only one of two sets flips one bit, so sketches
cannot differ in more bits than the sets may differ in words. What is left is verified on the
full sets. Of two similar lines the later one (by document id, then line number) is removed.

Equal lines are one class before they are joined. A prefix word with more than ``CROWD`` classes
is not expanded into pairs at once: they first meet the earliest of them alone, and only those
that this does not settle meet all others. Lines of so few words that none but an equal set is
similar enough (up to three words at 0.8) are settled by their class.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release, reused
from .kernel import LOWER, NOT_SPACE, distinct_in_rows, mix, rows_of, span_hashes, spans, text_chunks

MIN_WORDS = 1  # lines of fewer distinct words are never compared nor removed: none but lines without a word
PERCENT = 80
COUNT_BITS = 20  # word counts are kept in 2**COUNT_BITS hash places, whatever the vocabulary
SEGMENTS = 64
CROWD = 1000  # classes under one prefix word that meet each other directly
SIEVE_BITS = 23

LINES = "doc_id long, line int, size int, d1 long, d2 long"


def line_sets(data: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of at least ``least`` distinct words: (row, line number in it, word hashes, offsets of the lines into them)."""
    feeds = np.flatnonzero(data == 10)
    starts, ends = spans(NOT_SPACE[data], off)
    h = span_hashes(LOWER[data], starts, ends)
    row = rows_of(starts, off)
    line = np.searchsorted(feeds, starts) - np.searchsorted(feeds, off)[row]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    no = np.cumsum(new) - 1
    count = int(no[-1]) + 1 if len(no) else 0
    keys, at = distinct_in_rows(no, h, count)
    size = np.diff(at)
    long = np.flatnonzero(size >= least)
    first = np.flatnonzero(new)
    keep = np.repeat(size >= least, size)
    return row[first[long]], line[first[long]], keys[keep], np.concatenate(([0], np.cumsum(size[long])))


def _digests(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(at) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.add.reduceat(mix(words), at[:-1]), np.add.reduceat(mix(words ^ np.uint64(0x9E3779B9)), at[:-1])


def _scan(docs: DataFrame, doc_id: str, text: str, least: int) -> tuple[DataFrame, bytes]:
    """All lines with a digest of their word sets, and the counts of words, in one pass over the text."""
    schema = f"kind int, {LINES}, segment int, counts binary"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.uint32)
        for b in batches:
            for i, _, data, off in text_chunks(b.column(1)):
                row, line, words, at = line_sets(data, off, least)
                counts += np.bincount((words >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS).astype(np.uint32)
                d1, d2 = _digests(words, at)
                n = len(row)
                cols = [
                    pa.array(np.zeros(n, np.int32)), b.column(0).take(pa.array(row + i)), pa.array(line.astype(np.int32)), pa.array(np.diff(at).astype(np.int32)),
                    pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        parts = [p.tobytes() for p in np.split(counts, SEGMENTS)]
        cols = [pa.array([1] * SEGMENTS, kinds[0]), *[pa.nulls(SEGMENTS, k) for k in kinds[1:6]], pa.array(range(SEGMENTS), kinds[6]), pa.array(parts, kinds[7])]
        yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    both = reused(rows.mapInArrow(run, schema), "lines")

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[s] = total.get(s, 0) + np.frombuffer(c, np.uint32).astype(np.uint64)
        out = [np.minimum(v, 0xFFFFFFFF).astype(np.uint32).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(out, pa.binary())], names=["segment", "counts"])

    parts = both.where("kind = 1").select("segment", "counts").repartition("segment").mapInArrow(add, "segment int, counts binary").collect()
    counts = b"".join(bytes(r["counts"]) for r in sorted(parts, key=lambda r: r["segment"]))  # 2**COUNT_BITS numbers, 4 MB
    return both.where("kind = 0").select(*[c.split()[0] for c in LINES.split(", ")]), counts or bytes(4 << COUNT_BITS)


CLASS = ("d1", "size")


def _prefixes(docs: DataFrame, doc_id: str, text: str, counts: bytes, least: int, percent: int, crowded: bool) -> DataFrame:
    """(word, d1, size, at, s1, s2, doc, shown): prefix words of every class of equal lines.

    ``doc`` is a document that the class stands in, ``shown`` its crowded prefix words in order. A word whose count (of its hash place, so
    never too low) is over ``CROWD`` is crowded; the others have at most that many classes. One
    shuffle, by word; copies of a line within a batch are left out before it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(shared.value, np.uint32)
        for b in batches:
            for i, _, data, off in text_chunks(b.column(1)):
                row, _, words, at = line_sets(data, off, least)
                size = np.diff(at)
                if not len(size):
                    continue
                d1, _ = _digests(words, at)
                bit, half = np.uint64(1) << (words & np.uint64(63)), (words & np.uint64(64)) > 0
                s1, s2 = (np.bitwise_xor.reduceat(np.where(half == h, bit, np.uint64(0)), at[:-1]) for h in (False, True))
                once = np.zeros(len(size), bool)
                once[np.unique(d1, return_index=True)[1]] = True
                no = np.repeat(np.arange(len(size)), size)
                n = often[(words >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                order = np.lexsort((words, n, no))
                place = np.arange(len(words)) - np.repeat(at[:-1], size)
                near = size * 100 >= (size + 1) * percent  # shorter lines are similar to equal ones alone, their own class
                prefix = np.where(once & near, size - -(-size * percent // 100) + 1, 0)
                keep = np.flatnonzero((place < prefix[no]) & ((n[order] > CROWD) == crowded))
                x = no[keep]
                short = (words[order][keep] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                first, count = np.searchsorted(x, x), np.bincount(x, minlength=len(size))[x] if crowded else np.zeros(len(x), np.int64)
                ends = np.concatenate(([0], np.cumsum(count)))
                shown = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(short[np.repeat(first - ends[:-1], count) + np.arange(ends[-1])]))
                cols = [
                    pa.array(short), pa.array(d1[x].view(np.int64)), pa.array(size[x].astype(np.int32)),
                    pa.array(place[keep].astype(np.int32)), pa.array(s1[x].view(np.int64)), pa.array(s2[x].view(np.int64)), b.column(0).take(pa.array(row[x] + i)), shown,
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["word", "d1", "size", "at", "s1", "s2", "doc", "shown"])

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, "word int, d1 long, size int, at int, s1 long, s2 long, doc long, shown array<int>")
    kept = ["size", "at", "s1", "s2"]
    if crowded:
        return found.groupBy("word", "d1", *kept).agg(F.min("doc").alias("doc"), F.first("shown").alias("shown"))
    return found.drop("doc", "shown").repartition("word").groupBy("word", "d1", "at").agg(*[F.first(c).alias(c) for c in ("size", "s1", "s2")])


def _wanted_sets(docs: DataFrame, pairs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """(doc_id, line, words) of the lines in ``pairs``; a bitmap of fixed size spares other documents the work."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a_doc").alias("doc_id"), F.col("a_line").alias("line")), F.struct(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line")))).alias("e")).select("e.*").distinct()
    ends = reused(ends, "line-ends")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - SIEVE_BITS)
    words = ends.select("doc_id").distinct().select(F.shiftrightunsigned(place, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
    sieve = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    for r in words.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():  # at most 2**SIEVE_BITS / 64 rows
        sieve[r["at"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    shared = docs.sparkSession.sparkContext.broadcast(sieve.tobytes())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            p = b.column(2).to_numpy()
            hit = pa.array(np.flatnonzero((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1))
            b = b.take(hit)
            for i, _, data, off in text_chunks(b.column(1)):
                row, line, words, at = line_sets(data, off, least)
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(words.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + i)), pa.array(line.astype(np.int32)), sets], names=["doc_id", "line", "words"])

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("place", place)
    found = rows.select("doc_id", "text", "place").mapInArrow(run, "doc_id long, line int, words array<long>")
    return found.join(ends, ["doc_id", "line"], "left_semi").dropDuplicates(["doc_id", "line"])


def _verified(docs: DataFrame, pairs: DataFrame, doc_id: str, text: str, least: int, percent: int) -> DataFrame:
    """Later lines (doc_id, line) of the pairs whose full sets are similar enough."""
    sets = reused(_wanted_sets(docs, pairs, doc_id, text, least), "line-sets")
    a = sets.select(F.col("doc_id").alias("a_doc"), F.col("line").alias("a_line"), F.col("words").alias("a_words"))
    b = sets.select(F.col("doc_id").alias("b_doc"), F.col("line").alias("b_line"), F.col("words").alias("b_words"))
    both = pairs.join(a, ["a_doc", "a_line"]).join(b, ["b_doc", "b_line"])
    common = F.size(F.array_intersect("a_words", "b_words"))
    similar = common * 100 >= (F.size("a_words") + F.size("b_words") - common) * percent
    out = reused(both.where(similar).select(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line")).distinct(), "near-lines")
    release(sets)
    return out


def _can_match(percent: int) -> Column:
    """Length, positional and sketch filters on two classes under one word."""
    x, y = F.col("a_size"), F.col("b_size")
    shared = F.ceil((x + y) * percent / (100 + percent))
    most = F.least("a_at", "b_at") + 1 + F.least(x - F.col("a_at") - 1, y - F.col("b_at") - 1)
    apart = sum(F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in ("s1", "s2"))
    return (F.least(x, y) * 100 >= F.greatest(x, y) * percent) & (most >= shared) & (apart <= x + y - 2 * shared)


def _meet(a: DataFrame, b: DataFrame, percent: int, each_once: bool = False, once_shown: bool = False) -> DataFrame:
    """Pairs of classes (a_d1, a_size, b_d1, b_size) under one word that pass the filters.

    With ``once_shown`` a pair comes only under the first crowded word that both show.
    """
    shown = ["shown"] if once_shown else []
    a, b = (x.select("word", *[F.col(c).alias(f"{t}_{c}") for c in ("d1", "size", "at", "s1", "s2", *shown)]) for x, t in ((a, "a"), (b, "b")))
    apart = F.col("a_d1") < F.col("b_d1") if each_once else F.col("a_d1") != F.col("b_d1")
    here = F.get(F.array_intersect("a_shown", "b_shown"), F.lit(0)) == a["word"] if shown else F.lit(True)
    return a.join(b, (a["word"] == b["word"]) & apart & _can_match(percent) & here).select("a_d1", "a_size", "b_d1", "b_size").distinct()


def _placed(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """Pairs of classes as pairs of their first lines, the earlier one as ``a``."""
    for t in "ab":
        side = first.select(F.col("d1").alias(f"{t}_d1"), F.col("size").alias(f"{t}_size"), F.struct("f_doc", "f_line").alias(t))
        pairs = pairs.join(side, [f"{t}_d1", f"{t}_size"])
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ordered.select(*[F.col(f"{t}.f_{c}").alias(f"{t}_{c}") for t in "ab" for c in ("doc", "line")]).distinct()


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, line): lines for which an earlier line with similarity ``percent`` / 100 or more exists."""
    lines, counts = _scan(docs, doc_id, text, least)
    first = lines.groupBy("d1", "d2", "size").agg(F.min(F.struct("doc_id", "line")).alias("f"))
    first = reused(first.select("d1", "d2", "size", F.col("f.doc_id").alias("f_doc"), F.col("f.line").alias("f_line")), "first-lines")
    later = lines.join(first, ["d1", "d2", "size"]).where((F.col("doc_id") != F.col("f_doc")) | (F.col("line") != F.col("f_line"))).select("doc_id", "line")
    calm = _prefixes(docs, doc_id, text, counts, least, percent, crowded=False)
    pairs = reused(_meet(calm, calm, percent, each_once=True), "line-classes")
    crowded = reused(_prefixes(docs, doc_id, text, counts, least, percent, crowded=True), "crowded-words")
    pivots = crowded.groupBy("word").agg(F.min_by(F.struct("d1", "size", "at", "s1", "s2"), "doc").alias("p")).select("word", "p.*")
    star = reused(_meet(pivots, crowded, percent), "line-stars")
    gone = _verified(docs, reused(_placed(pairs.unionByName(star), first), "line-pairs"), doc_id, text, least, percent)
    release(pairs, star)
    settled = first.join(gone.toDF("f_doc", "f_line"), ["f_doc", "f_line"], "left_semi").select(*CLASS).distinct()
    rest = _meet(crowded, crowded.join(settled, list(CLASS), "left_anti"), percent, once_shown=True)
    more = _verified(docs, reused(_placed(rest, first), "line-pairs"), doc_id, text, least, percent)
    release(crowded)
    return later.unionByName(gone).unionByName(more).distinct()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines``, ``n_removed``, ``removed`` (their numbers, from 0).

    Lines are separated by line feeds and words by ASCII white space; words are lower-cased in
    A-Z. Lines with fewer than ``least`` distinct words always stay: by default lines without
    a word, so that short lines lose their copies like any others. A text without removals is
    returned as it was, null or empty included; a document may become empty. A document id names
    one text: repeated rows lose the same lines. Documents with a null id are neither compared
    nor changed. Columns named like the three new ones are replaced; an empty table stays empty.
    """
    base = docs.drop("n_lines", "n_removed", "removed")
    gone = repeated_lines(base, doc_id, text, least, percent).groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    out = base.join(gone.withColumnRenamed("doc_id", "_id"), F.col(doc_id) == F.col("_id"), "left").drop("_id")
    parts = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("removed", i)), "\n")
    none = F.array().cast("array<int>")
    return out.withColumns(
        {
            "n_lines": F.coalesce(F.size(parts), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size("removed"), F.lit(0)).cast("long"),
            text: F.when(F.col("removed").isNull(), F.col(text)).otherwise(kept),
            "removed": F.coalesce("removed", none),
        }
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "removed", "text", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
