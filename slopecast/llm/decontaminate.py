"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (an item that is
shorter is one window). A window's set of word shingles is ordered by rarity in the corpus. As
the whole window must be contained, its necessary prefix is one shingle, the rarest. Documents
are searched only for those shingles: a match fixes where the window would have to stand, the
length and positional bounds rule out places beyond the document's ends, and the words
themselves are compared to verify the containment.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reused
from .kernel import LOWER, WORD_BYTES, bounds, hashed_words, ngram_hashes, text_chunks

WINDOW = 10
SHINGLE = 3
SIEVE_BITS = 24  # documents are sieved by a bitmap of 2**SIEVE_BITS hash places (2 MB), whatever the benchmark's size
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words, in lower-cased text


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; none for a null text."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, SPLIT), lambda w: w != "")


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct (item, window_words) of all items; items without words have none."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    return w.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("window_words")).distinct()


def _shingle_rows(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple]:
    """Per run of rows: (first row, rows, shingle hashes, their rows, their word positions in the row, (starts, ends, word rows, data))."""
    for i, j, data, off in text_chunks(batch.column(column)):
        h, rows, s, e = hashed_words(data, off, WORD_BYTES)
        first = bounds(rows, j - i)
        out_h, out_at = [], []
        g, at = ngram_hashes(h, rows, size)
        out_h.append(g), out_at.append(at)
        # rows of fewer words than a shingle are one shorter shingle
        for k in range(1, size):
            short = first[:-1][np.diff(first) == k]
            if len(short):
                g, at = ngram_hashes(h, rows, k)
                hit = np.isin(at, short)
                out_h.append(g[hit]), out_at.append(at[hit])
        g, at = np.concatenate(out_h), np.concatenate(out_at)
        r = rows[at]
        yield i, j - i, g, r, at - first[r], (s, e, first, data)


def _sieve(hashes: Iterable[int], bits: int) -> bytes:
    m = np.zeros(1 << (bits - 3), np.uint8)
    h = np.fromiter(hashes, np.uint64) >> np.uint64(64 - bits)
    np.bitwise_or.at(m, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
    return m.tobytes()


def _in_sieve(sieve: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    p = h >> np.uint64(64 - bits)
    return (sieve[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 != 0


def _bitmap(df: DataFrame, column: str, bits: int) -> bytes:
    """Which of 2**bits hash places occur: at most 2**bits / 64 words reach the driver."""
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = df.select((F.shiftrightunsigned(place, 6)).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in words.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        out[r["at"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out.tobytes()


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def shingled_windows(items: DataFrame, item_id: str, text: str, window: int, size: int) -> DataFrame:
    """Each distinct window's shingles: (window_text, n_words, shingle, at)."""
    distinct = item_windows(items, item_id, text, window).select(F.array_join("window_words", " ").alias("window_text")).distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n, g, r, at, (_, _, first, _) in _shingle_rows(b, 0, min(size, window)):
                cols = [b.column(0).take(pa.array(r + i)), pa.array(np.diff(first)[r], pa.int64()), _signed(g), pa.array(at, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["window_text", "n_words", "shingle", "at"])

    return distinct.mapInArrow(run, "window_text string, n_words long, shingle long, at long")


def shingle_counts(docs: DataFrame, wanted: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """How often each wanted shingle occurs in all documents: (shingle, n); counts combine before the shuffle."""
    sc = docs.sparkSession.sparkContext
    sieve = sc.broadcast(_bitmap(wanted, "shingle", SIEVE_BITS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(sieve.value, np.uint8)
        for b in batches:
            for _, _, data, off in text_chunks(b.column(0)):
                h, rows, _, _ = hashed_words(data, off, WORD_BYTES)
                for size in sizes:
                    g, _ = ngram_hashes(h, rows, size)
                    k, n = np.unique(g[_in_sieve(mask, g, SIEVE_BITS)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([_signed(k), pa.array(n, pa.int64())], names=["shingle", "n"])

    found = docs.select(docs[text]).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return found.join(wanted.select("shingle").distinct(), "shingle", "left_semi")


def find(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, windows).

    ``documents``: doc_id, key (hash of the text), n_words, one row per input row.
    ``hits``: distinct (doc_id, key, start, window_text) of each occurrence of a window, ``start``
    counting words from 0. ``windows``: distinct (item, window_text).

    The documents' side is sieved in the tasks that read it by a bitmap of fixed size; only the
    few places where a prefix shingle may stand are shuffled. A passage in a third of all
    documents gives one row per place, not pairs of documents.
    """
    window = max(1, window)
    size = min(shingle, window)
    pairs = reused(item_windows(items, item_id, item_text, window).select("item", F.array_join("window_words", " ").alias("window_text")), "windows")
    own = reused(shingled_windows(items, item_id, item_text, window, size), "window-shingles")
    sizes = sorted(r.n for r in own.select(F.least("n_words", F.lit(size)).alias("n")).distinct().collect())  # 1..size at most
    counts = shingle_counts(docs, own, text, sizes)
    # one necessary shingle per window: the rarest, the first of equally rare ones
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")
    prefix = reused(
        own.join(counts, "shingle", "left").groupBy("window_text", "n_words").agg(F.min_by(F.struct("shingle", "at"), rank).alias("p"))
        .select("window_text", "n_words", "p.shingle", "p.at"), "window-prefix",
    )
    sc = docs.sparkSession.sparkContext
    sieve = sc.broadcast(_bitmap(prefix, "shingle", SIEVE_BITS))
    schema = "doc_id long, key long, n_words long, places array<struct<shingle:long,word:long,first:long,around:string>>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(sieve.value, np.uint8)
        kind = pa.list_(pa.struct([("shingle", pa.int64()), ("word", pa.int64()), ("first", pa.int64()), ("around", pa.string())]))
        for b in batches:
            n_words = np.zeros(b.num_rows, np.int64)
            places: list[list] = [[] for _ in range(b.num_rows)]
            for i, j, data, off in text_chunks(b.column(2)):
                h, rows, s, e = hashed_words(data, off, WORD_BYTES)
                first = bounds(rows, j - i)
                n_words[i:j] = np.diff(first)
                low = None
                for k in sizes:
                    g, at = ngram_hashes(h, rows, k)
                    hit = np.flatnonzero(_in_sieve(mask, g, SIEVE_BITS))
                    if len(hit) and low is None:
                        low = LOWER[data].tobytes()
                    for x in hit.tolist():
                        p = int(at[x])
                        r = int(rows[p])
                        a, z = max(int(first[r]), p - window + 1), min(int(first[r + 1]), p + window)
                        around = b" ".join(low[u:v] for u, v in zip(s[a:z].tolist(), e[a:z].tolist(), strict=True)).decode("utf-8", "replace")
                        places[i + r].append({"shingle": int(g[x : x + 1].view(np.int64)[0]), "word": p - int(first[r]), "first": a - int(first[r]), "around": around})
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words), pa.array(places, kind)], names=["doc_id", "key", "n_words", "places"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(F.xxhash64(docs[text]), F.lit(0)).alias("key"), docs[text].alias("text"))
    searched = reused(rows.mapInArrow(run, schema), "searched")
    placed = searched.where("size(places) > 0").select("doc_id", "key", "n_words", F.explode("places").alias("x")).select("doc_id", "key", F.col("n_words").alias("doc_words"), "x.*")
    start = F.col("word") - F.col("at")
    words = F.split("around", " ")
    there = F.array_join(F.slice(words, (F.col("start") - F.col("first") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    hits = (
        placed.join(prefix, "shingle")
        .withColumn("start", start)
        .where("start >= 0 AND start + n_words <= doc_words AND start >= first")
        .where(there == F.col("window_text"))
        .select("doc_id", "key", "start", "n_words", "window_text")
        .distinct()
    )
    return searched.select("doc_id", "key", "n_words"), hits, pairs


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, key, n_words, n_hit (words inside any occurrence), n_items, items (sorted ids as strings), contaminated.

    Null and empty texts have no words and no hits; items without words are ignored, and an
    empty benchmark hits nothing. Repeated items count by their ids; repeated documents come
    back as often as they came, with the hits of their own text. Other columns are not read.
    """
    all_docs, hits, pairs = find(docs, items, **options)
    hits = reused(hits, "hits")
    covered = F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("n_words") - 1))))
    n_hit = hits.groupBy("doc_id", "key").agg(F.size(covered).cast("long").alias("n_hit"))
    of = hits.select("doc_id", "key", "window_text").distinct().join(pairs, "window_text")
    n_items = of.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    keys = lambda d: d.withColumns({"doc_id": F.coalesce("doc_id", F.lit(-(1 << 63)))})  # noqa: E731  a null id joins, too
    out = keys(all_docs).join(keys(n_hit), ["doc_id", "key"], "left").join(keys(n_items), ["doc_id", "key"], "left")
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.nullif(F.col("doc_id"), F.lit(-(1 << 63))).alias("doc_id"), "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_col).cast("long").alias("n_items"), items_col.alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    joined = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return decontaminate(docs, items).select("doc_id", "n_words", "n_hit", "n_items", joined, "contaminated")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS r(i) WHERE len(w) > 0
),
lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, lens, unnest(range(1, len(w) - n + 2)) AS r(i)
),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""
