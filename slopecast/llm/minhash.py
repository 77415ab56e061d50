"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document is the set of its word shingles. Its signature keeps 8 bits of each of ``CHUNKS *
WIDTH`` minimum hashes, so two signatures differ in about (1 - similarity) of their places.
Signatures are cut into chunks. By the pigeonhole principle two signatures that differ in at
most ``CHUNKS * (ERRORS + 1) - 1`` places have a chunk with at most one differing place, and an
index of every chunk with each place left out in turn finds all such pairs. Links are confirmed
on the shingles themselves.

Copies are taken out first: equal sets are one class, by a combining aggregation. A hot index
key is not expanded into pairs at once. Each class first meets only the least class under each
of its keys, and of those the one with the nearest signature is verified. Links are joined into
components, and classes under one key that still lie apart meet a class chosen by hash in the
same way. Only what lies apart after those rounds meets all others under its keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release, reused
from .components import components
from .kernel import NOT_SPACE, bounds, distinct_in_rows, hashed_words, mix, ngram_hashes, text_chunks
from .sampling import only

CHUNKS, WIDTH, ERRORS = 16, 8, 1
PLACES = CHUNKS * WIDTH
GUARANTEED = CHUNKS * (ERRORS + 1) - 1  # all pairs of signatures up to this distance are found
# Pairs of a similarity of 0.8 share an index key with probability 0.99998. Candidates are verified
# up to 4.7 standard deviations above the mean distance of that similarity.
VERIFIED = 47
ROUNDS = 2  # of meeting a chosen class under each key, before all classes under a key meet
_RNG = np.random.default_rng(96)
_FACTORS = _RNG.integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(1, 1 << 63, PLACES, dtype=np.uint64)

SETS = "doc_id long, n_shingles long, d1 long, d2 long, signature binary"


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, and the rows' offsets into them.

    A row of fewer than ``n`` words, but not none, has its whole sequence as one shingle.
    """
    h, rows, _, _ = hashed_words(data, off, NOT_SPACE)
    count = len(off) - 1
    words = np.diff(bounds(rows, count))
    g, at = ngram_hashes(h, rows, n)
    r = rows[at]
    for k in range(1, n):
        short = np.flatnonzero(words == k)
        if len(short):
            s, where = ngram_hashes(h, rows, k)
            hit = np.isin(rows[where], short)
            g, r = np.concatenate((g, s[hit] ^ np.uint64(k))), np.concatenate((r, rows[where][hit]))
    return distinct_in_rows(r, g, count)


def signatures(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[row, place] 8-bit signatures of the non-empty sets."""
    full = at[:-1][np.diff(at) > 0]
    out = np.empty((len(full), PLACES), np.uint8)
    g = mix(g)
    for k in range(PLACES if len(full) else 0):
        out[:, k] = mix(np.minimum.reduceat(g * _FACTORS[k] + _SHIFTS[k], full)) & np.uint64(255)
    return out


def document_sets(docs: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in text_chunks(b.column(1)):
                g, at = shingle_sets(data, off, n)
                size = np.diff(at)
                full = size > 0
                d = np.zeros((2, j - i), np.uint64)
                if full.any():
                    d[0, full] = np.add.reduceat(mix(g), at[:-1][full])
                    d[1, full] = np.add.reduceat(mix(g ^ np.uint64(0x5BD1E995)), at[:-1][full])
                sig = np.full(j - i, None, object)
                sig[full] = [x.tobytes() for x in signatures(g, at)]
                cols = [b.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SETS.split(", ")])

    return docs.select(docs[doc_id].cast("long"), docs[text]).mapInArrow(run, SETS)


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, id): each chunk of a signature with each of its places left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
            ids = b.column(0)
            for w in range(WIDTH):
                key = np.tile((np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(w)), (len(sig), 1))
                for p in range(WIDTH):
                    if p != w:
                        key = (key << np.uint64(8)) | sig[:, :, p]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().view(np.int64)), ids.take(pa.array(np.repeat(np.arange(len(sig)), CHUNKS)))], names=["key", "id"]
                )

    return classes.select("id", "signature").mapInArrow(run, "key long, id long")


def near_signatures(pairs: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """(a, b, distance) of the pairs whose signatures differ in at most ``most`` places."""
    sig = classes.select("id", "signature")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            m = [np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint8).reshape(-1, PLACES) for k in (2, 3)]
            far = (m[0] != m[1]).sum(1)
            keep = pa.array(np.flatnonzero(far <= most))
            yield pa.RecordBatch.from_arrays([x.column(0).take(keep), x.column(1).take(keep), pa.array(far, pa.int32()).take(keep)], names=["a", "b", "distance"])

    return both.mapInArrow(run, "a long, b long, distance int")


def _words(text: str | None, n: int) -> set:
    w = (text or "").encode().lower().split()
    return set(zip(*[w[k:] for k in range(n)], strict=False)) if len(w) >= n else {tuple(w)} if w else set()


def confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""
    needed = reused(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "needed-ids")
    rows = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].alias("text"))
    texts = reused(only(rows, needed, "id").groupBy("id").agg(F.min("text").alias("text")), "texts")
    both = pairs.select("a", "b").join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last = None, set()
        for x in batches:
            a, b, ta, tb = (c.to_pylist() for c in x.columns)
            keep = []
            for i in range(x.num_rows):
                if b[i] != last_id:  # rows arrive sorted by the key of the last join
                    last_id, last = b[i], _words(tb[i], n)
                one = _words(ta[i], n)
                common = len(one & last)
                keep.append(common > 0 and 100 * common >= percent * (len(one) + len(last) - common))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = reused(both.mapInArrow(run, "a long, b long"), "confirmed")
    release(needed, texts)
    return out


def _apart(member: DataFrame, joined: DataFrame) -> DataFrame:
    """(key, id, component) of the classes under keys whose classes lie in several components."""
    placed = member.select("key", "id").join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = placed.groupBy("key").agg(F.min("component").alias("u"), F.max("component").alias("v")).where("u < v").select("key")
    return placed.join(several, "key", "left_semi")


def _merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links."""
    of = lambda c: F.coalesce(F.col(f"{c}_c"), F.col(c)).alias(c)
    lifted = links.join(joined.toDF("a", "a_c"), "a", "left").join(joined.toDF("b", "b_c"), "b", "left").select(of("a"), of("b"))
    more = components(lifted)
    moved = joined.join(more.toDF("component", "whole"), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    return reused(moved.unionByName(more.join(joined.select("node"), "node", "left_anti")), "components")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id linked with it), kept (it is that one).

    Words are maximal runs of anything but ASCII white space, lower-cased in A-Z. Null and empty
    texts have no shingles and are linked with nothing. Repeated rows with one id and text are
    one member; where one id has several texts, the least text stands for it in confirmation. A
    null id is linked with nothing and kept. Other columns are not read; an empty table gives no rows.
    """
    sets = reused(document_sets(docs, shingle, doc_id, text), "sets")
    real = sets.where("n_shingles > 0 and doc_id is not null")
    classes = reused(
        real.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("id"), F.min_by("signature", "doc_id").alias("signature")), "classes"
    )
    # a class becomes 128 keys: so few classes that a task reads many of them would be too much for it
    keys = index_keys(classes.select("id", "signature").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id"))
    shared = reused(keys.groupBy("key").agg(F.min("id").alias("p"), F.max("id").alias("q")).where("p < q").select("key", "p"), "shared-keys")
    member = reused(keys.join(shared, "key").select("key", "id", "p"), "key-members")
    release(shared)
    star = near_signatures(member.where("id <> p").select(F.col("p").alias("a"), F.col("id").alias("b")).distinct(), classes, VERIFIED)
    nearest = reused(star.groupBy("b").agg(F.min_by("a", F.struct("distance", "a")).alias("a")).select("a", "b"), "nearest")
    joined = reused(components(confirmed(nearest, docs, shingle, percent, doc_id, text)), "components")
    looked = nearest.select("a", "b")
    for seed in range(ROUNDS):
        apart = reused(_apart(member, joined), "apart")
        chosen = apart.groupBy("key").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id", "key", F.lit(seed))).alias("p"))
        met = apart.join(chosen, "key").where("component <> p.component").select(F.col("p.id").alias("a"), F.col("id").alias("b")).distinct()
        close = near_signatures(met, classes, VERIFIED)
        nearest = reused(close.groupBy("b").agg(F.min_by("a", F.struct("distance", "a")).alias("a")).select("a", "b"), "nearest")
        joined = _merged(joined, confirmed(nearest, docs, shingle, percent, doc_id, text))
        looked = looked.unionByName(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    apart = reused(_apart(member, joined), "apart")
    x = apart.select("key", F.col("id").alias("a"), F.col("component").alias("ca"))
    y = apart.select("key", F.col("id").alias("b"), F.col("component").alias("cb"))
    met = x.join(y, (x["key"] == y["key"]) & (F.col("ca") < F.col("cb"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    late = reused(near_signatures(met.join(looked.distinct(), ["a", "b"], "left_anti"), classes, VERIFIED).select("a", "b"), "late")
    joined = _merged(joined, confirmed(late, docs, shingle, percent, doc_id, text))
    root = classes.join(joined.withColumnRenamed("node", "id"), "id", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "id").alias("root"))
    out = sets.join(root, ["d1", "d2", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=2, percent=80)
