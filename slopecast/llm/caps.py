"""Near-duplicate vectors by spherical-cap filters.

The filters are the caps of a structured random product code: the space is cut into orthogonal
blocks, each block has a small random code, and a filter direction joins one code word of every
block. A vector belongs to every filter whose direction exceeds a threshold; the product form
lets a list decoder find exactly those without trying all directions. Similar vectors share a
filter with high probability, so an equi-join on filters finds them, and the cosine is verified
in double precision.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reused
from .components import components

BLOCKS = 3  # orthogonal parts of the space
WORDS = 16  # code words per part: WORDS ** BLOCKS directions
TABLES = 5  # independent codes, each with a rotation of its own
THRESHOLD = 0.4  # least inner product of a vector and the directions it belongs to, in 64 dimensions and more
FILTERS = 6  # filters per table that a random vector of fewer dimensions has on average: they raise the threshold
DIMENSIONS = 1 << 32  # a filter's number holds the dimension below this
MEMBERS = 512  # vectors of one side that a task compares with those of another side at once


@lru_cache(maxsize=8)
def _code(dim: int, table: int, blocks: int, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation, and each block's code words as [dimension, word], scaled so that directions are unit vectors."""
    rng = np.random.default_rng([dim, table, blocks, words])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    parts = []
    for size in (len(x) for x in np.array_split(np.arange(dim), blocks)):
        c = rng.standard_normal((words, size))
        parts.append((c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).T / np.sqrt(blocks))
    return rotation, parts


def parts_of(dim: int, blocks: int = BLOCKS) -> int:
    """Orthogonal parts of ``dim`` dimensions, of two at least: the words of a single one are but its two ends."""
    return min(blocks, max(1, dim // 2))


@lru_cache(maxsize=64)
def threshold_of(dim: int, blocks: int = BLOCKS, words: int = WORDS) -> float:
    """The least inner product for ``dim`` dimensions: directions crowd in few of them, so the caps have to be smaller.

    Measured on random unit vectors of a fixed seed. Filters per vector over all five tables: 30 in
    2 to 32 dimensions, 13 in 64, 5 in 128 and more, where the best direction of each table counts.
    """
    rng = np.random.default_rng([dim, 7])
    x = rng.standard_normal((512, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation, parts = _code(dim, 0, parts_of(dim, blocks), words)
    turned, at, sums = x @ rotation, 0, np.zeros((len(x), 1))
    for c in parts:
        sums = (sums[:, :, None] + (turned[:, at : at + len(c)] @ c)[:, None, :]).reshape(len(x), -1)
        at += len(c)
    return max(THRESHOLD, float(np.quantile(sums, max(0.0, 1 - FILTERS / sums.shape[1]))))


def decode(x: np.ndarray, table: int, blocks: int = BLOCKS, words: int = WORDS, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction number) of all directions whose inner product with a unit row exceeds ``threshold``.

    Block by block, a partial choice stays only while the best words of the blocks to come could
    still lift it over the threshold. The best direction of a row always counts, so each vector
    has a filter.
    """
    blocks = parts_of(x.shape[1], blocks)
    rotation, parts = _code(x.shape[1], table, blocks, words)
    turned, at, inner = x @ rotation, 0, []
    for c in parts:
        inner.append(turned[:, at : at + len(c)] @ c)
        at += len(c)
    best = np.stack([g.max(1) for g in inner], 1)
    to_come = np.concatenate((np.cumsum(best[:, ::-1], 1)[:, ::-1][:, 1:], np.zeros((len(x), 1))), 1)
    least = np.minimum(threshold, best.sum(1) - 1e-9)
    row, no, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for k, g in enumerate(inner):
        sums = total[:, None] + g[row]
        i, w = np.nonzero(sums + to_come[row, k][:, None] > least[row][:, None])
        row, no, total = row[i], no[i] * words + w, sums[i, w]
    return row, no


def _unit(col: pa.Array) -> np.ndarray:
    x = np.array(col.to_pylist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_size(col: pa.Array) -> Iterator[np.ndarray]:
    """Row numbers of vectors of the same dimension."""
    size = np.array([len(v) for v in col.to_pylist()])
    for d in np.unique(size):
        yield np.flatnonzero(size == d)


def cap_filters(classes: DataFrame) -> DataFrame:
    """(id, label, n, vec, filters): each vector with the sorted numbers of its filters."""
    schema = "id long, label string, n long, vec array<double>, filters array<long>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            for rows in _by_size(b.column(3)):
                part = b.take(pa.array(rows))
                x = _unit(part.column(3))
                found = [decode(x, t, threshold=threshold_of(x.shape[1])) for t in range(TABLES)]
                row = np.concatenate([r for r, _ in found])
                no = np.concatenate([(n * TABLES + t) * DIMENSIONS + x.shape[1] for t, (_, n) in enumerate(found)])
                order = np.lexsort((no, row))
                at = np.searchsorted(row[order], np.arange(len(x) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(no[order]))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], lists], names=["id", "label", "n", "vec", "filters"])

    return classes.select("id", "label", "n", "vec").mapInArrow(run, schema)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that join each of ``n`` members to the first of its group."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(find(x), x) for x in range(n) if find(x) != x]


def _compare(g: pa.Table, least: float) -> tuple[list, list, list, list]:
    """Links of one block of one filter: (linked ids, how many vectors each gained, link ends a, link ends b)."""
    lo, side = g["lo"][0].as_py() == g["hi"][0].as_py(), np.array(g["side"])
    ids, n = np.array(g["id"]), np.array(g["n"])
    x = _unit(g["vec"].combine_chunks())
    a = np.arange(len(ids)) if lo else np.flatnonzero(side == 0)
    b = np.arange(len(ids)) if lo else np.flatnonzero(side == 1)
    i, j = np.nonzero(x[a] @ x[b].T >= least)
    i, j = a[i], b[j]
    if lo:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return [], [], [], []
    # a pair under several filters counts under the least one
    lists = g["filters"].to_pylist()
    wide = np.full((len(lists), max(map(len, lists))), -1, np.int64)
    for k, f in enumerate(lists):
        wide[k, : len(f)] = f
    here, keep = g["filter"][0].as_py(), np.zeros(len(i), bool)
    for s in range(0, len(i), 20_000):
        u, v = wide[i[s : s + 20_000]], wide[j[s : s + 20_000]]
        common = ((u[:, :, None] == v[:, None, :]) & (u >= 0)[:, :, None]).any(2)
        keep[s : s + 20_000] = np.where(common, u, np.iinfo(np.int64).max).min(1) == here
    i, j = i[keep], j[keep]
    gained = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
    hit = np.flatnonzero(gained)
    order = np.argsort(ids)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    ends = _roots(len(ids), rank[i], rank[j])
    return ids[hit].tolist(), gained[hit].astype(np.int64).tolist(), [int(ids[order[p]]) for p, _ in ends], [int(ids[order[q]]) for _, q in ends]


def similar_blocks(filtered: DataFrame, least: float) -> DataFrame:
    """(id, gained, a, b): link counts of ids, and links that connect what is linked.

    The members of a filter are dealt into blocks of about ``MEMBERS``, and every two blocks meet
    in one group, whose rows are bounded however many vectors share the filter. A group returns
    counts and connecting links, not its pairs.
    """
    each = filtered.withColumn("filter", F.explode("filters"))
    sizes = each.groupBy("label", "filter").agg(F.count("*").alias("members")).where("members > 1")
    dealt = each.join(sizes, ["label", "filter"]).withColumn("blocks", F.ceil(F.col("members") / MEMBERS).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "filter", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"),
        "id", "n", "vec", "filters",
    )
    key = ["label", "filter", "lo", "hi"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = [np.array(t[c]) for c in key]
            cut = np.zeros(t.num_rows, bool)
            for c in cols:
                cut[1:] |= c[1:] != c[:-1]
            starts = np.concatenate(([0], np.flatnonzero(cut), [t.num_rows]))
            out: tuple[list, list, list, list] = ([], [], [], [])
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if e - s > 1:
                    for x, y in zip(out, _compare(t.slice(s, e - s), least), strict=True):
                        x.extend(y)
            ids, gained, a, b = out
            none = pa.nulls
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gained, pa.int64()), none(len(ids), pa.int64()), none(len(ids), pa.int64())], names=["id", "gained", "a", "b"])
            yield pa.RecordBatch.from_arrays([none(len(a), pa.int64()), none(len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["id", "gained", "a", "b"])

        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            last = np.ones(t.num_rows, bool)
            for c in key:
                v = np.array(t[c])
                last &= v == v[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if (~last).any() else 0
            if cut:
                yield from answer(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield from answer(held)

    return met.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "id long, gained long, a long, b long")


def near_vectors(vectors: DataFrame, least: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (least id reachable by links), kept (it is that one).

    Vectors are compared when their labels are equal and not null. Null, empty or zero vectors,
    those with null or non-finite components, and those of a null label or id link with nothing.
    Equal vectors of one label are one class before anything is joined and count as linked with
    each other; repeated rows count as often as they appear. Vectors of unequal length never
    link. Other columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.withColumn("vec", F.when(F.col("ok"), F.col("vec"))).withColumn("h", F.when(F.col("ok"), F.xxhash64("vec")))
    rows = reused(rows, "vectors")
    classes = reused(rows.where("ok").groupBy("label", "h", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector-classes")
    found = reused(similar_blocks(cap_filters(classes), least), "vector-links")
    gained = found.where("id is not null").groupBy("id").agg(F.sum("gained").alias("gained"))
    joined = components(found.where("a is not null").select("a", "b")).withColumnRenamed("node", "id")
    of = classes.join(gained, "id", "left").join(joined, "id", "left").select(
        "label", "h", "vec", (F.col("n") - 1 + F.coalesce("gained", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("root")
    )
    out = rows.join(of, ["label", "h", "vec"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(True)).alias("kept"),
    )


def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
),
reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.r
),
least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN n USING (vec_id)
"""
