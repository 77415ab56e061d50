"""Bounded samples without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _least(keyed: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """The least ``key`` of each of ``n`` slots per ``by`` key: a combining aggregation over numbers."""
    return keyed.groupBy(*by, (F.col("key") % n).alias("_slot")).agg(F.min("key").alias("key")).drop("_slot")


def _hash(column: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 1)


def smallest_hashes(df: DataFrame, text: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """At most ``n`` rows per ``by`` key: columns ``text``, ``key`` (its hash, not negative) and ``by``.

    Texts are dealt into ``n`` slots by hash and each slot keeps its smallest hash; copies share
    a hash and stand once. Null texts are left out.
    """
    keyed = df.where(F.col(text).isNotNull()).select(*by, F.col(text).alias("text"), _hash(text).alias("key"))
    hit = keyed.join(F.broadcast(_least(keyed, n, by)), [*by, "key"], "left_semi")  # n rows per key at most
    return hit.groupBy(*by, "key").agg(F.min("text").alias("text")).select("text", "key", *by)


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, n: int) -> DataFrame:
    """At most ``n`` documents per label: columns ``text``, ``key``, ``label``.

    Labels are chosen by a hash of their document's id before any text is read, so only the
    chosen rows travel. Null ids, texts and labels are left out.
    """
    keyed = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("label"), _hash(doc_id).alias("key"))
    texts = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(text).alias("text"), _hash(doc_id).alias("key"))
    return texts.join(F.broadcast(_least(keyed, n, ["label"])), "key").select("text", "key", "label")


BROADCAST_IDS = 1 << 20  # ids that are sent to every executor rather than shuffled, 8 MB


def only(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``ids`` (or, with ``left_anti``, is not).

    ``ids`` is counted first: up to ``BROADCAST_IDS`` it is broadcast, so wide rows of ``df`` stay
    where they are; beyond that both sides are shuffled.
    """
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)
