"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, scratch_path


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Connect neighbours to the least node of a neighbourhood.

    Large star: every larger neighbour of a node moves to the node's least neighbour (itself
    included). Small star: the node and its smaller neighbours move to the least of them.
    """
    if large:
        near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = near.join(least, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its least node.

    The table of links is written to the shared folder each round and the previous one deleted,
    so plans stay short and survive lost executors. Rounds grow with the log of the longest
    chain. A node of very many links is a long run of one key in a join whose other side has one
    row per key, which adaptive execution splits. Self links and repeated links are allowed;
    a link with a null end is ignored.
    """
    spark = links.sparkSession
    now = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct()
    before, path = None, None
    while True:
        new = scratch_path(spark, "links")
        now.write.parquet(new)
        if path:
            discard(spark, path)
        now, path = spark.read.parquet(new), new
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = _star(_star(now, True), False)
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
