"""Gazetteer jobs: unique labels, anchors, query resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SAME_PLACE_KM
from ..functions.lattice import km_local
from ..functions.text import parse_coords
from .ranking import row_numbers


def _deg(c: Column, hemi: str) -> Column:
    return F.format_string(f"%.2f°{hemi}", F.round(c, 2))


def label_places(towns: DataFrame, order: str = "place_id") -> DataFrame:
    """Unique labels: coordinates are appended to repeated names, then ``#n`` to what still repeats."""
    repeats = towns.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    base = F.when(
        F.col("_n") > 1,
        F.concat("name", F.lit("  ("), _deg(F.col("lat"), "N"), F.lit(" "), _deg(F.col("lon"), "E"), F.lit(")")),
    ).otherwise(F.col("name"))
    first = towns.join(repeats, "name").withColumn("_base", base)
    numbered = row_numbers(first, order, ["_base"], "_k")
    return numbered.withColumn(
        "label", F.when(F.col("_k") > 1, F.concat("_base", F.lit(" #"), F.col("_k").cast("string"))).otherwise(F.col("_base"))
    ).drop("_n", "_base", "_k")


def merge_anchors(anchors: DataFrame, towns: DataFrame, labels: DataFrame, km: float = SAME_PLACE_KM) -> DataFrame:
    """Anchors not already listed nearby under the same name, renamed where the label is taken."""
    t = towns.select(F.col("name").alias("_tn"), F.col("lat").alias("_tlat"), F.col("lon").alias("_tlon"))
    near = (F.col("name") == F.col("_tn")) & (km_local(F.col("lat"), F.col("lon"), F.col("_tlat"), F.col("_tlon")) <= km)
    kept = anchors.join(t, near, "left_anti")
    taken = labels.select(F.col("label").alias("name")).distinct().withColumn("_taken", F.lit(True))
    return kept.join(taken, "name", "left").withColumn(
        "label", F.when(F.col("_taken"), F.concat("name", F.lit(" (town)"))).otherwise(F.col("name"))
    ).drop("_taken")


def resolve(queries: DataFrame, text: str, index: DataFrame) -> DataFrame:
    """Coordinates first, then an exact label; NULL when neither fits."""
    la, lo = parse_coords(F.col(text))
    q = queries.withColumn("_la", la).withColumn("_lo", lo)
    idx = index.select(F.col("label").alias(text), F.col("lat").alias("_ilat"), F.col("lon").alias("_ilon"), F.col("kind").alias("_ikind"))
    j = q.join(idx, text, "left")
    typed = F.col("_la").isNotNull()
    return (
        j.withColumn("lat", F.coalesce("_la", "_ilat")).withColumn("lon", F.coalesce("_lo", "_ilon"))
        .withColumn("kind", F.when(typed, "coords").otherwise(F.col("_ikind")))
        .drop("_la", "_lo", "_ilat", "_ilon", "_ikind")
    )
