"""Labels, spatial folds and training samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import N_FOLDS, NEGATIVES_PER_POSITIVE
from ..functions.text import seeded_uniform
from .ranking import seeded_order, small_map


def agreement_table(mask: DataFrame) -> DataFrame:
    return mask.groupBy("n_sources").agg(F.count(F.lit(1)).alias("cells"))


def make_folds(blocks: DataFrame, min_cells: int, seed: int = 0, folds: int = N_FOLDS) -> DataFrame:
    """(block, n_cells, fold, is_sliver). Kept blocks are shuffled by seed and dealt out;
    slivers inherit the fold of the nearest kept block (first block on a tie).

    ``blocks``: (block, block_row, block_col, n_cells), one row per 50 km block.
    Slivers search outward by level (see ``spatial.nearest``), so no block list is
    ever paired with itself.
    """
    from .spatial import nearest

    kept = seeded_order(blocks.where(F.col("n_cells") >= min_cells), ["block"], seed).withColumn(
        "fold", F.pmod(F.col("pos") - 1, F.lit(folds)).cast("int")
    )
    small = blocks.where(F.col("n_cells") < min_cells)
    home = kept.select(F.col("block").alias("near"), F.col("block_row").alias("_kr"), F.col("block_col").alias("_kc"), "fold")
    dr, dc = F.col("_kr") - F.col("block_row"), F.col("_kc") - F.col("block_col")
    given = nearest(
        small, home, "block", ["near", "fold"], (F.col("block_col"), F.col("block_row")),
        (F.col("_kc"), F.col("_kr")), 1.0, dr * dr + dc * dc, [F.col("near")],
    ).select("block", "fold")
    out = kept.select("block", "n_cells", "fold", F.lit(0).alias("is_sliver"))
    return out.unionByName(small.join(given, "block").select("block", "n_cells", "fold", F.lit(1).alias("is_sliver")))


def fold_report(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("n_cells").alias("cells"), F.sum("is_sliver").alias("slivers")
    )


def sample_negatives(pool: DataFrame, positives: DataFrame, ids: Sequence[str], k: int = NEGATIVES_PER_POSITIVE, seed: int = 0, by: str = "fold") -> DataFrame:
    """k negatives per positive in each fold, seeded, without replacement, as far as the pool goes."""
    quota = small_map(positives.groupBy(by).agg((F.count(F.lit(1)) * k).alias("q")), by, F.col("q"))
    drawn = seeded_order(pool, ids, seed, [by]).withColumn("_quota", quota)
    return drawn.where(F.col("pos") <= F.element_at("_quota", F.col(by))).drop("pos", "_quota")


def cap_per_class(df: DataFrame, cls: str, n: int, ids: Sequence[str], seed: int = 0) -> DataFrame:
    """At most n rows per class: a sampling operator, seeded."""
    return seeded_order(df, ids, seed, [cls]).where(F.col("pos") <= n).drop("pos")


def attach_features(sample: DataFrame, cells: DataFrame, features: Sequence[str]) -> DataFrame:
    """Join features on the cell key and drop incomplete rows."""
    return sample.join(cells.select("cell_id", *features), "cell_id", "left").dropna(subset=list(features))


def numbered(df: DataFrame, ids: Sequence[str], seed: int | str) -> DataFrame:
    return seeded_order(df, ids, seed).withColumnRenamed("pos", "idx")


def background_draw(cells: DataFrame, days: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random (cell, day) pairs with replacement.

    Draw numbers are hashed to positions; positions are looked up by equi-join, so the
    two tables are never multiplied.
    """
    c = numbered(cells, ["cell_id"], f"c{seed}").select(F.col("idx").alias("_ci"), "cell_id")
    d = numbered(days, ["day"], f"d{seed}").select(F.col("idx").alias("_di"), "day")
    nc = cells.agg(F.count(F.lit(1)).alias("n")).scalar()
    nd = days.agg(F.count(F.lit(1)).alias("n")).scalar()
    draws = cells.sparkSession.range(n).withColumn("_nc", nc).withColumn("_nd", nd)
    at = draws.select(
        "id",
        (F.floor(seeded_uniform(f"ci{seed}", "id") * F.col("_nc")) + 1).alias("_ci"),
        (F.floor(seeded_uniform(f"di{seed}", "id") * F.col("_nd")) + 1).alias("_di"),
    )
    return at.join(c, "_ci").join(d, "_di").select("id", "cell_id", "day")


def matched_controls(df: DataFrame, positive: Column, control: Column, slope: str, ids: Sequence[str], floor_rows: int = 0, cap: int | None = None, seed: int = 0, first: int = 10, last: int = 70, width: int = 10) -> DataFrame:
    """Equal numbers of slide and control cells per slope band.

    As many of each as the scarcer role has. ``floor_rows`` leaves out bands with fewer rows of
    either role, and ``cap`` bounds the draw; by default neither applies.
    """
    role = F.when(positive, "slide").when(control, "control")
    band = (F.floor(F.col(slope) / width) * width).cast("int")
    tagged = df.withColumn("role", role).withColumn("band", band).where(
        F.col("role").isNotNull() & F.col("band").between(first, last - width)
    )
    n = tagged.groupBy("band").agg(F.count_if(F.col("role") == "slide").alias("a"), F.count_if(F.col("role") == "control").alias("b"))
    both = F.least("a", "b") if cap is None else F.least("a", "b", F.lit(cap))
    take = small_map(n.where((F.col("a") >= floor_rows) & (F.col("b") >= floor_rows)), "band", both)
    drawn = seeded_order(tagged, ids, seed, ["band", "role"]).withColumn("_take", take)
    return drawn.where(F.col("pos") <= F.element_at("_take", F.col("band"))).drop("pos", "_take")


def dealt_folds(keys: DataFrame, key: str, seed: int = 0, folds: int = N_FOLDS) -> DataFrame:
    """Deal distinct keys (for example block names) into folds in seeded order."""
    return seeded_order(keys.select(key).distinct(), [key], seed).select(
        key, F.pmod(F.col("pos") - 1, F.lit(folds)).cast("int").alias("fold")
    )


def naive_sample_overlap(naive: DataFrame, distances: DataFrame, limit_m: float) -> DataFrame:
    """Share of an unconstrained negative draw that sits within reach of a label."""
    j = naive.join(distances.select("cell_id", "dist_m"), "cell_id")
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("dist_m") <= limit_m).cast("double")).alias("share_near"))
