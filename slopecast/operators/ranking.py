"""Exact ranks, running totals and percentiles without a one-task window.

A global ``Window.orderBy`` sends every row to one task. Everything here first
aggregates to distinct values, cuts the value range into quantile ranges, totals
each range (one row per range, a proven bound), and only then runs a window inside
each range. The results are exact; the ranges only spread the work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import seeded_key
from ..session import reused


def _n_ranges(df: DataFrame) -> int:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(4, n)


def histogram_of_values(df: DataFrame, value: str, by: Sequence[str] = (), **sums: Column) -> DataFrame:
    """One row per distinct value (and ``by`` key) with its count and extra sums."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(k) for k, c in sums.items()]
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*aggs)


def _cuts(df: DataFrame, value: str, n: int) -> Column:
    """Approximate quantiles that cut ``value`` into ``n`` ranges, sorted, as one array."""
    return df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("cuts")).scalar()


def _range_of(value: str, cuts: str, n: int) -> Column:
    """How many of at most ``n`` sorted cuts lie below a value, found by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, n - 1).bit_length() - 1, -1, -1)])
    return F.aggregate(
        steps, F.lit(0),
        lambda lo, s: F.when((lo + s <= F.size(cuts)) & (F.get(F.col(cuts), lo + s - 1) < F.col(value)), lo + s).otherwise(lo),
    )


def _in_ranges(hist: DataFrame, value: str, sums: Sequence[str], by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``hist`` with ``_rng``, and per range its totals ``_t_``, what lies before it ``_b_`` and its key's total ``_all``."""
    n = _n_ranges(hist)
    tagged = hist.withColumn("_cuts", _cuts(hist, value, n)).withColumn("_rng", _range_of(value, "_cuts", n)).drop("_cuts")
    w_all = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    per_range = tagged.groupBy(*by, "_rng").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    upto = w_all.orderBy("_rng").rowsBetween(W.unboundedPreceding, 0)
    ahead = per_range.select(
        "*",
        *[(F.sum(f"_t_{s}").over(upto) - F.col(f"_t_{s}")).alias(f"_b_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(w_all).alias(f"{s}_all") for s in sums],
    )
    return tagged, ahead


def running_totals(hist: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``{s}_upto`` (inclusive, ascending by ``value``) and ``{s}_all`` per ``by`` key.

    ``hist`` holds distinct values. Work is split by quantile range of the value, so
    no task sees more than its share even when one ``by`` key owns most rows. It is written
    once: the cuts and the totals read it, not what it was made from.
    """
    tagged, ahead = _in_ranges(reused(hist, "histogram"), value, sums, by)
    inside = W.partitionBy(*by, "_rng").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    out = tagged.join(ahead, [*by, "_rng"])
    for s in sums:
        out = out.withColumn(f"{s}_upto", F.sum(s).over(inside) + F.col(f"_b_{s}"))
    return out.drop("_rng", *[f"_{t}_{s}" for s in sums for t in "bt"])


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value with the tie-averaged 1-based rank as ``avg_rank``."""
    r = running_totals(histogram_of_values(df, value, by), value, ["n"], by)
    return r.withColumn("avg_rank", F.col("n_upto") - (F.col("n") - F.lit(1)) / F.lit(2.0))


def percentiles(df: DataFrame, value: str, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated percentiles, columns ``p0 .. pk`` in ``ps`` order.

    Totals of the value ranges tell which ranges hold a wanted position; only their values are
    shuffled and sorted.
    """
    tagged, ahead = _in_ranges(reused(histogram_of_values(df, value, by), "histogram"), value, ["n"], by)
    places = []
    for p in ps:
        pos = (F.col("n_all") - F.lit(1)) * F.lit(float(p))
        places.append((pos, F.floor(pos), F.ceil(pos)))
    held = [(at >= F.col("_b_n")) & (at < F.col("_b_n") + F.col("_t_n")) for _, lo, hi in places for at in (lo, hi)]
    some = tagged.join(ahead.where(F.exists(F.array(*held), lambda h: h)), [*by, "_rng"])
    inside = W.partitionBy(*by, "_rng").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    r = some.withColumn("n_upto", F.sum("n").over(inside) + F.col("_b_n"))
    aggs = []
    for i, (pos, lo, hi) in enumerate(places):
        for tag, at in (("lo", lo), ("hi", hi)):
            hit = (at < F.col("n_upto")) & (at >= F.col("n_upto") - F.col("n"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{tag}{i}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_f{i}"))
    wide = r.groupBy(*by).agg(*aggs, F.max("n_all").alias("n"))
    cols = [
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"p{i}")
        for i in range(len(ps))
    ]
    return wide.select(*by, "n", *cols)


def seeded_order(df: DataFrame, ids: Sequence[str], seed: int | str, by: Sequence[str] = ()) -> DataFrame:
    """A reproducible shuffle: ``pos`` 1..n per ``by`` key, by hash of ``ids``.

    Each key is cut into 4,096 equal hash buckets, so a key that owns a third of all
    rows is still ranked by 4,096 small windows instead of one.
    """
    keyed = df.withColumn("_key", seeded_key(seed, *ids)).withColumn("_bkt", F.substring("_key", 1, 3))
    counts = keyed.groupBy(*by, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(1))).orderBy("_bkt")
    ahead = counts.select(
        *by, "_bkt", (F.sum("_cnt").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("_cnt")).alias("_ahead")
    )
    inside = W.partitionBy(*by, "_bkt").orderBy("_key", *ids)
    return (
        keyed.join(ahead, [*by, "_bkt"])
        .withColumn("pos", F.row_number().over(inside) + F.col("_ahead"))
        .drop("_key", "_bkt", "_ahead")
    )


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``; partial aggregation, no window.

    ``min_by`` over a struct combines map-side, so a key with very many copies costs
    one row per task, not a sort of the whole group.
    """
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def share_below_own_history(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Share of the key's own rows strictly below each value (not ``percent_rank``).

    A key's history is one row per day, which bounds the window.
    """
    w = W.partitionBy(key)
    rank = F.rank().over(w.orderBy(F.col(value).asc_nulls_last()))
    return df.withColumn(
        out, F.when(F.col(value).isNotNull(), (rank - F.lit(1)) / F.count(value).over(w))
    )


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with the share of rows at or below each."""
    r = running_totals(histogram_of_values(df, value), value, ["n"])
    return r.select(value, (F.col("n_upto") / F.col("n_all")).alias("share"))


def row_numbers(df: DataFrame, order: str, by: Sequence[str] = (), out: str = "rn") -> DataFrame:
    """Exact ``row_number`` per ``by`` key over a numeric, unique ``order`` column.

    The key's rows are split by quantile range of the order column, so a key that owns a
    third of all rows is numbered by many tasks.
    """
    n = _n_ranges(df)
    tagged = df.withColumn("_cuts", _cuts(df, order, n)).withColumn("_rng", _range_of(order, "_cuts", n)).drop("_cuts")
    per = tagged.groupBy(*by, "_rng").agg(F.count(F.lit(1)).alias("_c"))
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(1))).orderBy("_rng")
    ahead = per.select(*by, "_rng", (F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).alias("_a"))
    inside = W.partitionBy(*by, "_rng").orderBy(order)
    return (
        tagged.join(ahead, [*by, "_rng"]).withColumn(out, F.row_number().over(inside) + F.col("_a")).drop("_rng", "_a")
    )


def small_map(df: DataFrame, key: str, value: Column) -> Column:
    """A keyed table of a few rows (one per fold, band or layer) as one map value.

    Looking a row up in it costs no join, so the big side is not shuffled by a key that
    has only a handful of values.
    """
    pair = F.struct(F.col(key).alias("k"), value.alias("v"))
    return df.agg(F.map_from_entries(F.collect_list(pair)).alias("m")).scalar()
