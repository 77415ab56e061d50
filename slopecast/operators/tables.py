"""Joins with checks, legends, codes, hashes and other table housekeeping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


# --- fixed values: land-cover legend ---
LANDCOVER_NAMES = {
    10: "tree cover",
    20: "shrubland",
    30: "grassland",
    40: "cropland",
    50: "built-up",
    60: "bare / sparse",
    70: "snow and ice",
    80: "water",
    90: "herbaceous wetland",
    95: "mangroves",
    100: "moss and lichen",
}
# ----------------------------------------


def with_legend(df: DataFrame, code: str, names: Mapping[int, str], out: str = "name") -> DataFrame:
    """Names for codes through a literal map; an unknown code reads 'class <code>'."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return df.withColumn(
        out, F.coalesce(F.create_map(*pairs)[F.col(code)], F.concat(F.lit("class "), F.col(code).cast("string")))
    )


def join_one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """A left join that fails if either side repeats a key.

    The check rides on the join's own shuffle: both sides are aggregated by the key.
    """
    def unique(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        g = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
        dup = F.raise_error(F.concat(F.lit(f"repeated key on the {side}: "), F.col(key).cast("string")))
        ok = F.when(F.col("_n") == 1, F.col(key)).otherwise(dup.cast(df.schema[key].dataType))
        return g.select(ok.alias(key), *rest)

    return unique(a, "left").join(unique(b, "right"), key, "left")


def category_codes(df: DataFrame, c: str, out: str) -> DataFrame:
    """Sorted distinct categories coded 1..n; NULL is 0. The window sees one row per category."""
    cats = df.where(F.col(c).isNotNull()).select(c).distinct()
    coded = cats.withColumn(out, F.row_number().over(W.partitionBy(F.lit(1)).orderBy(c)))
    return df.join(coded, c, "left").fillna(0, [out])


def membership_hash(df: DataFrame, cols: Sequence[str], buckets: int = 4096) -> DataFrame:
    """A hash of row membership that does not depend on row order.

    Rows are hashed, sorted and digested inside 4,096 hash buckets; the bucket digests
    (a fixed number) are digested again, so no task ever holds the table.
    """
    row = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    keyed = df.select(F.sha2(row, 256).alias("h"))
    per = keyed.groupBy(F.substring("h", 1, 3).alias("b")).agg(
        F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("h"))), 256).alias("d")
    )
    top = per.agg(F.sort_array(F.collect_list(F.concat("b", F.lit(":"), "d"))).alias("a"))
    return top.select(F.substring(F.sha2(F.concat_ws("\n", "a"), 256), 1, 16).alias("sha16"))


def dropout_counts(events: DataFrame, steps: Sequence[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """How many rows survive each successive semi-join."""
    spark = events.sparkSession
    out = events.agg(F.lit(0).alias("step"), F.lit("all").alias("name"), F.count(F.lit(1)).alias("n"))
    cur = events
    for i, (name, table, on) in enumerate(steps, 1):
        cur = cur.join(table, on, "left_semi")
        out = out.unionByName(cur.agg(F.lit(i).alias("step"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")))
    return out


def coalesce_columns(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Fold spellings of the same column into one."""
    out = df
    for name, spellings in groups.items():
        have = [c for c in spellings if c in df.columns]
        merged = F.coalesce(*[F.col(c) for c in have])
        out = out.withColumn("_m", merged).drop(*have).withColumnRenamed("_m", name)
    return out


def union_sources(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def checks(named: Mapping[str, DataFrame]) -> DataFrame:
    """One row per check: each frame yields a single count of offending rows."""
    out = None
    for name, d in named.items():
        row = d.agg(F.count(F.lit(1)).alias("offending")).select(F.lit(name).alias("check"), "offending")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ok", (F.col("offending") == 0).cast("int"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).count().where(F.col("count") > 1)


def stale_rows(df: DataFrame, expected: Column, actual: Column) -> DataFrame:
    return df.where(~expected.eqNullSafe(actual))
