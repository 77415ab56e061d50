"""Writers: cell tables, reports, CSV exports, forecast archive."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import qualified


def write_grid(cells: DataFrame, path: str) -> None:
    """Cell table as Parquet + zstd, one directory per fold.

    Rows are clustered by fold and spread inside it by cell, so a fold that holds a
    third of all cells is still written by many tasks.
    """
    (
        cells.repartition("fold", F.pmod(F.xxhash64("cell_id"), F.lit(64)))
        .sortWithinPartitions("fold", "cell_id")
        .write.mode("overwrite").partitionBy("fold").option("compression", "zstd").parquet(path)
    )


def read_grid(spark: SparkSession, path: str, folds: list[int] | None = None, exclude: bool = False) -> DataFrame:
    """All, some, or all-but-some folds; unread folds are pruned before the scan."""
    df = spark.read.parquet(path)
    if folds is None:
        return df
    keep = F.col("fold").isin(*folds)
    return df.where(~keep if exclude else keep)


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def to_report(df: DataFrame, path: str) -> None:
    """Aggregated report rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_each(df: DataFrame, path: str, folder: str, line: str) -> int:
    """Each row of ``df`` as a text file of one line in its folder under ``path``; returns how many.

    Tasks write the files themselves: Spark's committer moves every file once more and lists
    every folder, one after another in the driver. A name is the row's place in its input, so a task
    that runs again writes the same files; the rows are then dealt to all tasks.
    """
    spark = df.sparkSession
    root = qualified(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", root))
        made = set()
        for b in batches:
            for k, f, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if f not in made:
                    fs.create_dir(f"{base}/{folder}={f}", recursive=True)
                    made.add(f)
                with fs.open_output_stream(f"{base}/{folder}={f}/part-{k}.txt") as out:
                    out.write(((text or "") + "\n").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["files"])

    rows = df.select(F.monotonically_increasing_id().alias("_k"), folder, F.col(line).cast("string"))
    spread = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_k")
    return spread.mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def export_points(df: DataFrame, x: str, y: str, tag: Column) -> DataFrame:
    """Centroids rounded to four decimals with a short source tag."""
    return df.select(F.round(x, 4).alias("lon"), F.round(y, 4).alias("lat"), tag.alias("src"))


def append_forecast(forecast: DataFrame, path: str, issued: str, version: str) -> None:
    """Append-only archive, partitioned by issue date, with the input version on every row."""
    (
        forecast.withColumn("issued", F.lit(issued).cast("date")).withColumn("input_version", F.lit(version))
        .write.mode("append").partitionBy("issued").parquet(path)
    )


def outcomes(archive: DataFrame, events: DataFrame) -> DataFrame:
    """Each archived forecast with 1 if something happened there that day."""
    e = events.withColumn("_e", F.lit(1))
    return archive.join(e, ["station", "day"], "left").withColumn("happened", F.coalesce("_e", F.lit(0))).drop("_e")


def prefix_tag(c: Column, prefixes: dict[str, str], other: str) -> Column:
    """Short tag by the first matching prefix."""
    out = F.lit(other)
    for p, tag in reversed(list(prefixes.items())):
        out = F.when(c.startswith(p), tag).otherwise(out)
    return out
