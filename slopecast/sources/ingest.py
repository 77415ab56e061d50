"""Readers that turn delivered files into tidy tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from ..operators.ranking import first_per_key

# --- fixed values: middle month of each three-month season ---
SEASON_MIDDLE_MONTH = {
    "DJF": 1,
    "JFM": 2,
    "FMA": 3,
    "MAM": 4,
    "AMJ": 5,
    "MJJ": 6,
    "JJA": 7,
    "JAS": 8,
    "ASO": 9,
    "SON": 10,
    "OND": 11,
    "NDJ": 12,
}
# --------------------------------------------------------------

# how each type's coordinates nest, and how they become parts of rings of positions
_NESTING = {
    "Point": ("array<double>", lambda c: F.array(F.array(F.array(c)))),
    "MultiPoint": ("array<array<double>>", lambda c: F.transform(c, lambda p: F.array(F.array(p)))),
    "LineString": ("array<array<double>>", lambda c: F.array(F.array(c))),
    "MultiLineString": ("array<array<array<double>>>", lambda c: F.transform(c, lambda r: F.array(r))),
    "Polygon": ("array<array<array<double>>>", lambda c: F.array(c)),
    "MultiPolygon": ("array<array<array<array<double>>>>", lambda c: c),
}
PARTS = "array<array<array<array<double>>>>"


def _parts(kind: Column, coordinates: Column) -> Column:
    """Coordinates of any simple type as parts of rings of positions; null for other types."""
    out = F.lit(None).cast(PARTS)
    for name, (nesting, nest) in _NESTING.items():
        c = F.try_variant_get(coordinates, "$", nesting)
        out = F.when(kind == name, F.when(c.isNotNull(), nest(c).cast(PARTS))).otherwise(out)
    return out


def read_features(spark: SparkSession, path: str, properties: str, multi_line: bool = False) -> DataFrame:
    """Feature collections to one row per feature: properties.*, ``geom_type`` and ``parts``.

    ``parts`` nests every type alike: parts of rings of positions. A point is one part of one
    ring of one position, a line one part of one ring, a polygon one part whose first ring is
    the outer one; each member of a multi-geometry or of a collection is a part. A feature
    without geometry, of an unknown type or with coordinates that do not fit its type keeps
    its row and has null ``parts``. Collections may be one per line (any number per file, split
    across tasks) or one pretty-printed document per file (``multi_line``).
    """
    simple = "type string, coordinates variant"
    schema = f"features array<struct<properties struct<{properties}>, geometry struct<{simple}, geometries array<struct<{simple}>>>>>"
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    f = raw.select(F.explode("features").alias("f"))
    g = F.col("f.geometry")
    members = F.flatten(F.transform(g["geometries"], lambda m: _parts(m["type"], m["coordinates"])))
    parts = F.when(g["type"] == "GeometryCollection", members).otherwise(_parts(g["type"], g["coordinates"]))
    return f.select("f.properties.*", g["type"].alias("geom_type"), parts.alias("parts"))


def vertices(features: DataFrame, fid: str) -> DataFrame:
    """All geometries to one vertex table (fid, geom_type, member, ring, part, seq, x, y).

    ``member`` counts the parts of a geometry, ``ring`` the rings of a part (0 is the outer one),
    and ``part`` the rings of the whole feature, as the operators on vertex tables take them.
    """
    m = features.select(F.col(fid).alias("fid"), "geom_type", F.posexplode("parts").alias("member", "rings"), "parts")
    before = F.aggregate(F.slice("parts", F.lit(1), F.col("member")), F.lit(0), lambda n, p: n + F.size(p))
    r = m.select("fid", "geom_type", "member", before.alias("_before"), F.posexplode("rings").alias("ring", "path"))
    v = r.select("fid", "geom_type", "member", "ring", (F.col("_before") + F.col("ring")).alias("part"), F.posexplode("path").alias("seq", "xy"))
    return v.select("fid", "geom_type", "member", "ring", "part", "seq", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


def load_daily(spark: SparkSession, path: str, schema: str, pattern: str = r"(\d{8})") -> DataFrame:
    """Daily files to one table; the day comes from the file's path.

    Values are read as text and cast one by one: a value that does not fit its type is
    NULL and the row is marked ``bad`` = 1, so a damaged file never stops the job.
    """
    fields = T.StructType.fromDDL(schema).fields
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    raw = spark.read.schema(text).option("header", True).option("recursiveFileLookup", True).csv(path)
    day = F.to_date(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1), "yyyyMMdd")
    misfit = F.lit(False)
    for f in fields:
        misfit = misfit | (F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
    return raw.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields],
        day.alias("day"), (misfit | day.isNull()).cast("int").alias("bad"),
    )


def north_up_row(lat: Column, top: Column, res: float) -> Column:
    """Lattice row from latitude: nothing to flip once every value carries its coordinates."""
    return F.floor((top - lat) / F.lit(res)).cast("int")


def load_oni(spark: SparkSession, path: str) -> DataFrame:
    """Season, year, total, anomaly lines to (year, month, oni); other lines are skipped."""
    t = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t")).where(F.size("t") == 4)
    months = F.create_map(*[F.lit(x) for kv in SEASON_MIDDLE_MONTH.items() for x in kv])
    out = t.select(F.col("t")[1].try_cast("int").alias("year"), months[F.col("t")[0]].alias("month"), F.col("t")[3].try_cast("double").alias("oni"))
    return out.where(F.col("year").isNotNull() & F.col("month").isNotNull())


def load_points(spark: SparkSession, path: str, arrays: str = "station array<bigint>, lat array<double>, lon array<double>") -> DataFrame:
    """Columnar JSON arrays to rows."""
    raw = spark.read.schema(arrays).json(path)
    z = raw.select(F.explode(F.arrays_zip(*raw.columns)).alias("z"))
    return z.select("z.*")


def flatten_forecast(responses: DataFrame) -> DataFrame:
    """(station, daily{time[], precipitation_sum[]}) to (station, day, mm); missing rain is 0."""
    z = responses.select("station", F.explode(F.arrays_zip("daily.time", "daily.precipitation_sum")).alias("z"))
    return z.select("station", F.to_date("z.time").alias("day"), F.coalesce("z.precipitation_sum", F.lit(0.0)).alias("mm"))


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    schema = "station bigint, daily struct<time array<string>, precipitation_sum array<double>>"
    return flatten_forecast(spark.read.schema(schema).json(path))


def concat_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """Archive batches stacked; the first record per (station, day) wins."""
    out = None
    for i, b in enumerate(batches):
        part = b.select("station", "day", "mm").withColumn("batch", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return first_per_key(out, ["station", "day"], [F.col("batch"), F.col("mm")])


def dedupe_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_per_key(df, list(key), list(order))


def removed_count(before: DataFrame, after: DataFrame) -> DataFrame:
    kept = after.agg(F.count(F.lit(1)).alias("kept")).scalar()
    return before.agg(F.count(F.lit(1)).alias("n")).withColumn("kept", kept).withColumn("removed", F.col("n") - F.col("kept"))


def harvest_union(df: DataFrame, ids: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Overlapping tile harvest: one row per feature id, with fallback ids."""
    named = df.withColumn("feature_id", F.coalesce(*[F.col(c).cast("string") for c in ids]))
    return first_per_key(named.where(F.col("feature_id").isNotNull()), ["feature_id"], list(order))


def nearly_full_tiles(df: DataFrame, tile: str, cap: int, share: float = 0.9) -> DataFrame:
    """Tiles whose feature count is so near the server's cap that some may be missing."""
    return df.groupBy(tile).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cap * share)


def missing_days(days: DataFrame, start: Column, end: Column) -> DataFrame:
    """Days of the calendar that do not occur."""
    span = days.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("day"))
    return span.join(days.select("day").distinct(), "day", "left_anti")


def prefer_version(df: DataFrame, key: Sequence[str], version: str, order: Sequence[str]) -> DataFrame:
    """One row per key, from the most preferred version available."""
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(version))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    return first_per_key(df, list(key), [rank, F.col(version)])


def attrs_to_map(df: DataFrame, col: str) -> DataFrame:
    """A list of Name/Value structs to a map."""
    return df.withColumn(col, F.map_from_entries(F.transform(col, lambda a: F.struct(a["Name"], a["Value"]))))


def prune_tags(c: Column, longest: int | None = None) -> Column:
    """Drop tag values of ``longest`` characters or more; by default all stay."""
    if longest is None:
        return c
    return F.map_filter(c, lambda _, v: F.length(v) < longest)


def geometry_kind(nodes: Column) -> Column:
    """point, line or polygon: a closed way of four or more nodes is a polygon."""
    n = F.size(nodes)
    return F.when(n <= 1, "point").when((n >= 4) & (F.element_at(nodes, 1) == F.element_at(nodes, -1)), "polygon").otherwise("line")


# --- fixed values: bookkeeping columns that deliveries carry ---
NOISE_COLUMNS = (
    "OBJECTID",
    "objectid",
    "Shape_Leng",
    "Shape_Length",
    "Shape_Area",
    "GlobalID",
    "created_us",
    "created_da",
    "last_edite",
    "last_edi_1",
)
# ----------------------------------------------------------------


def drop_noise(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return df.drop(*NOISE_COLUMNS, *extra)


HEAD_BYTES = 1 << 24


def file_heads(spark: SparkSession, path: str, glob: str = "*", head: int = HEAD_BYTES) -> DataFrame:
    """(path, name, bytes, sha256_head) of every file; of its content only the first ``head`` bytes are read.

    Spark lists the files, whose content column is pruned; tasks then open each file, read one
    range and hash it piece by piece, so neither a file's size nor ``head`` matters to memory.
    Spark's listing leaves out empty files.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column(0).to_pylist():
                fs, inner = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", p))
                h, left = hashlib.sha256(), head
                with fs.open_input_stream(inner) as f:
                    while left and (piece := f.read(min(left, 1 << 20))):
                        h.update(piece)
                        left -= len(piece)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["path", "bytes", "sha256_head"])

    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    found = listed.select("path", F.col("length").alias("bytes")).mapInArrow(run, "path string, bytes long, sha256_head string")
    return found.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "bytes", "sha256_head")


def file_manifest(spark: SparkSession, path: str, source: str, glob: str = "*.parquet", head: int = HEAD_BYTES) -> DataFrame:
    """One provenance entry per file: source, name, size and hash of the first bytes."""
    return file_heads(spark, path, glob, head).select(F.lit(source).alias("source"), "name", "bytes", "sha256_head")


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the entries of every source that arrives again."""
    kept = old.join(new.select("source").distinct(), "source", "left_anti")
    return kept.unionByName(new)


def attach_provenance(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Provenance by file name, else by the name without its ``-clipped`` suffix."""
    base = F.regexp_replace("name", r"-clipped(?=\.|$)", "")
    m1 = manifest.select(F.col("name"), F.col("source").alias("_s1"))
    m2 = manifest.select(F.col("name").alias("_base"), F.col("source").alias("_s2"))
    j = files.join(m1, "name", "left").withColumn("_base", base).join(m2, "_base", "left")
    return j.withColumn("source", F.coalesce("_s1", "_s2")).drop("_s1", "_s2", "_base")


def unrecorded(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return attach_provenance(files, manifest).where(F.col("source").isNull())


def tiles_for_bbox(spark: SparkSession, west: int, south: int, east: int, north: int, step: int) -> DataFrame:
    """South-west corners of the tiles that cover a box."""
    lo = lambda v: (v // step) * step
    one = spark.range(1).select(F.explode(F.sequence(F.lit(lo(south)), F.lit(lo(north)), F.lit(step))).alias("lat"))
    return one.withColumn("lon", F.explode(F.sequence(F.lit(lo(west)), F.lit(lo(east)), F.lit(step))))
