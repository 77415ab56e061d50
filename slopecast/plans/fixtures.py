"""Hazard-shaped tables derived from the driver's Parquet with plain DataFrame code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lattice import cell_id
from ..operators import rain as R
from ..operators.ranking import row_numbers
from ..operators.series import rain_series


class Tables:
    """Lazily built fixture tables over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    # rain -------------------------------------------------------------------------
    def rain_obs(self) -> DataFrame:
        return R.daily_totals(self.raw("lineitem"), "l_suppkey", "l_shipdate", "l_quantity")

    def readings(self) -> DataFrame:
        """What :meth:`rain_obs` adds up. Series add up a station's day themselves, so they take these: a day is then hashed once, not three times."""
        return self.raw("lineitem").select(F.col("l_suppkey").alias("station"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("mm"))

    def rain(self) -> DataFrame:
        return R.densify(self.readings())

    def storms(self) -> DataFrame:
        """Storm runs on every day of the calendar; only observed days are shuffled and sorted."""
        return rain_series(self.readings(), (), peak=None, wet_window=None, decay=None)

    def rolled(self) -> DataFrame:
        return rain_series(self.readings(), (1, 3, 7), peak=None, wet_window=None, decay=None, curve=None)

    def stations(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("station"),
            (F.lit(26.85) + F.lit(0.3) * F.pmod(k, F.lit(10))).alias("lat"),
            (F.lit(91.65) + F.lit(0.3) * F.floor(k / 10)).alias("lon"),
        )

    def n_stations(self):
        return self.raw("supplier").agg(F.count(F.lit(1)).alias("n")).scalar()

    def oni(self) -> DataFrame:
        ym = R.calendar(self.readings()).select(F.year("day").alias("year"), F.month("day").alias("month")).distinct()
        odd = ym.where(F.col("month") != 12)
        return odd.withColumn("oni", (F.pmod(F.col("year") * 12 + F.col("month"), F.lit(7)) - 3) / F.lit(2.0))

    # lattice ----------------------------------------------------------------------
    def width(self):
        p = self.raw("part")
        return p.agg((F.floor(F.sqrt(F.max("p_partkey").cast("double"))) + 1).cast("int").alias("w")).scalar()

    def cells(self) -> DataFrame:
        p = self.raw("part").withColumn("_w", self.width())
        row = F.floor(F.col("p_partkey") / F.col("_w")).cast("int")
        col = F.pmod(F.col("p_partkey"), F.col("_w")).cast("int")
        brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
        elev = F.col("p_retailprice") + F.lit(20.0) * F.col("p_size")
        return p.select(
            cell_id(row, col).alias("cell_id"),
            row.alias("row"),
            col.alias("col"),
            elev.alias("elev"),
            (F.lit(10) * (F.lit(1) + brand % 10)).alias("lc"),
            F.col("p_type").alias("lith"),
            (F.col("p_size").cast("double") * F.lit(0.9)).alias("slope"),
            F.col("p_partkey").alias("partkey"),
            F.col("p_name").alias("pname"),
        )

    def _part_cells(self) -> DataFrame:
        """Cell key of each part key, by arithmetic: no join needed."""
        li = self.raw("lineitem").withColumn("_w", self.width())
        row = F.floor(F.col("l_partkey") / F.col("_w")).cast("int")
        col = F.pmod(F.col("l_partkey"), F.col("_w")).cast("int")
        return li.withColumn("cell_id", cell_id(row, col)).withColumn("row", row).withColumn("col", col)

    def flags(self) -> DataFrame:
        hit = (F.col("l_quantity") == 50) & (F.col("l_returnflag") == "R")
        return self._part_cells().where(hit).select("cell_id", "row", "col").distinct()

    def sources(self) -> DataFrame:
        hit = (F.col("l_quantity") == 50) & (F.col("l_discount") > 0.085)
        return (
            self._part_cells().where(hit)
            .select("cell_id", "row", "col", F.pmod(F.col("l_linenumber"), F.lit(4)).alias("bit"))
            .distinct()
        )

    def cell_rain(self) -> DataFrame:
        n = self.n_stations()
        code = F.floor(F.col("row") / 5) * 10 + F.floor(F.col("col") / 5)
        return self.cells().withColumn("_n", n).withColumn("rain_id", F.pmod(code, F.col("_n"))).drop("_n")

    def labelled(self) -> DataFrame:
        """Cells with a slide label: at least one inventory marks them."""
        lab = self.sources().select("cell_id").distinct().withColumn("label", F.lit(1))
        return self.cells().join(lab, "cell_id", "left").fillna(0, ["label"])

    # events -----------------------------------------------------------------------
    def events(self) -> DataFrame:
        o = self.raw("orders").withColumn("_n", self.n_stations())
        acc = F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderstatus") == "O", "1km").otherwise("5km")
        return o.select(
            F.col("o_orderkey").alias("event_id"),
            F.to_date("o_orderdate").alias("day"),
            F.pmod(F.col("o_custkey"), F.col("_n")).alias("station"),
            acc.alias("accuracy"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("size"),
            F.col("o_custkey").alias("custkey"),
            F.col("o_totalprice").alias("amount"),
        )

    # catchments -------------------------------------------------------------------
    def basins(self) -> DataFrame:
        k = F.col("c_custkey")
        return (
            self.raw("customer").withColumn("_n", self.n_stations())
            .select(
                k.alias("basin"),
                F.when(k == 0, F.lit(-1)).otherwise(F.floor((k - 1) / 2)).cast("long").alias("next_down"),
                (F.lit(1) + F.pmod(k, F.lit(97))).cast("double").alias("sub_area"),
                F.pmod(k, F.col("_n")).alias("rain_pt"),
            )
        )

    def chain_basins(self) -> DataFrame:
        return self.basins().withColumn("next_down", F.col("basin") - 1)

    # geometry ---------------------------------------------------------------------
    def verts(self) -> DataFrame:
        """Square polygons of side 8 on a 10-wide pitch; even ones have a hole of side 2."""
        s = self.raw("supplier").select(F.col("s_suppkey").alias("fid"))
        x0 = F.pmod(F.col("fid"), F.lit(10)) * 10.0
        y0 = F.floor(F.col("fid") / 10) * 10.0

        def ring(part: int, lo: float, side: float):
            pts = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
            return F.array(
                *[
                    F.struct(
                        F.lit(part).alias("part"),
                        F.lit(i).alias("seq"),
                        (x0 + F.lit(lo + side * a)).alias("x"),
                        (y0 + F.lit(lo + side * b)).alias("y"),
                    )
                    for i, (a, b) in enumerate(pts)
                ]
            )

        hole = F.when(F.pmod(F.col("fid"), F.lit(2)) == 0, ring(1, 3.25, 2.0))
        all_pts = F.coalesce(F.concat(ring(0, 0.25, 8.0), hole), ring(0, 0.25, 8.0))
        return s.select("fid", F.explode(all_pts).alias("v")).select("fid", "v.*")

    def lines(self) -> DataFrame:
        o = row_numbers(self.raw("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_orderkey", ["o_custkey"], "seq")
        return o.select(
            F.col("o_custkey").alias("fid"),
            F.col("seq").cast("int").alias("seq"),
            (F.lit(92.0) + F.pmod(F.col("o_orderkey"), F.lit(1000)) / F.lit(10000.0)).alias("x"),
            (F.lit(27.0) + F.pmod(F.floor("o_totalprice"), F.lit(1000)) / F.lit(10000.0)).alias("y"),
        ).withColumn("part", F.lit(0))

    def pieces(self) -> DataFrame:
        o = row_numbers(self.raw("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_orderkey", ["o_custkey"], "seq")
        return o.select(
            F.col("o_custkey").alias("road_id"),
            "seq",
            (F.lit(1.0) + F.pmod(F.col("o_orderkey"), F.lit(3))).alias("km"),
            F.pmod(F.col("o_orderkey"), F.lit(6)).cast("int").alias("cls"),
            (F.lit(27.0) + F.pmod(F.floor("o_totalprice"), F.lit(1000)) / F.lit(1000.0)).alias("lat"),
            (F.lit(92.0) + F.pmod(F.col("o_orderkey"), F.lit(1000)) / F.lit(1000.0)).alias("lon"),
        )

    def places(self) -> DataFrame:
        return self.cells().select(
            F.col("partkey").alias("place_id"),
            F.col("pname").alias("name"),
            (F.lit(27.0) + F.col("row") * F.lit(0.01)).alias("lat"),
            (F.lit(92.0) + F.col("col") * F.lit(0.01)).alias("lon"),
            F.lit("town").alias("kind"),
        )

    def scenes(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("scene_id"),
            F.col("user_id").alias("site"),
            F.to_date("ts").alias("day"),
            F.pmod(F.floor("value"), F.lit(101)).cast("int").alias("cloud"),
            F.when(F.pmod(F.col("event_id"), F.lit(2)) == 0, "asc").otherwise("desc").alias("orbit"),
            F.col("event_type").alias("mode"),
        )

    def scores(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            (F.col("l_returnflag") == "R").cast("int").alias("label"),
            (F.col("l_quantity") / F.lit(50.0)).alias("score"),
            F.pmod(F.col("l_suppkey"), F.lit(5)).cast("int").alias("fold"),
        )
