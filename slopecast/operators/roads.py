"""Roads: pieces, hotspots, network edges, components, shortest distances, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..config import KM_PER_DEG_LAT, KM_PER_DEG_LON, METRES_PER_DEG, SNAP_M
from ..session import durable, reused
from .spatial import edges

STRETCH = 4096


def seg_km(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = (x2 - x1) * F.lit(KM_PER_DEG_LON), (y2 - y1) * F.lit(KM_PER_DEG_LAT)
    return F.sqrt(dx * dx + dy * dy)


def chainage(lines: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Segments with the distance along the line at both ends and the line's length.

    Distances are summed inside stretches of the line and the stretch totals are summed
    once more, so no single task walks a whole line.
    """
    e = edges(lines, stretch).withColumn("km", seg_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).withColumn(
        "_s", F.floor(F.col("seq") / stretch).cast("long")
    )
    tot = e.groupBy("fid", "part", "_s").agg(F.sum("km").alias("_t"))
    w = W.partitionBy("fid", "part")
    ahead = tot.select(
        "fid", "part", "_s",
        (F.sum("_t").over(w.orderBy("_s").rowsBetween(W.unboundedPreceding, 0)) - F.col("_t")).alias("_a"),
        F.sum("_t").over(w).alias("length"),
    )
    inside = W.partitionBy("fid", "part", "_s").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    j = e.join(ahead, ["fid", "part", "_s"]).withColumn("to_km", F.sum("km").over(inside) + F.col("_a"))
    return j.withColumn("from_km", F.col("to_km") - F.col("km")).drop("_s", "_a")


def _positions(seg: DataFrame, first: Column, last: Column, at: Column) -> DataFrame:
    """Points interpolated on each segment at indices first..last; ``at`` maps index to km."""
    x = seg.withColumn("_lo", first.cast("long")).withColumn("_hi", last.cast("long")).where("_lo <= _hi").withColumn(
        "j", F.explode(F.sequence("_lo", "_hi"))
    )
    t = F.when(F.col("km") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (at - F.col("from_km")) / F.col("km")))).otherwise(0.0)
    return x.withColumn("at_km", at).withColumn("px", F.col("x1") + t * (F.col("x2") - F.col("x1"))).withColumn(
        "py", F.col("y1") + t * (F.col("y2") - F.col("y1"))
    )


def chunk_lines(lines: DataFrame, step_km: float = 1.0) -> DataFrame:
    """Equal pieces of each line: (fid, part, piece, km, lat, lon of the middle of the piece's ends).

    Every segment works out which cut marks fall on it, and each mark is handed to the two
    pieces it bounds: no join between cuts and vertices, no window over a line.
    """
    seg = chainage(lines).where(F.col("length") > 0).withColumn(
        "n", F.greatest(F.lit(1), F.bround(F.col("length") / F.lit(step_km))).cast("long")
    )
    unit = F.col("length") / F.col("n")
    is_last = F.col("to_km") >= F.col("length") - F.lit(1e-9)
    hi = F.when(is_last, F.col("n")).otherwise(F.ceil(F.col("to_km") / unit) - 1)
    marks = _positions(seg, F.ceil(F.col("from_km") / unit), hi, F.col("j") * unit)
    sides = F.filter(
        F.array(F.struct(F.col("j").alias("piece")), F.struct((F.col("j") - 1).alias("piece"))),
        lambda s: (s["piece"] >= 0) & (s["piece"] < F.col("n")),
    )
    return (
        marks.select("fid", "part", "n", "length", "j", "px", "py", F.explode(sides).alias("s"))
        .dropDuplicates(["fid", "part", "j", "s"])
        .groupBy("fid", "part", F.col("s.piece").alias("piece"))
        .agg(
            F.first(F.col("length") / F.col("n")).alias("km"), F.avg("py").alias("lat"), F.avg("px").alias("lon"),
        )
    )


def densify(lines: DataFrame, step_km: float = 0.5) -> DataFrame:
    """Even spacing along each line, start included, end excluded: (fid, part, km, lat, lon)."""
    seg = chainage(lines).where(F.col("length") > 0)
    lo = F.ceil(F.col("from_km") / F.lit(step_km))
    hi = F.ceil(F.col("to_km") / F.lit(step_km)) - 1
    m = _positions(seg, lo, hi, F.col("j") * F.lit(step_km))
    return m.dropDuplicates(["fid", "part", "j"]).select("fid", "part", "j", F.col("at_km").alias("km"), F.col("py").alias("lat"), F.col("px").alias("lon"))


def sample_classes(pieces: DataFrame, cells: DataFrame, cls: str = "cls") -> DataFrame:
    """Class under each piece; off the lattice it is 0, and the piece stays."""
    return pieces.join(cells.select("cell_id", cls), "cell_id", "left").withColumn(cls, F.coalesce(F.col(cls), F.lit(0)))


def hotspots(pieces: DataFrame, min_class: int = 4, stretch: int = STRETCH) -> DataFrame:
    """Maximal runs of high-class pieces within one road.

    Only high pieces take part. Runs are found inside stretches of the road, then runs
    that touch across a stretch boundary are joined up: the second step sees runs, not pieces.
    """
    high = pieces.where(F.col("cls") >= min_class).withColumn("_s", F.floor(F.col("seq") / stretch))
    k = F.col("seq") - F.row_number().over(W.partitionBy("road_id", "_s").orderBy("seq"))
    runs = high.withColumn("_i", k).groupBy("road_id", "_s", "_i").agg(
        F.min("seq").alias("a"), F.max("seq").alias("b"), F.sum("km").alias("km"), F.max("cls").alias("peak"),
        F.sum("lat").alias("slat"), F.sum("lon").alias("slon"), F.count(F.lit(1)).alias("n"),
    )
    w = W.partitionBy("road_id").orderBy("a")
    fresh = F.coalesce((F.col("a") != F.lag("b").over(w) + 1).cast("int"), F.lit(1))
    joined = runs.withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return joined.groupBy("road_id", "_g").agg(
        F.min("a").alias("first_piece"), F.sum("n").alias("pieces"), F.sum("km").alias("km"), F.max("peak").alias("peak"),
        (F.sum("slat") / F.sum("n")).alias("lat"), (F.sum("slon") / F.sum("n")).alias("lon"),
    ).drop("_g")


def exposure(pieces: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Kilometres per class; class 0 is left out."""
    return pieces.where(F.col("cls") > 0).groupBy(*by, "cls").agg(F.sum("km").alias("km"))


# --- network ------------------------------------------------------------------------

NODE_BASE = 10_000_000


def node_key(lat: Column, lon: Column, snap_m: float = SNAP_M) -> Column:
    q = F.lit(snap_m / METRES_PER_DEG)
    return (F.bround(lat / q) * F.lit(NODE_BASE) + F.bround(lon / q)).cast("long")


def build_edges(lines: DataFrame, snap_m: float = SNAP_M) -> DataFrame:
    """Undirected edges between snapped vertices: loops dropped, the shortest duplicate kept."""
    e = edges(lines)
    a, b = node_key(F.col("y1"), F.col("x1"), snap_m), node_key(F.col("y2"), F.col("x2"), snap_m)
    one = e.select(
        F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), seg_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("km")
    ).where(F.col("u") != F.col("v")).groupBy("u", "v").agg(F.min("km").alias("km"))
    both = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))
    return one.select(both.alias("e"), "km").select("e.src", "e.dst", "km")


def node_positions(lines: DataFrame, snap_m: float = SNAP_M) -> DataFrame:
    """Where each node sits: its last vertex in file order."""
    k = node_key(F.col("y"), F.col("x"), snap_m)
    return lines.groupBy(k.alias("node")).agg(F.max_by(F.struct("y", "x"), F.struct("fid", "part", "seq")).alias("p")).select(
        "node", F.col("p.y").alias("lat"), F.col("p.x").alias("lon")
    )


def components(e: DataFrame) -> DataFrame:
    """Smallest node id of each connected component, by min-label hooking with shortcuts.

    Every round offers a label to both an edge's end and that end's current label holder,
    then jumps one pointer, so long chains shrink geometrically. One reliable checkpoint
    per round; the loop ends when the label total stops falling.
    """
    total = F.sum(F.col("label").cast("decimal(38,0)"))
    lab = durable(e.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    before = lab.agg(total).first()[0]
    while True:
        a = lab.select(F.col("node").alias("src"), F.col("label").alias("ls"))
        b = lab.select(F.col("node").alias("dst"), F.col("label").alias("ld"))
        met = e.select("src", "dst").join(a, "src").join(b, "dst")
        offers = met.select(
            F.explode(F.array(F.struct(F.col("dst").alias("node"), F.col("ls").alias("label")),
                              F.struct(F.col("ld").alias("node"), F.col("ls").alias("label")))).alias("o")
        ).select("o.node", "o.label")
        best = lab.unionByName(offers).groupBy("node").agg(F.min("label").alias("label"))
        hop = best.select(F.col("node").alias("label"), F.col("label").alias("up"))
        lab = durable(best.join(hop, "label").select("node", F.col("up").alias("label")))
        after = lab.agg(total).first()[0]
        if after == before:
            return lab
        before = after


def component_shares(labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("components"), F.sum("n").alias("nodes"), (F.max("n") / F.sum("n")).alias("largest_share")
    )


def chains(e: DataFrame, stops: DataFrame) -> DataFrame:
    """Every directed edge followed through nodes that merely pass it on: (src, first, last, dst, km).

    A node passes on if it has two neighbours and is not in ``stops`` (node). ``first`` is the
    neighbour an edge leads to, ``dst`` the first node that does not pass on, ``last`` the one
    before it, ``km`` the whole length. Reach doubles each round. Rings that nothing stops on
    are left out: no path from a stop leads there.
    """
    two = e.groupBy("src").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").select(F.col("src").alias("dst"))
    passing = two.join(stops.select(F.col("node").alias("dst")), "dst", "left_anti").withColumn("open", F.lit(True))
    cols = ["src", "first", "last", "dst", "km", "open"]
    now = e.join(passing, "dst", "left").select("src", F.col("dst").alias("first"), F.col("src").alias("last"), "dst", "km", F.coalesce("open", F.lit(False)).alias("open"))
    now = durable(now)
    most = max(2, now.count()).bit_length() + 1
    for _ in range(most):
        ahead = now.where("open")
        if ahead.isEmpty():
            break
        onward = now.select(F.col("src").alias("dst"), F.col("first").alias("_f"), F.col("last").alias("_l"), F.col("dst").alias("_d"), F.col("km").alias("_k"), F.col("open").alias("_o"))
        step = ahead.join(onward, "dst").where(F.col("_f") != F.col("last")).select(
            "src", "first", F.col("_l").alias("last"), F.col("_d").alias("dst"), (F.col("km") + F.col("_k")).alias("km"), F.col("_o").alias("open"))
        now = durable(now.where("not open").select(*cols).unionByName(step.select(*cols)))
    return now.where("not open").drop("open")


OFFERS = 1 << 22  # of a round; more are sent from the nearest nodes first
FRONT = 1 << 18  # distances that are sent to every task, 8 MB; links then stay where they are


def shortest_distances(e: DataFrame, origins: DataFrame, before: bool = True) -> DataFrame:
    """Kilometres from each origin to every reachable node, with the node before it (``prev``) unless ``before`` is False.

    Nodes between junctions are contracted first, so a round crosses a whole stretch of road and
    only junctions, ends and origins have a state. In the rounds only nodes improved since they
    last did send offers, and one hash aggregation of plain doubles keeps the best offer per
    (origin, node), so a dense network's offers are never sorted; each round is checkpointed. A
    round of more than ``OFFERS`` goes to the nearest of these nodes alone, an eighth at least: the others are
    improved further before they send. An origin that has reached every node takes nothing beyond the
    farthest. ``prev`` is looked up once, at the end. The nodes on stretches come last, from the two ends of theirs.
    """
    starts = origins.select("node").distinct()
    every = chains(e, starts)
    inner = e.groupBy("src").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").select("src").join(starts.select(F.col("node").alias("src")), "src", "left_anti")
    ends = every.join(inner, "src", "left_anti").where("src <> dst")
    least = ends.groupBy("src", "dst")
    if before:
        short = least.agg(F.min(F.struct("km", "last")).alias("m")).select("src", "dst", "m.km", "m.last")
    else:
        short = least.agg(F.min("km").alias("km"))
    # links are few bytes, but each makes an offer per origin: dealt to all cores by number, not by size
    tasks = 2 * e.sparkSession.sparkContext.defaultParallelism
    short = reused(short.repartition(tasks, "src"), "links")
    links, nodes = short.count(), short.select("src").union(short.select("dst")).distinct().count()
    state = durable(starts.select(F.col("node").alias("origin"), "node", F.lit(0.0).alias("km"), F.lit(None).cast("double").alias("old")))
    while True:
        asks = F.col("old").isNull() | (F.col("km") < F.col("old"))  # old: what it last sent from
        waiting = state.where(asks)
        n = waiting.count()
        if not n:
            break
        front = waiting.select("origin", F.col("node").alias("src"), F.col("km").alias("_d"))
        reach = F.col("_d") + F.col("km")
        useful = F.lit(True)
        if n * links > OFFERS * nodes:
            nearest = waiting.agg(F.percentile_approx("km", max(0.125, OFFERS * nodes / (n * links)))).first()[0]
            asks = asks & (F.col("km") <= nearest)
            far = state.groupBy("origin").agg(F.max("km").alias("_far"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == nodes)
            front = front.where(F.col("_d") <= nearest).join(far.select("origin", "_far"), "origin", "left")
            useful = F.col("_far").isNull() | (reach < F.col("_far"))
        front = F.broadcast(front) if n <= FRONT else front.repartition(tasks, "src").hint("shuffle_hash")
        met = front.join(short, "src").where(useful)
        offers = met.select("origin", F.col("dst").alias("node"), reach.alias("km"), F.lit(None).cast("double").alias("old"))
        told = state.withColumn("old", F.when(asks, F.col("km")).otherwise(F.col("old")))
        state = durable(told.unionByName(offers).groupBy("origin", "node").agg(F.min("km").alias("km"), F.min("old").alias("old")))
    state = state.drop("old")
    between = every.join(inner, "src").select(F.col("src").alias("node"), "first", "dst", F.col("km").alias("_d"))
    met = between.join(state.select("origin", F.col("node").alias("dst"), "km"), "dst")
    if not before:
        best = met.groupBy("origin", "node").agg(F.min(F.col("km") + F.col("_d")).alias("km"))
        return state.select("origin", "node", "km").unionByName(best)
    there = state.select("origin", F.col("node").alias("dst"), F.col("km").alias("_to"))
    ways = state.select("origin", F.col("node").alias("src"), F.col("km").alias("_d")).join(short, "src").join(there, ["origin", "dst"])
    ways = ways.where((F.col("origin") != F.col("dst")) & (F.col("_d") + F.col("km") == F.col("_to")))
    prev = ways.groupBy("origin", F.col("dst").alias("node")).agg(F.min("last").alias("prev"))
    best = met.groupBy("origin", "node").agg(F.min(F.struct((F.col("km") + F.col("_d")).alias("km"), F.col("first").alias("prev"))).alias("m"))
    return state.join(prev, ["origin", "node"], "left").select("origin", "node", "km", "prev").unionByName(best.select("origin", "node", "m.km", "m.prev"))


def route_profile(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Elevation and class along densified lines; points carry ``cell_id``."""
    j = points.join(cells.select("cell_id", "elev", "cls"), "cell_id", "left")
    return j.withColumn("cls", F.coalesce("cls", F.lit(0)))


def route_summary(profile: DataFrame, step_km: float) -> DataFrame:
    """Per line: length sampled, highest point, km at High and above, worst km mark."""
    return profile.groupBy("fid").agg(
        (F.count(F.lit(1)) * F.lit(step_km)).alias("km"), F.max("elev").alias("top_elev"),
        (F.count_if(F.col("cls") >= 4) * F.lit(step_km)).alias("high_km"),
        F.min_by("km", F.struct((-F.col("cls")).alias("c"), "km")).alias("worst_at_km"), F.max("cls").alias("worst_cls"),
    )
