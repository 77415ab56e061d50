"""How well does a score rank events? Exact, tie-aware, and never one global sort task."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, reused
from .digests import Digests
from .ranking import average_ranks, histogram_of_values, percentiles, running_totals, seeded_order


def _score_table(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with running row and positive counts."""
    h = histogram_of_values(df.withColumn(score, F.col(score).cast("double")), score, by, pos=F.col(label).cast("long"))
    return running_totals(h, score, ["n", "pos"], by)


def auc_from_table(t: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rank = F.col("n_upto") - (F.col("n") - F.lit(1)) / F.lit(2.0)
    g = t.groupBy(*by).agg(
        F.sum(F.col("pos") * rank).alias("rs"), F.sum("pos").alias("n_pos"), (F.sum("n") - F.sum("pos")).alias("n_neg")
    )
    np_, nn = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    auc = F.when((np_ > 0) & (nn > 0), (F.col("rs") - np_ * (np_ + 1) / 2.0) / (np_ * nn))
    return g.select(*by, "n_pos", "n_neg", auc.alias("auc"))


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC with tie-averaged ranks and the half-width of its 95 % interval."""
    a = auc_from_table(_score_table(df, score, label, by), by)
    return a.withColumn("ci95", F.lit(1.96) * F.sqrt(F.col("auc") * (1 - F.col("auc")) / F.col("n_pos")))


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    t = _score_table(df, score, label, by)
    tp = F.col("pos_all") - F.col("pos_upto") + F.col("pos")
    seen = F.col("n_all") - F.col("n_upto") + F.col("n")
    return t.groupBy(*by).agg(F.sum(F.col("pos") / F.col("pos_all") * tp / seen).alias("average_precision"))


def precision_at(df: DataFrame, score: str, label: str, ids: Sequence[str], frac: float = 0.01, seed: int = 0) -> DataFrame:
    """Precision in the top fraction. Rows tied at the cut-off are taken in seeded order.

    The score table gives everything above the cut-off; only the tied score's rows are
    looked at one by one, and those are ordered inside hash buckets.
    """
    t = _score_table(df, score, label)
    k = F.greatest(F.lit(1), F.floor(F.lit(frac) * F.col("n_all")))
    above = F.col("n_all") - F.col("n_upto")
    cut = (
        t.where((above < k) & (k <= above + F.col("n")))
        .select(F.struct(F.col(score).alias("s"), k.alias("k"), (k - above).alias("rest"),
                         (F.col("pos_all") - F.col("pos_upto")).alias("tp")).alias("c"))
        .scalar()
    )
    tied = df.withColumn("_c", cut).where(F.col(score).cast("double") == F.col("_c.s"))
    taken = seeded_order(tied, ids, seed).where(F.col("pos") <= F.col("_c.rest"))
    return taken.agg(F.sum(label).alias("tied_hits"), F.first("_c").alias("c")).select(
        F.col("c.k").alias("k"), ((F.col("c.tp") + F.coalesce("tied_hits", F.lit(0))) / F.col("c.k")).alias("precision")
    )


def cv_report(df: DataFrame, score: str, label: str, fold: str) -> DataFrame:
    """Per-fold AUC and AP, their mean and population deviation, and the pooled values."""
    per = auc(df, score, label, [fold]).join(average_precision(df, score, label, [fold]), fold)
    summary = per.agg(
        F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"),
        F.avg("average_precision").alias("mean_ap"), F.count(F.lit(1)).alias("folds"),
    )
    return summary.withColumn("pooled_auc", auc(df, score, label).select("auc").scalar())


def percentile_operating_points(pos: DataFrame, neg: DataFrame, score: str, ps: Sequence[float]) -> DataFrame:
    """Thresholds at percentiles of the background; alert share, capture and lift at each."""
    neg = reused(neg.select(score))
    cuts = percentiles(neg, score, ps).select(F.array(*[f"p{i}" for i in range(len(ps))]).alias("c")).scalar()

    def shares(df: DataFrame) -> Column:
        x = df.where(F.col(score).isNotNull()).withColumn("_c", cuts)
        return x.agg(
            F.array(*[F.avg((F.col(score) >= F.col("_c")[i]).cast("double")) for i in range(len(ps))]).alias("s")
        ).scalar()

    one = neg.sparkSession.range(1).select(cuts.alias("threshold"), shares(neg).alias("alert"), shares(pos).alias("capture"))
    lv = F.array(*[F.lit(float(p)) for p in ps]).alias("percentile")
    z = one.select(F.explode(F.arrays_zip(lv, "threshold", "alert", "capture")).alias("z")).select("z.*")
    return z.withColumn("lift", F.when(F.col("alert") > 0, F.col("capture") / F.col("alert")).otherwise(0.0))


def auc_by_band(pos: DataFrame, neg: DataFrame, score: str, band: str, bands: Sequence[str], min_rows: int = 3) -> DataFrame:
    """AUC per accuracy band against a shared background; NULL for a band of fewer than ``min_rows`` positives.

    The background is reduced to its distinct scores before it is repeated per band.
    """
    p = pos.where(F.col(score).isNotNull()).groupBy(band, score).agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("pos"))
    n = (
        neg.where(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("pos"))
        .withColumn(band, F.explode(F.array(*[F.lit(b) for b in bands])))
    )
    merged = p.unionByName(n).groupBy(band, score).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    each = auc_from_table(running_totals(merged, score, ["n", "pos"], [band]), [band])
    return each.withColumn("auc", F.when(F.col("n_pos") >= min_rows, F.col("auc")))


def compare_models(df: DataFrame, scores: Sequence[str], label: str) -> DataFrame:
    melted = df.unpivot([label], list(scores), "model", "score")
    return auc(melted, "score", label, ["model"])


def channel_auc(df: DataFrame, scene: str, channels: Sequence[str], label: str) -> DataFrame:
    """Direction-free AUC per channel: max(a, 1 - a) per scene, averaged; best first."""
    melted = df.unpivot([scene, label], list(channels), "channel", "score")
    per = auc(melted, "score", label, [scene, "channel"])
    return per.groupBy("channel").agg(
        F.avg(F.greatest("auc", 1 - F.col("auc"))).alias("mean_auc"), F.count("auc").alias("scenes")
    )


# --- association --------------------------------------------------------------------


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with averaged ties; rows are reduced to distinct pairs first."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = average_ranks(rows, x).select(x, F.col("avg_rank").alias("rx"))
    ry = average_ranks(rows, y).select(y, F.col("avg_rank").alias("ry"))
    return pairs.join(rx, x).join(ry, y).agg(weighted_corr("rx", "ry", "w").alias("rho"), F.sum("w").alias("n"))


def weighted_corr(x: str, y: str, w: str) -> Column:
    sw, sx, sy = F.sum(w), F.sum(F.col(w) * F.col(x)), F.sum(F.col(w) * F.col(y))
    sxy = F.sum(F.col(w) * F.col(x) * F.col(y))
    sxx, syy = F.sum(F.col(w) * F.col(x) * F.col(x)), F.sum(F.col(w) * F.col(y) * F.col(y))
    den = F.sqrt((sw * sxx - sx * sx) * (sw * syy - sy * sy))
    return F.when(den > 0, (sw * sxy - sx * sy) / den)


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction."""
    ranks = average_ranks(df, value)
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("w"))
    per = counts.join(ranks.select(value, "avg_rank"), value).groupBy(group).agg(
        F.sum(F.col("w") * F.col("avg_rank")).alias("r"), F.sum("w").cast("double").alias("m")
    )
    t = F.col("n").cast("double")
    ties = ranks.agg(F.sum(t * t * t - t).alias("t")).scalar()
    g = per.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("q"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("groups"))
    g = g.withColumn("ties", ties)
    n = F.col("n")
    h = (F.lit(12.0) / (n * (n + 1)) * F.col("q") - F.lit(3.0) * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return g.select(h.alias("h"), "groups", n.cast("long").alias("n"))


PACKED_ROWS = 1 << 20  # rows of ids and two ranks that go through the driver, some 80 MB
BLOCK_ROWS = 1 << 13  # of those that a task reads from the shared folder, rows in one
HASHED = 1 << 15  # digests that are worked on at a time


def _digest_order(ids: Sequence[bytes], tail: bytes) -> np.ndarray:
    """Positions of ids by the MD5 of id and ``tail``, equal ones as they stand."""
    return Digests.of(ids, HASHED).order(tail)


def _rhos(ids: Digests, rx: np.ndarray, ry: np.ndarray, perms: Sequence[int], seed: int) -> list[float | None]:
    """The correlation of each permutation; ranks stand beside their ids."""
    if not len(rx):
        return [None] * len(perms)
    x, y = rx[ids.order(f"|x{seed}".encode())], ry - ry.mean()
    x = x - x.mean()
    scale = float(np.sqrt((x @ x) * (y @ y)))
    return [float(x @ y[ids.order(f"|{k}|{seed}".encode())]) / scale if scale > 0 else None for k in perms]


def _rho_batch(perms: Sequence[int], rho: Sequence[float | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(perms, pa.int64()), pa.array(rho, pa.float64())], names=["perm", "rho"])


def _in_order(ranked: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(id, rx, ry) by the ids themselves, which orders rows of equal digests."""
    t = ranked.select(F.concat_ws("|", *[F.col(c).cast("string") for c in ids]).alias("id"), "rx", "ry", *[F.col(c).alias(f"_o{k}") for k, c in enumerate(ids)])
    return t.orderBy(*[f"_o{k}" for k in range(len(ids))])


def _packed_null(ranked: DataFrame, ids: Sequence[str], n: int, seed: int) -> DataFrame:
    """(perm, rho) of all re-pairings: the ranks travel once, and a task works off its share of the permutations."""
    spark = ranked.sparkSession
    t = _in_order(ranked, ids).toArrow()
    sent = spark.sparkContext.broadcast(([i.encode() for i in t["id"].to_pylist()], *(t[c].to_numpy() for c in ("rx", "ry"))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rx, ry = sent.value
        perms = [k for b in batches for k in b.column(0).to_pylist()]
        yield _rho_batch(perms, _rhos(Digests.of(keys, HASHED), rx, ry, perms, seed))

    tasks = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(1, n + 1, 1, tasks).mapInArrow(run, "perm long, rho double")


def _blocks(rows: DataFrame) -> DataFrame:
    """(id, rx, ry) as rows of BLOCK_ROWS: their place (part, nr), the ids one after another, their sizes and the ranks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nr = TaskContext.get().partitionId(), 0
        for b in batches:
            for k in range(0, b.num_rows, BLOCK_ROWS):
                some = b.slice(k, BLOCK_ROWS)
                texts = [x.encode() for x in some.column(0).to_pylist()]
                packed = [b"".join(texts), np.array([len(x) for x in texts], "<i4").tobytes(), *(some.column(c).to_numpy().astype("<f8").tobytes() for c in (1, 2))]
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([nr]), *[pa.array([x], pa.binary()) for x in packed]], names=["part", "nr", "ids", "sizes", "rx", "ry"])
                nr += 1

    return rows.mapInArrow(run, "part long, nr long, ids binary, sizes binary, rx binary, ry binary")


def _shared_null(ranked: DataFrame, ids: Sequence[str], n: int, seed: int) -> DataFrame:
    """(perm, rho) as of :func:`_packed_null` when ranks are too many for the driver: every task reads them from the shared folder.

    Nothing is shuffled per permutation. A task holds the ranks of all rows, some 60 bytes a row.
    """
    spark = ranked.sparkSession
    blocks = reused(_blocks(_in_order(ranked, ids)), "ranks")
    tasks = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, held = set(), {}
        for b in batches:
            share, part, nr, *packed = b.columns
            shares.update(share.to_pylist())
            for k, at in enumerate(zip(part.to_pylist(), nr.to_pylist(), strict=True)):
                held[at] = [x[k].as_py() for x in packed]
        texts, sizes, rx, ry = (b"".join([held[at][k] for at in sorted(held)]) for k in range(4))
        held.clear()
        off = np.append(0, np.cumsum(np.frombuffer(sizes, "<i4").astype(np.int64)))
        all_ids = Digests(np.frombuffer(texts, np.uint8), off, HASHED)
        for share in sorted(shares):
            perms = list(range(1 + share, n + 1, tasks))
            yield _rho_batch(perms, _rhos(all_ids, np.frombuffer(rx, "<f8"), np.frombuffer(ry, "<f8"), perms, seed))

    shares = spark.range(0, tasks, 1, tasks).withColumnRenamed("id", "share")
    # a product of one row with all blocks in each task: neither side is broadcast or shuffled
    return shares.hint("shuffle_replicate_nl").crossJoin(blocks.coalesce(1)).mapInArrow(run, "perm long, rho double")


def permutation_null(df: DataFrame, ids: Sequence[str], x: str, y: str, n: int, seed: int = 0) -> DataFrame:
    """Rank correlations under ``n`` seeded re-pairings, beside the observed one.

    A permutation orders rows by the MD5 of their id, its number and the seed. Each task works
    off whole permutations with a vectorised kernel, so no row is sent once per permutation. Up
    to ``PACKED_ROWS`` rows, which are counted, are broadcast; more are written to the shared
    folder, and every task reads them there. Both give the same permutations. The hashing and
    ordering grow with rows times permutations; a task holds some 60 bytes a row.
    """
    rows = reused(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*ids, x, y))
    rx = average_ranks(rows, x).select(x, F.col("avg_rank").alias("rx"))
    ry = average_ranks(rows, y).select(y, F.col("avg_rank").alias("ry"))
    ranked = reused(rows.join(rx, x).join(ry, y).select(*ids, "rx", "ry"))
    null = (_packed_null if ranked.count() <= PACKED_ROWS else _shared_null)(ranked, ids, n, seed)
    obs = F.abs(ranked.agg(F.corr("rx", "ry").alias("r")).scalar())
    beyond = null.withColumn("obs", obs)
    return beyond.agg(
        F.first("obs").alias("observed"), F.avg((F.abs("rho") >= F.col("obs")).cast("double")).alias("share_beyond"),
        F.percentile(F.abs("rho"), 0.95).alias("null_p95"), F.count(F.lit(1)).alias("permutations"),
    )


def group_variance_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """1 - mean within-group sample variance / population variance of everything."""
    within = df.groupBy(group).agg(F.var_samp(value).alias("v")).agg(F.avg("v").alias("w"))
    return within.withColumn("total", df.agg(F.var_pop(value).alias("t")).scalar()).select(
        (1 - F.col("w") / F.col("total")).alias("explained")
    )


def ed_curve(storms: DataFrame, hours: str, rain: str, q: float = 0.10, most: int = 2000, tol: float = 1e-7, ridge: float = 1e-6) -> dict:
    """Quantile regression log10 E = a + b log10 D by reweighted least squares, run until it stands still.

    Events are reduced to distinct (D, E) pairs once; each step is a single aggregation of five
    weighted sums and a 2x2 solve. ``ridge`` is the least residual that a weight divides by.
    Raises an error if ``most`` steps do not bring the change of both coefficients under
    ``tol``. Returns a, b and the share on or above; NaN without events of two durations.
    """
    pts = durable(
        storms.where((F.col(hours) > 0) & (F.col(rain) > 0))
        .groupBy(F.log10(hours).alias("x"), F.log10(rain).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    )
    b0, b1, w = None, None, F.col("m")
    for step in range(most + 1):
        if step == most:
            raise RuntimeError(f"the quantile curve has not converged in {most} steps")
        s = pts.select(w.alias("w"), "x", "y").agg(
            F.sum("w"), F.sum(F.col("w") * F.col("x")), F.sum(F.col("w") * F.col("y")),
            F.sum(F.col("w") * F.col("x") * F.col("x")), F.sum(F.col("w") * F.col("x") * F.col("y")),
        ).first()
        sw, sx, sy, sxx, sxy = s
        if sw is None:
            break
        det = sw * sxx - sx * sx
        if abs(det) < 1e-300:
            break
        n1 = (sw * sxy - sx * sy) / det
        n0 = (sy - n1 * sx) / sw
        done = b0 is not None and max(abs(n0 - b0), abs(n1 - b1)) < tol
        b0, b1 = n0, n1
        if done:
            break
        r = F.col("y") - F.lit(b0) - F.lit(b1) * F.col("x")
        w = F.col("m") * F.when(r >= 0, F.lit(q)).otherwise(F.lit(1 - q)) / F.greatest(F.abs(r), F.lit(ridge))
    if b0 is None:
        return {"a": math.nan, "b": math.nan, "share_above": math.nan}
    above = pts.agg(
        (F.sum(F.when(F.col("y") >= F.lit(b0) + F.lit(b1) * F.col("x"), F.col("m")).otherwise(0.0)) / F.sum("m"))
    ).first()[0]
    return {"a": 10**b0, "b": b1, "share_above": above}


def ed_optimum(storms: DataFrame, hours: str, rain: str, q: float = 0.10, near: int = 24, rounds: int = 20) -> dict:
    """The exact optimum of :func:`ed_curve`: the line through two events with the least check loss, and its certificate.

    A quantile line of least loss runs through two events of different duration. From the
    smooth fit on, the ``near`` events closest to the line are joined in pairs and the losses of
    all those lines summed in one aggregation; the best one is taken on until none is better.
    ``certified`` says that the subgradient of the loss holds zero there, so that no other line
    at all is better. Returns a, b, loss and certified; NaN and False without two durations.
    """
    pts = durable(
        storms.where((F.col(hours) > 0) & (F.col(rain) > 0))
        .groupBy(F.log10(hours).alias("x"), F.log10(rain).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    )
    start = ed_curve(storms, hours, rain, q)
    b0, b1 = math.log10(start["a"]) if start["a"] > 0 else math.nan, start["b"]
    if math.isnan(b0) or math.isnan(b1):
        return {"a": math.nan, "b": math.nan, "loss": math.nan, "certified": False}

    def losses(lines: list[tuple[float, float]]) -> list[float]:
        each = F.posexplode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in lines]))
        r = F.col("y") - F.col("l.a") - F.col("l.b") * F.col("x")
        got = pts.select("x", "y", "m", each.alias("k", "l")).groupBy("k").agg(F.sum(F.col("m") * F.when(r >= 0, q * r).otherwise((q - 1) * r)).alias("s")).collect()
        return [s for _, s in sorted((g.k, g.s) for g in got)]

    best = None
    for _ in range(rounds):
        close = pts.orderBy(F.abs(F.col("y") - F.lit(b0) - F.lit(b1) * F.col("x")), "x", "y").limit(near).collect()
        pairs = [(u, v) for i, u in enumerate(close) for v in close[i + 1 :] if u.x != v.x]
        if not pairs:
            return {"a": math.nan, "b": math.nan, "loss": math.nan, "certified": False}
        lines = [(u.y - (v.y - u.y) / (v.x - u.x) * u.x, (v.y - u.y) / (v.x - u.x)) for u, v in pairs]
        loss, k = min((s, i) for i, s in enumerate(losses(lines)))
        if best is not None and loss >= best[0] - 1e-12 * max(1.0, abs(best[0])):
            break
        best, (b0, b1) = (loss, pairs[k]), lines[k]
    loss, (u, v) = best
    # on the line, an event pulls with any weight from q - 1 to q; the others' pull has to be balanced by those
    r = F.col("y") - F.lit(b0) - F.lit(b1) * F.col("x")
    on = F.abs(r) < 1e-9
    pull = F.when(on, 0.0).otherwise(F.when(r > 0, F.lit(q)).otherwise(F.lit(q - 1))) * F.col("m")
    g0, g1 = pts.agg(F.sum(pull), F.sum(pull * F.col("x"))).first()
    held = pts.where(on).select("x", "m").collect() if pts.where(on).count() <= 4096 else []
    return {"a": 10**b0, "b": b1, "loss": loss, "certified": _balanced(g0, g1, [(p.x, p.m) for p in held], q)}


def _balanced(g0: float, g1: float, held: list[tuple[float, float]], q: float, slack: float = 1e-6) -> bool:
    """Whether weights w in m * [q - 1, q] on the held events give sum w = -g0 and sum w x = -g1.

    With every weight at its lower end but some mass raised, the reachable second sums at a
    given first sum run from raising the smallest x first to raising the largest first.
    """
    low = sum(m for _, m in held) * (q - 1)
    room, target = sum(m for _, m in held), -g0 - low
    scale = slack * (1 + abs(g0) + abs(g1))
    if not -scale <= target <= room + scale:
        return False

    def raised(order: list[tuple[float, float]]) -> float:
        left, out = min(max(target, 0.0), room), 0.0
        for x, m in order:
            take = min(m, left)
            out, left = out + take * x, left - take
        return out

    base = sum(x * m for x, m in held) * (q - 1)
    return base + raised(sorted(held)) - scale <= -g1 <= base + raised(sorted(held, reverse=True)) + scale


# --- checks and verdicts ------------------------------------------------------------


def event_check(series: DataFrame, events: DataFrame, value: str, pass_at: float = 75.0) -> DataFrame:
    """Median on event days against all days of the same stations and months."""
    series = reused(series.select("station", "day", value))
    on_days = series.join(events.select("station", "day"), ["station", "day"])
    where_when = events.select("station", F.month("day").alias("month")).distinct()
    base = series.withColumn("month", F.month("day")).join(where_when, ["station", "month"], "left_semi")
    med_ev = percentiles(on_days, value, [0.5]).select("p0").scalar()
    med_base = percentiles(base, value, [0.5]).select("p0").scalar()
    ranked = base.where(F.col(value).isNotNull()).withColumn("_m", med_ev).agg(
        (F.avg((F.col(value) < F.col("_m")).cast("double")) * 100).alias("percentile"), F.first("_m").alias("event_median")
    )
    return ranked.withColumn("base_median", med_base).withColumn(
        "verdict", F.when(F.col("percentile") >= pass_at, "PASS").otherwise("FAIL")
    )


def detection(df: DataFrame, hit: Column, event: Column, negatives_are_known: bool) -> DataFrame:
    """Probability of detection; false-alarm ratio only where negatives are labelled."""
    pod = F.count_if(hit & event) / F.count_if(event)
    far = F.count_if(hit & ~event) / F.count_if(hit) if negatives_are_known else F.lit(None).cast("double")
    return df.agg(pod.alias("pod"), far.alias("far"))


def class_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of agreement and Cohen's kappa from the contingency counts."""
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    ra = n.groupBy(F.col(a).alias("k")).agg(F.sum("n").alias("na"))
    rb = n.groupBy(F.col(b).alias("k")).agg(F.sum("n").alias("nb"))
    chance = ra.join(rb, "k").agg(F.sum(F.col("na") * F.col("nb")).alias("c")).scalar()
    t = n.agg(F.sum("n").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0.0)).alias("same"))
    t = t.withColumn("pe", chance / (F.col("t") * F.col("t"))).withColumn("po", F.col("same") / F.col("t"))
    return t.select(F.col("po").alias("agreement"), ((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"), F.col("t").cast("long").alias("n"))


def success_rate(cells: DataFrame, cls: str, label: str) -> DataFrame:
    """Per class: share of area, share of known slides, and the lift between them."""
    per = cells.where(F.col(cls) > 0).groupBy(cls).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("k"))
    tot = per.agg(F.struct(F.sum("n").alias("n"), F.sum("k").alias("k")).alias("t")).scalar()
    x = per.withColumn("_t", tot)
    area, slides = F.col("n") / F.col("_t.n"), F.col("k") / F.col("_t.k")
    return x.select(cls, area.alias("area_share"), slides.alias("slide_share"), (slides / area).alias("lift"))


def point_check(points: DataFrame, cells: DataFrame, score: str, cls: str, level: int = 4) -> DataFrame:
    """Share of points in the high classes, its lift over area, and the median score."""
    at = points.join(cells.select("cell_id", score, cls), "cell_id").where(F.col(cls) > 0)
    area = cells.where(F.col(cls) > 0).agg(F.avg((F.col(cls) >= level).cast("double")).alias("a")).scalar()
    med = percentiles(at, score, [0.5]).select("p0").scalar()
    g = at.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(cls) >= level).cast("double")).alias("share_high"))
    return g.withColumn("lift", F.col("share_high") / area).withColumn("median_score", med)


def worst_year_agreement(events: DataFrame, rain: DataFrame) -> DataFrame:
    """How often a station's year with most events is its wettest, against chance."""
    ev = events.groupBy("station", F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("k"))
    wet = rain.groupBy("station", F.year("day").alias("year")).agg(F.sum("mm").alias("k"))

    def worst(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("station").agg(
            F.min_by("year", F.struct((-F.col("k")).alias("k"), "year")).alias(name), F.count(F.lit(1)).alias(f"n_{name}")
        )

    j = worst(ev, "worst").join(worst(wet, "wettest"), "station")
    return j.agg(
        F.avg((F.col("worst") == F.col("wettest")).cast("double")).alias("agreement"),
        F.avg(F.lit(1.0) / F.col("n_wettest")).alias("chance"), F.count(F.lit(1)).alias("stations"),
    )


def share_within(distances: DataFrame, limit: float, dist: str = "dist") -> DataFrame:
    return distances.agg(F.avg((F.col(dist) <= limit).cast("double")).alias("share_within"), F.count(F.lit(1)).alias("n"))
