"""Operators against brute force and on edge tables."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopecast.config import FIXTURE_GRID
from slopecast.functions import classify as C
from slopecast.functions import lattice as L
from slopecast.functions import text as X
from slopecast.operators import catchment, evaluate, labels, places, rain, ranking, roads, spatial, tables, terrain
from slopecast.sources import ingest, sinks


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(df):
    return df.first().asDict()


def obs(spark, data):
    return spark.createDataFrame(data, "station long, day string, mm double").withColumn("day", F.to_date("day"))


# --- lattice -----------------------------------------------------------------------


def test_cell_round_trip(spark):
    d = spark.createDataFrame([(0, 0), (0, 5899), (3199, 0), (3199, 5899), (17, 93)], "row int, col int")
    d = d.withColumn("id", L.cell_id(F.col("row"), F.col("col")))
    back = d.select("row", "col", L.decode_row(F.col("id")), L.decode_col(F.col("id")),
                    L.row_of(L.centre_y(F.col("row"))), L.col_of(L.centre_x(F.col("col"))))
    for r, c, r1, c1, r2, c2 in rows(back):
        assert (r, c) == (r1, c1) == (r2, c2)


def test_points_off_the_grid_are_not_clamped(spark):
    d = spark.createDataFrame([(-1.0, 1.0), (150.0, -150.0)], "x double, y double")
    r, c = L.row_of(F.col("y"), FIXTURE_GRID), L.col_of(F.col("x"), FIXTURE_GRID)
    assert rows(d.select(r, c, L.in_grid(r, c, FIXTURE_GRID))) == [(-1, -1, False), (1, 1, True)]


def test_classes_at_breaks_and_null(spark):
    d = spark.createDataFrame([(None,), (-0.0,), (0.02,), (0.299,), (0.30,)], "v double")
    assert [r[0] for r in rows(d.select(C.classify(F.col("v"), (0.02, 0.06, 0.15, 0.30))))] == [0, 1, 2, 4, 5]
    assert [r[0] for r in rows(d.select(C.classify_positive(F.col("v"), (0.04, 0.10, 0.20, 0.33))))] == [0, 0, 1, 4, 4]


def test_break_pct_is_searchsorted(spark):
    rng = np.random.default_rng(1)
    b = np.sort(rng.integers(0, 40, 101).astype(float))
    v = [float(x) for x in range(-1, 42)] + [None]
    d = spark.createDataFrame([(x,) for x in v], "v double").withColumn("b", F.array(*[F.lit(float(x)) for x in b]))
    got = [r[0] for r in rows(d.select(C.break_pct(F.col("v"), F.col("b"))))]
    want = [min(np.searchsorted(b, x, "left") / 100, 1.0) if x is not None else None for x in v]
    assert got == want


# --- rain --------------------------------------------------------------------------


def test_densify_fills_every_day_for_every_station(spark):
    d = rain.densify(obs(spark, [(1, "2020-01-03", 2.0), (2, "2020-01-01", 1.0), (2, "2020-01-05", 4.0)]))
    got = {(s, str(x)): m for s, x, m in rows(d)}
    assert len(got) == 10 and got[(1, "2020-01-03")] == 2.0 and got[(1, "2020-01-05")] == 0.0 and got[(2, "2020-01-05")] == 4.0


def test_densify_empty_and_single(spark):
    assert rain.densify(obs(spark, [])).count() == 0
    assert rain.densify(obs(spark, [(1, "2020-01-03", 2.0)])).count() == 1


def series(spark, mm):
    days = [np.datetime64("2000-01-01") + i for i in range(len(mm))]
    return obs(spark, [(1, str(d), m) for d, m in zip(days, mm)])


def test_antecedent_index_over_several_blocks(spark):
    rng = np.random.default_rng(2)
    mm = [float(x) for x in rng.gamma(0.3, 20, 1300)]
    got = [r[0] for r in rows(rain.antecedent_index(series(spark, mm)).orderBy("day").select("api"))]
    acc, want = 0.0, []
    for m in mm:
        acc = m + 0.92 * acc
        want.append(acc)
    assert got[:29] == [None] * 29
    assert np.allclose(got[29:], want[29:], rtol=1e-12)


def test_storms_and_ratio(spark):
    mm = [0.0, 2.0, 3.0, 1.0, None, 5.0]
    s = rain.storms(series(spark, mm)).orderBy("day")
    assert rows(s.select("storm_dur", "storm_rain")) == [(0, 0.0), (1, 2.0), (2, 5.0), (0, 0.0), (0, 0.0), (1, 5.0)]
    r = rows(s.select(rain.id_ratio(F.col("storm_dur"), F.col("storm_rain"))))
    assert r[0][0] == 0.0 and math.isclose(r[2][0], (5 / 48) / (2.2 * 48 ** -0.44))


def test_trailing_sums_gate_and_missing(spark):
    t = rain.trailing_sums(series(spark, [1.0, None, 3.0, 4.0]), (1, 3)).orderBy("day")
    assert rows(t.select("r1", "r3")) == [(1.0, None), (None, None), (3.0, 4.0), (4.0, 7.0)]


def test_season_percentile_all_tied_is_zero(spark):
    d = obs(spark, [(1, f"2020-06-{i:02d}", 5.0) for i in range(1, 11)])
    t = rain.trigger(rain.trailing_sums(rain.densify(d), (3, 7)))
    assert {r[0] for r in rows(t.select("trigger"))} == {0.0}


def test_forecast_days_falls_back_to_the_past(spark):
    d = rain.calendar(obs(spark, [(1, "2020-01-01", 0.0), (1, "2020-01-20", 0.0)]))
    ahead = sorted(str(r[0]) for r in rows(rain.forecast_days(d, F.lit("2020-01-18").cast("date"))))
    assert ahead == ["2020-01-18", "2020-01-19", "2020-01-20"]
    past = sorted(str(r[0]) for r in rows(rain.forecast_days(d, F.lit("2021-01-01").cast("date"))))
    assert past[0] == "2020-01-14" and len(past) == 7


# --- ranks, percentiles, AUC -------------------------------------------------------


def test_percentiles_match_numpy_with_ties_and_nulls(spark):
    rng = np.random.default_rng(3)
    v = [float(x) for x in rng.integers(0, 50, 3000)] + [None] * 7
    d = spark.createDataFrame([(x,) for x in v], "v double")
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = rows(ranking.percentiles(d, "v", ps))[0]
    assert got[0] == 3000
    assert np.allclose(got[1:], np.percentile([x for x in v if x is not None], [100 * p for p in ps]))


def test_percentiles_of_nothing(spark):
    d = spark.createDataFrame([], "v double")
    assert rows(ranking.percentiles(d, "v", [0.5]))[0] == (None, None)


@pytest.mark.parametrize("scores,labels_,want", [
    ([1, 2, 3, 4], [0, 0, 1, 1], 1.0), ([4, 3, 2, 1], [0, 0, 1, 1], 0.0), ([5, 5, 5, 5], [0, 1, 0, 1], 0.5),
])
def test_auc_extremes(spark, scores, labels_, want):
    d = spark.createDataFrame([(float(s), y) for s, y in zip(scores, labels_)], "score double, label int")
    assert one(evaluate.auc(d, "score", "label"))["auc"] == want


def test_auc_without_positives_is_null(spark):
    d = spark.createDataFrame([(1.0, 0), (2.0, 0)], "score double, label int")
    assert one(evaluate.auc(d, "score", "label"))["auc"] is None


def test_auc_of_negated_score_is_the_complement(spark):
    rng = random.Random(4)
    d = spark.createDataFrame([(rng.randrange(20) / 20, rng.randrange(2)) for _ in range(800)], "score double, label int")
    a = one(evaluate.auc(d, "score", "label"))["auc"]
    b = one(evaluate.auc(d.withColumn("score", -F.col("score")), "score", "label"))["auc"]
    assert math.isclose(a + b, 1.0, abs_tol=1e-12)


def test_seeded_order_is_a_permutation_per_group(spark):
    d = spark.range(5000).withColumn("g", (F.col("id") % 3 == 0).cast("int"))
    o = ranking.seeded_order(d, ["id"], 9, ["g"])
    for g in (0, 1):
        pos = sorted(r[0] for r in rows(o.where(F.col("g") == g).select("pos")))
        assert pos == list(range(1, len(pos) + 1))


def test_row_numbers_with_one_dominant_group(spark):
    d = spark.range(3000).select((F.lit(100000) - F.col("id") * 7).alias("k"), F.when(F.col("id") < 2500, "hot").otherwise("cold").alias("g"))
    got = rows(ranking.row_numbers(d, "k", ["g"]).select("g", "k", "rn"))
    for g in ("hot", "cold"):
        part = sorted((k, n) for gg, k, n in got if gg == g)
        assert [n for _, n in part] == list(range(1, len(part) + 1))


def test_first_per_key_keeps_the_first(spark):
    d = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 5, None)], "k int, o int, v string")
    assert sorted(rows(ranking.first_per_key(d, ["k"], [F.col("o")]).select("k", "o", "v"))) == [(1, 1, "a"), (2, 5, None)]


def test_quantile_curve_is_the_best_line(spark):
    """A best line of quantile regression passes through two of the points, so trying all pairs finds the least loss."""
    rng = np.random.default_rng(5)
    dur = rng.integers(1, 12, 60).astype(float) * 24
    tot = np.round(3 * dur**0.6 * rng.lognormal(0, 0.5, 60), 3)
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(dur, tot)], "h double, e double")
    fit = evaluate.ed_curve(d, "h", "e", 0.10)
    x, y = np.log10(dur), np.log10(tot)

    def loss(a, b):
        r = y - a - b * x
        return np.where(r >= 0, 0.10 * r, -0.90 * r).sum()

    best = min(loss(y[i] - s * x[i], s) for i in range(60) for j in range(i) if x[i] != x[j] for s in [(y[i] - y[j]) / (x[i] - x[j])])
    assert loss(math.log10(fit["a"]), fit["b"]) <= best * 1.001
    assert 0.8 < fit["share_above"] <= 1.0


def test_operating_points_rise_and_fall(spark):
    d = spark.createDataFrame([(i / 100,) for i in range(100)], "trigger double")
    from slopecast.operators.aggregates import alerts_and_capture

    t = rows(alerts_and_capture(d, d.where("trigger > 0.5"), [0.5, 0.9, 2.0]).orderBy("threshold"))
    assert [r[3] for r in t][-1] == 0.0 and t[0][1] > t[1][1]


# --- trees and networks ------------------------------------------------------------


def tree(spark, pairs):
    return spark.createDataFrame(pairs, "node long, down long")


def test_accumulate_deep_chain_and_star(spark):
    n = 300
    e = tree(spark, [(i, i - 1) for i in range(n)])
    got = dict(rows(catchment.accumulate(e, e.select("node", F.lit(1.0).alias("v")), ["v"])))
    assert got == {i: float(n - i) for i in range(n)}
    s = tree(spark, [(0, -1)] + [(i, 0) for i in range(1, n)])
    got = dict(rows(catchment.accumulate(s, s.select("node", F.lit(1.0).alias("v")), ["v"])))
    assert got[0] == float(n) and got[5] == 1.0


def test_accumulate_constant_mean_is_constant(spark):
    b = spark.createDataFrame([(i, (i - 1) // 2 if i else -1, float(1 + i % 7)) for i in range(200)], "basin long, next_down long, sub_area double")
    m = catchment.upstream_mean(b, b.select("basin", F.lit(0.25).alias("v")), ["v"])
    assert all(math.isclose(r[0], 0.25) for r in rows(m.select("v")))


def test_accumulate_refuses_a_cycle(spark):
    e = tree(spark, [(0, 1), (1, 0)])
    with pytest.raises(ValueError):
        catchment.accumulate(e, e.select("node", F.lit(1.0).alias("v")), ["v"])


def random_graph(spark, n=60, m=70, seed=6):
    rng = random.Random(seed)
    e = {}
    for _ in range(m):
        a, b = rng.sample(range(n), 2)
        e[(a, b)] = e[(b, a)] = rng.randrange(1, 20) / 4
    return e, spark.createDataFrame([(a, b, k) for (a, b), k in e.items()], "src long, dst long, km double")


def test_components_match_union_find(spark):
    e, df = random_graph(spark, 80, 60)
    parent = {x: x for ab in e for x in ab}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert dict(rows(roads.components(df).select("node", "label"))) == {x: find(x) for x in parent}


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(200)]
    df = spark.createDataFrame([(a, b) for p in pairs for a, b in (p, p[::-1])], "src long, dst long")
    assert {r[0] for r in rows(roads.components(df).select("label"))} == {0}


def test_shortest_distances_match_dijkstra(spark):
    e, df = random_graph(spark)
    adj = {}
    for (a, b), k in e.items():
        adj.setdefault(a, []).append((b, k))
    origins = sorted(adj)[:2]
    got = {(o, n): k for o, n, k, _ in rows(roads.shortest_distances(df, spark.createDataFrame([(o,) for o in origins], "node long")))}
    want = {}
    for o in origins:
        dist, pq = {o: 0.0}, [(0.0, o)]
        while pq:
            d, u = heapq.heappop(pq)
            if d > dist[u]:
                continue
            for v, k in adj[u]:
                if d + k < dist.get(v, 1e18):
                    dist[v] = d + k
                    heapq.heappush(pq, (d + k, v))
        want.update({(o, n): k for n, k in dist.items()})
    assert got == want


# --- lines -------------------------------------------------------------------------


def zigzag(spark, n=23, seed=7):
    rng = random.Random(seed)
    pts = [(0, i, 92 + rng.random() / 20, 27 + rng.random() / 20) for i in range(n)]
    return pts, spark.createDataFrame([(1, p, s, x, y) for p, s, x, y in pts], "fid long, part int, seq int, x double, y double")


@pytest.mark.parametrize("stretch", [4, 4096])
def test_chainage_is_the_same_however_the_line_is_cut(spark, stretch):
    pts, df = zigzag(spark)
    xy = np.array([(x, y) for _, _, x, y in pts])
    d = np.hypot(np.diff(xy[:, 0]) * 98.9, np.diff(xy[:, 1]) * 110.6)
    got = rows(roads.chainage(df, stretch).orderBy("seq").select("to_km", "length"))
    assert np.allclose([g[0] for g in got], np.cumsum(d)) and math.isclose(got[0][1], d.sum())


def test_pieces_match_interpolation(spark):
    pts, df = zigzag(spark)
    xy = np.array([(x, y) for _, _, x, y in pts])
    cum = np.r_[0, np.cumsum(np.hypot(np.diff(xy[:, 0]) * 98.9, np.diff(xy[:, 1]) * 110.6))]
    n = max(1, round(cum[-1] / 1.0))
    cuts = np.linspace(0, cum[-1], n + 1)
    px, py = np.interp(cuts, cum, xy[:, 0]), np.interp(cuts, cum, xy[:, 1])
    got = rows(roads.chunk_lines(df, 1.0).orderBy("piece").select("km", "lat", "lon"))
    assert len(got) == n
    assert np.allclose([g[0] for g in got], np.diff(cuts))
    assert np.allclose([g[1] for g in got], (py[1:] + py[:-1]) / 2) and np.allclose([g[2] for g in got], (px[1:] + px[:-1]) / 2)


def test_a_line_of_no_length_gives_no_pieces(spark):
    df = spark.createDataFrame([(1, 0, 0, 5.0, 5.0), (1, 0, 1, 5.0, 5.0)], "fid long, part int, seq int, x double, y double")
    assert roads.chunk_lines(df).count() == 0


@pytest.mark.parametrize("stretch", [3, 4096])
def test_hotspot_runs_cross_stretch_boundaries(spark, stretch):
    cls = [5, 4, 4, 4, 4, 1, 4, 0, 5, 5]
    df = spark.createDataFrame([(1, i + 1, 1.0, c, 27.0, 92.0) for i, c in enumerate(cls)], "road_id long, seq long, km double, cls int, lat double, lon double")
    got = sorted(rows(roads.hotspots(df, stretch=stretch).select("first_piece", "pieces", "km", "peak")))
    assert got == [(1, 5, 5.0, 5), (7, 1, 1.0, 4), (9, 2, 2.0, 5)]


# --- space -------------------------------------------------------------------------


def test_nearest_when_most_points_sit_in_one_far_cluster(spark):
    rng = random.Random(8)
    right = [(i, 900 + rng.random() * 3, 900 + rng.random() * 3) for i in range(1500)]
    right += [(2000 + i, rng.random() * 400, rng.random() * 400) for i in range(12)]
    left = [(i, rng.random() * 1000, rng.random() * 1000) for i in range(150)]
    l = spark.createDataFrame(left, "pid long, x double, y double")
    r = spark.createDataFrame(right, "rid long, rx double, ry double")
    d = F.sqrt(F.pow(F.col("x") - F.col("rx"), 2) + F.pow(F.col("y") - F.col("ry"), 2))
    n = spatial.nearest(l, r, "pid", ["rid"], (F.col("x"), F.col("y")), (F.col("rx"), F.col("ry")), 0.5, d, light=8)
    got = {p: (i, k) for p, i, k in rows(n)}
    for p, x, y in left:
        best = min((math.hypot(x - a, y - b), i) for i, a, b in right)
        assert got[p][0] == best[1] and math.isclose(got[p][1], best[0])


def test_nearest_with_ties_and_a_single_point(spark):
    l = spark.createDataFrame([(1, 0.0, 0.0), (2, -50.0, 7.0)], "pid long, x double, y double")
    r = spark.createDataFrame([(9, 1.0, 0.0), (3, -1.0, 0.0)], "rid long, rx double, ry double")
    d = F.sqrt(F.pow(F.col("x") - F.col("rx"), 2) + F.pow(F.col("y") - F.col("ry"), 2))
    args = ("pid", ["rid"], (F.col("x"), F.col("y")), (F.col("rx"), F.col("ry")), 1.0, d)
    assert sorted(rows(spatial.nearest(l, r, *args).select("pid", "rid"))) == [(1, 3), (2, 3)]
    assert rows(spatial.nearest(l, r.where("rid = 9"), *args).select("pid", "rid").orderBy("pid")) == [(1, 9), (2, 9)]
    assert spatial.nearest(l, r.where("rid = 0"), *args).count() == 0


def lattice(spark, h, w):
    return spark.createDataFrame([(r * 100000 + c, r, c) for r in range(h) for c in range(w)], "cell_id long, row int, col int")


def test_distance_matches_brute_force(spark):
    rng = random.Random(9)
    flags = sorted({(rng.randrange(30), rng.randrange(40)) for _ in range(15)})
    f = spark.createDataFrame(flags, "row int, col int")
    got = {c: (d, r, k) for c, d, r, k in rows(terrain.nearest_flag(lattice(spark, 30, 40), f))}
    for r in range(30):
        for c in range(40):
            d2, fr, fc = min(((r - a) ** 2 + (c - b) ** 2, a, b) for a, b in flags)
            g = got[r * 100000 + c]
            assert (g[1], g[2]) == (fr, fc) and math.isclose(g[0], math.sqrt(d2))


def test_distance_without_flags_is_null(spark):
    f = spark.createDataFrame([], "row int, col int")
    assert {r[1] for r in rows(terrain.nearest_flag(lattice(spark, 3, 3), f))} == {None}


def test_gradient_across_tiles(spark):
    cells = lattice(spark, 20, 20).withColumn("elev", F.col("row") * 3.0 + F.col("col") * F.col("col"))
    z = np.array([[r * 3.0 + c * c for c in range(20)] for r in range(20)])
    dy, dx = np.gradient(z, 100.0)
    t = terrain.core_only(terrain.add_gradient(terrain.with_halo(cells, 1, size=7), "elev", 100.0, "p", "q"))
    for r, c, p, q in rows(t.select("row", "col", "p", "q")):
        assert math.isclose(p, dx[r, c], abs_tol=1e-12) and math.isclose(q, -dy[r, c], abs_tol=1e-12)


def test_polygon_fill_with_hole(spark):
    ring = lambda p, lo, hi: [(1, p, i, x, y) for i, (x, y) in enumerate([(lo, lo), (hi, lo), (hi, hi), (lo, hi), (lo, lo)])]
    v = spark.createDataFrame(ring(0, 0.0, 10.0) + ring(1, 3.0, 7.0), "fid long, part int, seq int, x double, y double")
    assert spatial.fill_polygons(v).count() == 100 - 16
    m = one(spatial.geometry_measures(v))
    assert (m["area"], m["parts"], m["cx"]) == (84.0, 2, 5.0)


def test_snap_radius_and_none(spark):
    p = spark.createDataFrame([(1, 0, 0), (2, 500, 500)], "pid long, row int, col int")
    c = spark.createDataFrame([(10, 10), (0, 11)], "row int, col int")
    got = sorted(rows(spatial.snap_within(p, c, "pid", 10)))
    assert got[0][1:3] == (10, 10) and got[1][1:] == (None, None, None)


# --- labels, tables, places, files -------------------------------------------------


def test_negatives_stop_at_the_pool(spark):
    d = spark.range(60).withColumn("fold", (F.col("id") % 2).cast("int"))
    s = labels.sample_negatives(d.where("id >= 10"), d.where("id < 10"), ["id"], 5, 1)
    assert dict(rows(s.groupBy("fold").count())) == {0: 25, 1: 25}
    s = labels.sample_negatives(d.where("id >= 50"), d.where("id < 10"), ["id"], 5, 1)
    assert s.count() == 10


def test_folds_cover_every_block(spark):
    b = spark.createDataFrame([(i, i // 6, i % 6, 10 if i % 5 else 1) for i in range(36)], "block long, block_row int, block_col int, n_cells long")
    f = rows(labels.make_folds(b, 5, 3).select("block", "fold", "is_sliver"))
    assert len(f) == 36 and {x[1] for x in f} <= set(range(5)) and sum(x[2] for x in f) == 8


def test_one_to_one_join_refuses_duplicates(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeated key"):
        tables.join_one_to_one(a, a.select("k", F.col("v").alias("w")).limit(1), "k").collect()


def test_membership_hash_ignores_order_and_sees_changes(spark):
    a = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    h = one(tables.membership_hash(a, ["id", "v"]))["sha16"]
    assert h == one(tables.membership_hash(a.orderBy(F.desc("id")).repartition(7), ["id", "v"]))["sha16"]
    assert h != one(tables.membership_hash(a.where("id < 99"), ["id", "v"]))["sha16"]


@pytest.mark.parametrize("text,want", [
    ("27.55, 94.21", (27.55, 94.21)), ("27.55N 94.21E", (27.55, 94.21)), ("lat 27.55 lon 94.21", (27.55, 94.21)),
    ("10S;20w", (-10.0, -20.0)), ("94.21 27.55", (27.55, 94.21)), ("100, 100", None), ("Old Town", None), ("27.5592.1", None), ("LAT: 10 / Long: -20", (10.0, -20.0)), ("1, 2, 3", None), ("10 N N 20", None), ("", None), ("27.5° 94.2°", (27.5, 94.2)),
])
def test_typed_coordinates(spark, text, want):
    d = spark.createDataFrame([(text,)], "t string")
    la, lo = X.parse_coords(F.col("t"))
    assert rows(d.select(la, lo))[0] == (want or (None, None))


def test_labels_are_unique(spark):
    t = spark.createDataFrame([(1, "A", 27.0, 92.0), (2, "A", 27.001, 92.001), (3, "A", 28.0, 92.0), (4, "B", 27.0, 92.0)], "place_id long, name string, lat double, lon double")
    got = dict(rows(places.label_places(t).select("place_id", "label")))
    assert got == {1: "A  (27.00°N 92.00°E)", 2: "A  (27.00°N 92.00°E) #2", 3: "A  (28.00°N 92.00°E)", 4: "B"}


def test_anchor_is_dropped_only_when_near(spark):
    t = spark.createDataFrame([("A", 27.0, 92.0)], "name string, lat double, lon double")
    a = spark.createDataFrame([("A", 27.01, 92.0), ("A", 29.0, 92.0), ("C", 27.0, 92.0)], "name string, lat double, lon double")
    lab = t.withColumn("label", F.col("name"))
    assert sorted(rows(places.merge_anchors(a, t, lab).select("label"))) == [("A (town)",), ("C",)]


def test_manifest_upsert_replaces_a_source(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "source string, name string, bytes long")
    new = spark.createDataFrame([("a", "z", 3)], "source string, name string, bytes long")
    assert sorted(rows(ingest.upsert_manifest(old, new))) == [("a", "z", 3), ("b", "y", 2)]


def test_grid_read_prunes_folds(spark, tmp_path):
    c = lattice(spark, 10, 10).withColumn("fold", (F.col("col") % 5).cast("int"))
    sinks.write_grid(c, str(tmp_path / "g"))
    d = sinks.read_grid(spark, str(tmp_path / "g"), [2])
    assert d.count() == 20
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "fold" in plan.split("PartitionFilters")[1][:80]


def test_filters_and_columns_reach_the_scan(spark):
    from slopecast.plans import all_queries

    plan = all_queries()["modelling_domain"].fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "p_name" not in plan.split("ReadSchema")[1][:120]


def test_a_neighbour_outside_the_set_is_an_outlet(spark):
    from slopecast.operators import catchment

    e = spark.createDataFrame([(1, 99), (2, 1), (3, 2), (4, None), (5, -1)], "node long, down long")
    v = spark.createDataFrame([(i, 1.0) for i in range(1, 6)], "node long, a double")
    assert sorted(rows(catchment.accumulate(e, v, ["a"]).select("node", "a"))) == [(1, 3.0), (2, 2.0), (3, 1.0), (4, 1.0), (5, 1.0)]


def test_upstream_means_are_exact(spark):
    from slopecast.operators import catchment

    b = spark.createDataFrame([(i, i - 1, float(1 + i % 7)) for i in range(200)], "basin long, next_down long, sub_area double")
    v = spark.createDataFrame([(i, (i * 37 % 201) / 200) for i in range(200)], "basin long, p double")
    got = {r.basin: (r.up_area, r.p) for r in catchment.upstream_mean(b.repartition(7), v.repartition(5), ["p"]).collect()}
    area = num = 0
    for i in reversed(range(200)):
        area, num = area + 1 + i % 7, num + (1 + i % 7) * (i * 37 % 201)
        assert got[i] == (area, num * 5000 / (area * 1_000_000))


def test_zero_and_dry_cells_come_back(spark):
    from slopecast.operators import hazard

    cells = spark.createDataFrame([(1, 127, 7), (2, 0, 7), (3, 50, None), (4, None, 7), (5, 60, 8)], "cell_id long, idx int, basin long")
    sig = spark.createDataFrame([(7, d, 1.0) for d in ("2020-01-01", "2020-01-02")], "basin long, day string, up_pct double")
    got = sorted(rows(hazard.flood_hazard(cells, sig).select("cell_id", "day", "hazard", "cls")), key=lambda r: (r[0], r[1]))
    assert [(r[0], r[2] and round(r[2], 3)) for r in got] == [(1, 0.5)] * 2 + [(2, 0.0)] * 2 + [(3, 0.0)] * 2 + [(4, 0.0)] * 2 + [(5, None)] * 2
    assert [r[3] for r in got] == [5, 5, 0, 0, 0, 0, 0, 0, 0, 0]
    land = spark.createDataFrame([(1, 10, 0.5), (2, 11, 0.5)], "cell_id long, rain_id long, susceptibility double")
    trig = spark.createDataFrame([(10, "2020-01-01", 1.0)], "station long, day string, trigger double")
    got = sorted(rows(hazard.landslide_hazard(land, trig).select("cell_id", "day", "hazard", "cls")))
    assert got == [(1, "2020-01-01", 0.5, 5), (2, "2020-01-01", None, 0)]


def test_slow_decay_loses_nothing(spark):
    mm = [float(i % 5) for i in range(3000)]
    for decay in (0.999, 0.3):
        got = [r[0] for r in rows(rain.antecedent_index(series(spark, mm), decay=decay).orderBy("day").select("api"))]
        api, want = 0.0, []
        for m in mm:
            api = m + decay * api
            want.append(api)
        assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got[29:], want[29:]))


def test_no_class_band_or_tag_disappears(spark):
    from slopecast.operators import aggregates, labels, profile
    from slopecast.sources import ingest

    d = spark.createDataFrame([(f"c{i}",) for i in range(60) for _ in range(i + 1)], "c string")
    top = rows(profile.top_classes(d, "c"))
    assert len(top) == 13 and sum(r[1] for r in top) == d.count() and math.isclose(sum(r[2] for r in top), 1)
    assert math.isclose(sum(r[2] for r in rows(aggregates.class_share(d, "c", 0.02))), 1)
    s = spark.createDataFrame([(i, 15.0, i % 2) for i in range(20)], "cell_id long, slope double, y int")
    assert labels.matched_controls(s, F.col("y") == 1, F.col("y") == 0, "slope", ["cell_id"]).count() == 20
    t = spark.createDataFrame([({"a": "x" * 500},)], "m map<string,string>")
    assert len(rows(t.select(ingest.prune_tags(F.col("m"))))[0][0]["a"]) == 500


# --- streams -----------------------------------------------------------------------


def test_a_daily_totals_query_reads_every_event(spark):
    """Beside the query with late readings, one has no reading left out."""
    from slopecast.plans import all_queries

    sf = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{sf}/events.parquet")
    want = e.groupBy(F.col("user_id").alias("station"), F.to_date("ts").cast("string").alias("day")).agg(F.round(F.sum("value"), 4).alias("mm"))
    got = all_queries()["stream_daily_totals"].fn(spark, sf)
    assert {(r.station, r.day): r.mm for r in got.collect()} == {(r.station, r.day): r.mm for r in want.collect()}


def test_deliveries_are_written_by_all_tasks(spark, tmp_path):
    """A delivery has a file of every partition of the events, and each delivery is a micro-batch."""
    from slopecast.plans import q_streaming as Q

    e = spark.range(4000).selectExpr("id AS event_id", "TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, id % 400) AS ts", "id % 7 AS user_id", "'view' AS event_type", "1.0D AS value")
    e.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    path, coming = Q.delivered(spark, str(tmp_path), late=True)
    for deliver in coming:
        deliver()
    files = {k: len(spark.read.parquet(f"{path}/{k}").inputFiles()) for k in "abcd"}
    assert files == {"a": 4, "b": 4, "c": 1, "d": 4}
    got = Q.stream_daily_totals(spark, str(tmp_path))
    assert got.count() == len({(i % 7, i % 400 // 24) for i in range(4000)}) and got.agg(F.sum("mm")).first()[0] == 4000
