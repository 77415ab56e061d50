"""Points, lines and polygons laid over each other, against the definitions."""

import math
import random

import pytest

from slopecast.operators import overlay as O

VERTS = "fid long, part int, seq int, x double, y double"


def rows_of(polygons):
    """{fid: [closed ring, ...]} as a vertex table."""
    return [(f, p, i, float(x), float(y)) for f, rings in polygons.items() for p, r in enumerate(rings) for i, (x, y) in enumerate(r)]


def square(x, y, a, b=None):
    b = a if b is None else b
    return [(x, y), (x + a, y), (x + a, y + b), (x, y + b), (x, y)]


def star(rng, cx, cy, r, n, grid):
    """A closed ring around a centre, its corners on a grid so that ties occur."""
    out = []
    for i in range(n):
        d, t = rng.uniform(0.3, 1) * r, 2 * math.pi * i / n
        out.append((round((cx + d * math.cos(t)) / grid) * grid, round((cy + d * math.sin(t)) / grid) * grid))
    return [*out, out[0]]


def contains(rings, x, y):
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(11)
    out = {i: [star(rng, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(0.4, 14), rng.randint(3, 30), 0.25)] for i in range(30)}
    for i in range(0, 30, 3):  # holes and islands, which may cross their outer ring
        out[i].append(star(rng, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(0.4, 6), rng.randint(3, 9), 0.25))
    out[100] = [star(rng, 0, 0, 30, 3000, 0.001)]  # more edges than an index entry holds
    out[101] = [square(-5, -5, 10), square(-3, -3, 6), square(-1, -1, 2)]
    return out


@pytest.mark.parametrize("tile", [0.5, 2.0, 3.7, 64.0])
def test_insides_match_ray_casting(spark, shapes, tile):
    rng = random.Random(12)
    points = [(rng.uniform(-30, 30), rng.uniform(-30, 30)) for _ in range(200)]
    points += [(rng.randint(-80, 80) / 4, rng.randint(-80, 80) / 4) for _ in range(400)]  # on corners, edges and tile borders
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "pid long, x double, y double")
    got = {(r.pid, r.fid) for r in O.inside(df, spark.createDataFrame(rows_of(shapes), VERTS), "pid", tile).collect()}
    assert got == {(i, f) for i, (x, y) in enumerate(points) for f, rings in shapes.items() if contains(rings, x, y)}


def test_index_is_linear_in_edges_and_tiles(spark):
    verts = spark.createDataFrame(rows_of({1: [square(0.5, 0.5, 199, 2)]}), VERTS)
    index = O.tile_index(verts, 1.0).collect()
    n_edges = sum(len(r.edges or ()) for r in index)
    assert n_edges <= 2 * (200 + 3) + 8  # no edge is copied to columns it does not pass through
    tall = O.tile_index(spark.createDataFrame(rows_of({1: [square(0.5, 0.5, 100)]}), VERTS), 1.0)
    assert tall.where("edges is null and odd = 1").count() <= 101 * 101


def clipped(a, b, rings):
    """Length of the segment a-b inside, by cutting it at every edge it crosses."""
    ts = {0.0, 1.0}
    for r in rings:
        for (u1, v1), (u2, v2) in zip(r, r[1:], strict=False):
            den = (b[0] - a[0]) * (v2 - v1) - (b[1] - a[1]) * (u2 - u1)
            if den:
                t = ((u1 - a[0]) * (v2 - v1) - (v1 - a[1]) * (u2 - u1)) / den
                if 0 < t < 1:
                    ts.add(t)
    cuts = sorted(ts)
    at = lambda t: (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
    return math.dist(a, b) * sum(t1 - t0 for t0, t1 in zip(cuts, cuts[1:], strict=False) if contains(rings, *at((t0 + t1) / 2)))


def test_clipped_lengths_match(spark, shapes):
    rng = random.Random(13)
    lines = {i: [[(rng.uniform(-25, 25), rng.uniform(-25, 25)) for _ in range(rng.randint(2, 6))]] for i in range(25)}
    lines[30] = [[(1, 1), (1, 1), (9, 9)]]  # a segment without length
    got = O.clip_lines(spark.createDataFrame(rows_of(lines), VERTS), spark.createDataFrame(rows_of(shapes), VERTS), 4.0).collect()
    have = {}
    for r in got:
        assert 0 <= r.t0 < r.t1 <= 1 and r.length == pytest.approx(math.dist((r.x0, r.y0), (r.x1, r.y1)))
        have[r.fid, r.seq, r.other] = have.get((r.fid, r.seq, r.other), 0) + r.length
    want = {}
    for i, (pts,) in lines.items():
        for k, (a, b) in enumerate(zip(pts, pts[1:], strict=False)):
            for f, rings in shapes.items():
                if (n := clipped(a, b, rings)) > 1e-9:
                    want[i, k, f] = n
    have = {k: v for k, v in have.items() if v > 1e-9}
    assert have.keys() == want.keys() and all(have[k] == pytest.approx(want[k]) for k in want)


def test_a_line_that_crosses_a_ring_three_times(spark):
    comb = [(0, 0), (7, 0), (7, 5), (6, 5), (6, 1), (4, 1), (4, 5), (0, 5), (0, 0)]
    line = {7: [[(-1, 3), (6.5, 3)]]}  # in, out, in again, and ends inside
    got = O.clip_lines(spark.createDataFrame(rows_of(line), VERTS), spark.createDataFrame(rows_of({1: [comb]}), VERTS), 2.0).orderBy("t0").collect()
    assert [(round(r.x0, 9), round(r.x1, 9), round(r.length, 9)) for r in got] == [(0, 4, 4), (6, 6.5, 0.5)]


def test_what_meets(spark):
    a = {1: [square(0, 0, 10), square(4, 4, 2)]}
    b = {
        11: [square(10.3, 0, 2)],  # beside it, in the same tile
        12: [square(4.5, 4.5, 1)],  # in its hole
        13: [square(4, 4, 2)],  # fills its hole: boundaries meet
        14: [square(1, 1, 1)],  # an island inside its ring
        15: [square(10, 10, 1)],  # touches a corner
        16: [square(-5, -5, 50)],  # holds it
        17: [square(-5, -5, 50), square(-1, -1, 12)],  # holds it in a hole
        18: [square(9, 9, 5)],  # crosses
        19: [[(-1, 5), (11, 5.5), (11, 5.6), (-1, 5)]],  # a sliver right across
    }
    va, vb = spark.createDataFrame(rows_of(a), VERTS), spark.createDataFrame(rows_of(b), VERTS)
    for tile in (1.0, 16.0):
        assert {r.other for r in O.intersecting(va, vb, tile).collect()} == {13, 14, 15, 16, 18, 19}
        assert {r.fid for r in O.intersecting(vb, va, tile).collect()} == {13, 14, 15, 16, 18, 19}
    r = O.intersection_counts(vb, va, 4.0).first()
    assert (r.n_overlap, r.n_a, r.n_b, r.n_unique) == (6, 9, 1, 4)
    assert O.intersection_counts(vb, va.where("false"), 4.0).first().n_overlap == 0


def test_points_are_clipped_once(spark):
    pts = spark.createDataFrame([(1, 1.0, 1.0, "x"), (2, 5.0, 5.0, "y"), (3, None, 1.0, "z")], "pid long, x double, y double, fid string")
    twice = {1: [square(0, 0, 3)], 2: [square(0, 0, 4)]}
    assert [r.pid for r in O.clip_points(pts, spark.createDataFrame(rows_of(twice), VERTS), "pid", 2.0).collect()] == [1]


def test_a_segment_that_only_touches_a_corner_with_its_middle_is_outside(spark):
    """Either way along, and where it runs along a boundary the side that the polygon lies on decides."""
    polygons = spark.createDataFrame(rows_of({7: [square(0.25, 0.25, 8)]}), VERTS)
    ways = {0: [(0.45, 0.05), (0.05, 0.45)], 1: [(0.05, 0.45), (0.45, 0.05)], 2: [(0.25, 0.5), (0.0, 0.5)], 3: [(0.25, 0.5), (4.25, 0.5)], 4: [(1.0, 0.25), (3.0, 0.25)], 5: [(3.0, 0.25), (1.0, 0.25)]}
    lines = spark.createDataFrame([(f, 0, i, x, y) for f, pts in ways.items() for i, (x, y) in enumerate(pts)], VERTS)
    got = {(r.fid, r.other): round(r.length, 9) for r in O.clip_lines(lines, polygons, 8.0).collect()}
    assert got == {(3, 7): 4.0, (4, 7): 2.0}
