"""Certificates, packed permutations, contracted roads, file heads and column types."""

import hashlib
import itertools
import os
import random

import pytest

from slopecast.operators import evaluate as E
from slopecast.operators import lattice as O
from slopecast.operators import roads as Rd
from slopecast.sources import ingest as I


def loss(points, a, b, q):
    return sum(m * ((q if y - a - b * x >= 0 else q - 1) * (y - a - b * x)) for x, y, m in points)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_curve_is_the_best_line_through_two_events(spark, seed):
    import math

    rng = random.Random(seed)
    events = [(rng.choice([24.0, 48.0, 72.0, 96.0, 240.0]), float(rng.randint(2, 300))) for _ in range(80)]
    got = E.ed_optimum(spark.createDataFrame([*events, (0.0, 5.0), (24.0, None)], "hours double, rain double"), "hours", "rain")
    pts = [(math.log10(d), math.log10(e), 1.0) for d, e in events]
    best = min(loss(pts, u[1] - (v[1] - u[1]) / (v[0] - u[0]) * u[0], (v[1] - u[1]) / (v[0] - u[0]), 0.1) for u, v in itertools.combinations(pts, 2) if u[0] != v[0])
    assert got["certified"] and got["loss"] == pytest.approx(best)


def test_a_curve_that_is_not_best_has_no_certificate():
    assert E._balanced(0.0, 0.0, [(1.0, 5.0), (2.0, 5.0)], 0.1)
    assert not E._balanced(40.0, 60.0, [(1.0, 5.0), (2.0, 5.0)], 0.1)
    assert not E._balanced(-0.5, -2.0, [(1.0, 5.0)], 0.1)  # the first sum fits, the second cannot


def test_no_curve_without_two_durations(spark):
    one = spark.createDataFrame([(24.0, 5.0), (24.0, 9.0)], "hours double, rain double")
    got = E.ed_optimum(one, "hours", "rain")
    assert not got["certified"] and got["loss"] != got["loss"]


def test_packed_and_spread_permutations_are_the_same(spark, monkeypatch):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, i % 3, rng.random(), rng.randint(0, 5)) for i in range(60)] + [(99, 1, None, 1)], "id long, k int, a double, b int")
    packed = E.permutation_null(df, ["id", "k"], "a", "b", 15, 3).first()
    monkeypatch.setattr(E, "PACKED_ROWS", 0)
    spread = E.permutation_null(df, ["id", "k"], "a", "b", 15, 3).first()
    assert packed.permutations == spread.permutations == 15 and packed.share_beyond == spread.share_beyond
    assert packed.observed == pytest.approx(spread.observed) and packed.null_p95 == pytest.approx(spread.null_p95)


def test_distances_over_chains_rings_and_dead_ends(spark):
    links = [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 5, 5.0), (5, 1, 1.0), (3, 9, 2.0), (9, 10, 2.0), (10, 11, 2.0), (20, 21, 1.0), (21, 22, 1.0), (22, 20, 1.0), (30, 31, 4.0)]
    e = spark.createDataFrame([(a, b, k) for u, v, k in links for a, b in ((u, v), (v, u))], "src long, dst long, km double")
    o = spark.createDataFrame([(2,), (30,), (2,)], "node long")
    got = {(r.origin, r.node): (r.km, r.prev) for r in Rd.shortest_distances(e, o).collect()}
    assert got == {(2, 2): (0.0, None), (2, 1): (1.0, 2), (2, 3): (1.0, 2), (2, 4): (2.0, 3), (2, 5): (2.0, 1), (2, 9): (3.0, 3), (2, 10): (5.0, 9), (2, 11): (7.0, 10), (30, 30): (0.0, None), (30, 31): (4.0, 30)}
    # a ring that only the origin stops on
    ring = spark.createDataFrame([(20,)], "node long")
    assert {r.node: r.km for r in Rd.shortest_distances(e, ring).collect()} == {20: 0.0, 21: 1.0, 22: 1.0}
    assert Rd.chains(e, ring).where("src = 1 and dst = 1").count() == 0


def test_only_the_head_of_a_file_is_read(spark, tmp_path):
    big, small = tmp_path / "big.bin", tmp_path / "small.bin"
    small.write_bytes(b"abcdef")
    with open(big, "wb") as f:
        f.write(b"head")
        f.truncate(3 << 30)  # sparse: three GB that take up no room
    got = {r.name: (r.bytes, r.sha256_head) for r in I.file_heads(spark, str(tmp_path), "*.bin", head=4).collect()}
    assert got == {"big.bin": (3 << 30, hashlib.sha256(b"head").hexdigest()), "small.bin": (6, hashlib.sha256(b"abcd").hexdigest())}
    os.truncate(small, 0)
    assert [r.name for r in I.file_manifest(spark, str(tmp_path), "s", "*.bin", head=4).collect()] == ["big.bin"]  # Spark lists no empty files


def test_category_codes_stay_whole(spark):
    cells = spark.createDataFrame([(1,), (2,), (3,)], "cell_id long")
    layers = spark.createDataFrame([(1, "lc", 70.0), (2, "lc", 255.0), (1, "elev", 1.5)], "cell_id long, layer string, value double")
    out = O.assemble(cells, layers, ["lc", "elev"], categories=["lc"])
    assert dict(out.dtypes) == {"cell_id": "bigint", "lc": "smallint", "elev": "float"}
    assert {r.cell_id: r.lc for r in out.collect()} == {1: 70, 2: 255, 3: None}
    for bad in (70.5, 256.0, -1.0):
        with pytest.raises(Exception, match="no category code"):
            O.assemble(cells, spark.createDataFrame([(1, "lc", bad)], layers.schema), ["lc"], categories=["lc"]).collect()
