"""Cases that a reviewer's larger tables brought up."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slopecast.functions import lattice as L
from slopecast.operators import catchment, digests, evaluate, hazard, rain, roads, spatial
from slopecast.plans import all_queries, q_evaluate, q_streaming
from slopecast.plans.fixtures import Tables


def test_days_after_the_year_9999_carry_no_sign(spark, tmp_path):
    o = spark.createDataFrame([(0, datetime(1996, 4, 18)), (2938685, datetime(1996, 4, 18))], "o_orderkey long, o_orderdate timestamp")
    o.write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.from_ms for r in all_queries()["date_functions"].fn(spark, str(tmp_path)).collect()}
    assert got == {0: "1954-02-26", 2938685: "10000-01-01"}


def test_tile_names_keep_all_digits(spark):
    at = spark.createDataFrame([(27.5, 93.2), (-1.0, 1002.0), (120.0, -3.5), (None, 1.0)], "lat double, lon double")
    got = [r[0] for r in at.select(L.tile_name(F.col("lat"), F.col("lon"), 3)).collect()]
    assert got == ["N27E093", "S03E1002", "N120W006", None]


def test_every_reading_is_delivered_once_whatever_the_median(spark, tmp_path, monkeypatch):
    """An approximate median may differ each time it is asked for."""
    start = datetime(2024, 1, 1)
    ev = [(k, start + timedelta(hours=k), k % 3, "view", 1.0, "") for k in range(400)]
    spark.createDataFrame(ev, q_streaming.SCHEMA).repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(F, "percentile_approx", lambda c, p: F.min(c) + F.pmod(F.xxhash64(F.current_timestamp()), F.lit(400 * 3600)))
    path, coming = q_streaming.delivered(spark, str(tmp_path))
    for deliver in coming:
        deliver()
    got = [r.reading_id for r in spark.read.option("recursiveFileLookup", True).schema(q_streaming.STREAM).parquet(path).collect()]
    assert sorted(got) == [-1, *range(400)]


def test_a_basin_on_its_own_has_the_products_of_the_sql(spark):
    """0.985 x 67 / 67 and 0.955 x 9 / 9 in doubles, as the twins of flood_hazard and watch_list have them."""
    b = spark.createDataFrame([(0, -1, 9.0), (1, -1, 61.0), (2, -1, 67.0)], "basin long, next_down long, sub_area double")
    v = spark.createDataFrame([(0, 0.955), (1, 0.955), (2, 0.985)], "basin long, p double")
    got = {r.basin: r.p for r in catchment.upstream_mean(b, v, ["p"]).collect()}
    assert got == {0: 0.955 * 9 / 9, 1: 0.955 * 61 / 61, 2: 0.985 * 67 / 67}
    assert got[0] < got[1]
    sig = spark.createDataFrame([(2, "d", got[2])], "basin long, day string, up_pct double")
    cells = spark.createDataFrame([(1, 26, 2)], "cell_id long, idx int, basin long")
    assert hazard.flood_hazard(cells, sig).first().cls == 3


def test_snapping_never_broadcasts_points_times_nine(spark, tmp_path):
    """Sizes on disk say nothing about rows under nine buckets each."""
    grid = spark.range(900).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / 30).cast("int").alias("row"), F.pmod("id", F.lit(30)).cast("int").alias("col"))
    grid.write.parquet(f"{tmp_path}/grid")
    cells = spark.read.parquet(f"{tmp_path}/grid")
    out = spatial.snap_within(cells, cells.where("cell_id % 97 = 5"), "cell_id", 4)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    meeting = [x for x in plan.splitlines() if "Join" in x and "_x" in x]
    assert meeting and not any("Broadcast" in x for x in meeting)
    listed = [divmod(k, 30) for k in range(900) if k % 97 == 5]
    for r in out.collect():
        y, x = divmod(r.cell_id, 30)
        want = min(((a - y) ** 2 + (b - x) ** 2, a, b) for a, b in listed + [(999, 0)] if max(abs(a - y), abs(b - x)) <= 4 or a == 999)
        assert (r.snap_row, r.snap_col) == (want[1:] if want[1] != 999 else (None, None))
        assert r.snap_dist == (want[0] ** 0.5 if want[1] != 999 else None)


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_digest_order_is_that_of_md5(n, monkeypatch):
    monkeypatch.setattr(evaluate, "HASHED", 1000)
    ids = [str(k % 2500).encode() for k in range(n)]  # equal ids stay as they stand
    want = sorted(range(n), key=lambda k: (hashlib.md5(ids[k] + b"|1|7").digest(), k))
    assert evaluate._digest_order(ids, b"|1|7").tolist() == want


def test_three_hundred_thousand_rows_are_not_multiplied_by_permutations(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "seeded_order", None)  # sends every row once per permutation
    df = spark.range(300_000).select("id", F.pmod("id", F.lit(11)).alias("x"), F.pmod("id", F.lit(7)).alias("y"))
    r = evaluate.permutation_null(df, ["id"], "x", "y", 3, 1).first()
    assert r.permutations == 3 and r.observed < 0.01


def test_ranks_beyond_the_driver_are_read_not_sent_once_per_permutation(spark, monkeypatch):
    """Every row was shuffled for each of 2,000 permutations, which filled the disk."""
    monkeypatch.setattr(evaluate, "seeded_order", None)
    monkeypatch.setattr(evaluate, "PACKED_ROWS", 0)
    monkeypatch.setattr(evaluate, "BLOCK_ROWS", 700)
    df = spark.range(5000).select("id", F.pmod(F.col("id") * 7919, F.lit(101)).alias("x"), F.pmod("id", F.lit(7)).alias("y"))
    r = evaluate.permutation_null(df, ["id"], "x", "y", 9, 1).first()
    ranks = evaluate._shared_null(df.select("id", F.col("x").cast("double").alias("rx"), F.col("y").cast("double").alias("ry")), ["id"], 9, 1)
    plan = ranks._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and r.permutations == 9

    def order(tail):
        return sorted(range(5000), key=lambda k: hashlib.md5(f"{k}{tail}".encode()).digest())

    xs, left = [k * 7919 % 101 for k in range(5000)], order("|x1")
    for got in ranks.collect():
        pairs = [(xs[a], b % 7) for a, b in zip(left, order(f"|{got.perm}|1"), strict=True)]
        mx, my = (sum(p[i] for p in pairs) / 5000 for i in (0, 1))
        want = sum((a - mx) * (b - my) for a, b in pairs) / (sum((a - mx) ** 2 for a, _ in pairs) * sum((b - my) ** 2 for _, b in pairs)) ** 0.5
        assert got.rho == pytest.approx(want, abs=1e-12)


def test_digests_of_texts_of_any_length_are_md5():
    texts = [b"", b"a", b"abc", b"12345678", b"x" * 40, b"y" * 55, b"z" * 60, b"abc", b"q" * 51, "ä|1".encode()] * 3 + [str(k).encode() for k in range(300)]
    for tail in (b"|1|7", b"", b"|x7", b"t" * 30):
        want = sorted(range(len(texts)), key=lambda k: (hashlib.md5(texts[k] + tail).digest(), k))
        assert digests.Digests.of(texts, 64).order(tail).tolist() == want


def test_offers_of_a_dense_network_are_hashed_not_sorted(spark, monkeypatch):
    plans, durable = [], roads.durable
    monkeypatch.setattr(roads, "durable", lambda df: plans.append((df.columns, df._jdf.queryExecution().sparkPlan().toString())) or durable(df))
    e = spark.range(144).select(F.floor(F.col("id") / 12).alias("src"), F.pmod("id", F.lit(12)).alias("dst")).where("src <> dst")
    e = e.withColumn("km", F.abs(F.col("src") - F.col("dst")).cast("double") ** 2)
    o = spark.createDataFrame([(0,), (5,)], "node long")
    got = {(r.origin, r.node): r.km for r in roads.shortest_distances(e, o, before=False).collect()}
    assert got == {(a, b): float(abs(a - b)) for a in (0, 5) for b in range(12)}
    rounds = [p for cols, p in plans if "old" in cols]
    assert len(rounds) > 1 and not any("SortAggregate" in p for p in rounds)


@pytest.mark.parametrize("front", [0, 1000])
def test_a_dense_network_is_walked_from_the_nearest_nodes(spark, monkeypatch, front):
    """Every improved node sent all its links again in every round, however far it was."""
    monkeypatch.setattr(roads, "OFFERS", 60)
    monkeypatch.setattr(roads, "FRONT", front)
    rng = random.Random(2)
    links = {(a, b): rng.random() for a in range(14) for b in range(a)} | {(20, 21): 1.0, (21, 22): 0.5, (20, 22): 4.0, (22, 23): 2.0, (20, 23): 9.0}
    e = spark.createDataFrame([(*p, k) for (a, b), k in links.items() for p in ((a, b), (b, a))], "src long, dst long, km double")
    want = {}
    for o in (0, 5, 20):
        best, left = {o: 0.0}, {o}
        while left:
            u = left.pop()
            for (a, b), k in links.items():
                for x, y in ((a, b), (b, a)):
                    if x == u and best[u] + k < best.get(y, 1e9):
                        best[y] = best[u] + k
                        left.add(y)
        want |= {(o, v): d for v, d in best.items()}
    got = {(r.origin, r.node): r.km for r in roads.shortest_distances(e, spark.createDataFrame([(0,), (5,), (20,)], "node long"), before=False).collect()}
    assert got == pytest.approx(want) and got.keys() == want.keys()


@pytest.mark.parametrize("name", ["alert_days", "archive_timeline", "climatology_breaks", "daily_spread", "antecedent_index", "storm_runs", "storm_id_ratio", "storm_stats"])
def test_a_day_of_readings_is_hashed_once_and_no_filled_day_is_sorted(spark, name):
    """The days were added up twice, in three hash tables of one task, and storms were windows over every day of the calendar."""
    plan = all_queries()[name].fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert len([x for x in plan if "HashAggregate(keys=[station" in x or "HashAggregate(keys=[l_suppkey" in x]) <= 2
    if name.startswith(("storm", "antecedent")):
        assert not any("Window" in x for x in plan)


def test_storm_days_meet_the_events_once(spark, monkeypatch):
    """Every day of the calendar was joined with the events, for the fit and again for the counts."""
    written, reused = [], q_evaluate.reused
    monkeypatch.setattr(q_evaluate, "reused", lambda df: written.append(df.columns) or reused(df))
    r = all_queries()["event_duration_curve"].fn(spark, "/root/testdata/sf0.001").first()
    assert written == [["hours", "storm_rain"]]
    t = Tables(spark, "/root/testdata/sf0.001")
    s = rain.storms(t.rain()).join(t.events().select("station", "day"), ["station", "day"])
    assert (r.wet, r.dry) == (s.where("storm_dur > 0").count(), s.where("storm_dur = 0").count())


def test_triggers_at_events_are_joined_once(spark, monkeypatch):
    """The median and the shares each joined eight days of every event with the triggers."""
    written, reused = [], hazard.reused
    monkeypatch.setattr(hazard, "reused", lambda df: written.append(df.columns) or reused(df))
    trig = spark.createDataFrame([(1, datetime(2020, 6, d).date(), d / 10) for d in range(1, 10)], "station long, day date, trigger double")
    ev = spark.createDataFrame([(1, datetime(2020, 6, 8).date()), (2, datetime(2020, 6, 8).date())], "station long, day date")
    got = {r.lead: (r.n, r.median_trigger, r.share_alert) for r in hazard.lead_time_profile(trig, ev, (-1, 0, 1)).collect()}
    assert got == {-1: (1, 0.7, 0.0), 0: (1, 0.8, 0.0), 1: (1, 0.9, 1.0)}
    assert ["lead", "trigger"] in written


def test_flow_direction_hashes_neighbours_and_broadcasts_none(spark):
    """Nine copies of every cell are estimated as one, and the lists of neighbours were broadcast whole."""
    from slopecast.operators import terrain as T

    cells = spark.range(400).select(F.col("id").alias("cell_id"), (F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), F.rand(3).alias("elev"))
    flow = T.flow_direction(cells)
    flow.collect()
    plan = flow._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_nearest_sorts_buckets_and_broadcasts_no_copies(spark):
    """Rows are copied once per level used, which the estimate leaves out; the least distance needs no sort."""
    from slopecast.operators import spatial as S

    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 90.0, 4.0)], "a long, ax double, ay double")
    right = spark.createDataFrame([(k, float(k % 10), float(k // 10)) for k in range(100)] + [(100, 0.0, 0.0)], "b long, bx double, by double")
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    n = S.nearest(left, right, "a", ["b"], (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), 1.0, d)
    assert "SortMergeJoin [_l" in n._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, n.collect())) == [(1, 0, 0.0), (2, 49, 81.0)]


def test_a_chain_takes_rounds_over_blocks_only(spark, monkeypatch):
    """Every round over a chain joined all its nodes, and a chain has log4 of all nodes of them."""
    seen, durable = [], catchment.durable
    monkeypatch.setattr(catchment, "durable", lambda df: seen.append(durable(df)) or seen[-1])
    monkeypatch.setattr(catchment, "BLOCK", 64)
    n = 3000
    e = spark.range(n).select(F.col("id").alias("node"), (F.col("id") - 1).alias("down"))
    got = {r.node: r.v for r in catchment.accumulate(e, e.select("node", F.lit(2).alias("v")), ["v"]).collect()}
    assert got == {i: 2 * (n - i) for i in range(n)}
    assert seen and max(df.count() for df in seen) <= n // 64 + 2 * 8 + 2


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_sums_down_a_forest_are_those_of_a_walk(spark, monkeypatch, block):
    """Numbers without order, nulls, repeated and missing values, values of no node, and sums near the end of a long."""
    monkeypatch.setattr(catchment, "BLOCK", block)
    rng = random.Random(block)
    nodes = rng.sample(range(-500, 500), 150)
    down = {v: (rng.choice(nodes[:i]) if i and rng.random() < 0.95 else rng.choice([None, -1000, 777])) for i, v in enumerate(nodes)}
    vals = [(rng.choice([*nodes, 2000, None]), rng.choice([None, 1, 2**62, -(2**62)]), rng.choice([None, 0.5])) for _ in range(120)]
    want = {}
    for v, a, b in vals:
        while True:
            x = want.setdefault(v, [[], []])
            for k, y in enumerate((a, b)):
                x[k] += [] if y is None else [y]
            to = down.get(v)
            if to is None or to < 0 or to not in down:
                break
            v = to
    want = {v: tuple(sum(k) if k else None for k in x) for v, x in want.items()}
    e, v = spark.createDataFrame(list(down.items()), "node int, down int"), spark.createDataFrame(vals, "node int, a long, b double")
    if all(a is None or abs(a) < 2**63 for a, _ in want.values()):
        assert {r.node: (r.a, r.b) for r in catchment.accumulate(e, v, ["a", "b"]).collect()} == want
    small = v.withColumn("a", F.signum("a").cast("int"))
    got = {r.node: (r.a, r.b) for r in catchment.accumulate(e, small, ["a", "b"]).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] for k in want)


def test_a_loop_across_blocks_is_refused(spark, monkeypatch):
    monkeypatch.setattr(catchment, "BLOCK", 2)
    e = spark.range(10).select(F.col("id").alias("node"), F.pmod(F.col("id") + 1, F.lit(10)).alias("down"))
    with pytest.raises(ValueError):
        catchment.accumulate(e, e.select("node", F.lit(1).alias("v")), ["v"])


def test_files_are_written_by_tasks_into_a_folder_each_for_many(spark, tmp_path, monkeypatch):
    """A folder per file cost the committer and the listing a round each; rows of one key shared a file, which the SQL counts as two."""
    from slopecast.plans import q_ingest

    rows = [(k // 2, f"Supplier#{k:09d}", k / 4) for k in range(40)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_acctbal double").repartition(3).write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(q_ingest, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    got = {r.folder: (r.files, r.bytes, r.heads) for r in all_queries()["file_heads"].fn(spark, str(tmp_path)).collect()}
    want = {}
    for k, name, x in rows:
        want.setdefault(k % 5, []).append(f"{name} {x}\n".encode())
    assert got == {f: (len(t), sum(map(len, t)), ",".join(sorted(hashlib.sha256(x[:12]).hexdigest()[:16] for x in t))) for f, t in want.items()}
    assert sum(p.is_dir() for p in (tmp_path / "delivered").rglob("*")) == 5


def test_the_week_of_a_catchment_signal_hashes_a_day_once(spark, monkeypatch):
    """Its live step added up the days of all readings twice."""
    from slopecast.plans import q_hazard

    plans, reused = [], q_hazard.reused
    monkeypatch.setattr(q_hazard, "reused", lambda df, name: plans.append((name, df._jdf.queryExecution().sparkPlan().toString())) or reused(df, name))
    q_hazard.Outlook(spark, "/root/testdata/sf0.001").signal()
    live = dict(plans)["live_week"].splitlines()
    assert 1 <= len([x for x in live if "HashAggregate(keys=[station" in x or "HashAggregate(keys=[l_suppkey" in x]) <= 2
