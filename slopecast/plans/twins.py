"""The fixtures again, as SQL text: the independent side of every comparison."""

from __future__ import annotations

# name -> (needs, body)
_CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "rain_obs": ((), """SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS mm
        FROM lineitem GROUP BY 1, 2"""),
    "cal": (("rain_obs",), """SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
        FROM rain_obs"""),
    "rain": (("rain_obs", "cal"), """SELECT s.station, c.day, coalesce(o.mm, 0.0) AS mm
        FROM (SELECT DISTINCT station FROM rain_obs) s CROSS JOIN cal c
        LEFT JOIN rain_obs o ON o.station = s.station AND o.day = c.day"""),
    "rolled": (("rain",), """SELECT station, day, mm, mm AS r1,
        CASE WHEN row_number() OVER w >= 3 THEN sum(mm) OVER (w ROWS 2 PRECEDING) END AS r3,
        CASE WHEN row_number() OVER w >= 7 THEN sum(mm) OVER (w ROWS 6 PRECEDING) END AS r7
        FROM rain WINDOW w AS (PARTITION BY station ORDER BY day)"""),
    "season": (("rolled",), """SELECT *, (rank() OVER (PARTITION BY station ORDER BY r3) - 1) / CAST(count(*) OVER (PARTITION BY station) AS DOUBLE) AS r3_pct,
        (rank() OVER (PARTITION BY station ORDER BY r7) - 1) / CAST(count(*) OVER (PARTITION BY station) AS DOUBLE) AS r7_pct
        FROM rolled WHERE month(day) BETWEEN 5 AND 10 AND r7 IS NOT NULL"""),
    "trig": (("season",), "SELECT station, day, (r3_pct + r7_pct) / 2.0e0 AS trigger FROM season"),
    "stations": ((), """SELECT s_suppkey AS station, CAST(26.85 AS DOUBLE) + CAST(0.3 AS DOUBLE) * (s_suppkey % 10) AS lat,
        CAST(91.65 AS DOUBLE) + CAST(0.3 AS DOUBLE) * floor(s_suppkey / 10) AS lon FROM supplier"""),
    "oni": (("cal",), """SELECT year, month, ((year * 12 + month) % 7 - 3) / 2.0e0 AS oni FROM
        (SELECT DISTINCT year(day) AS year, month(day) AS month FROM cal) WHERE month <> 12"""),
    "wid": ((), "SELECT CAST(floor(sqrt(max(p_partkey))) + 1 AS INT) AS w FROM part"),
    "cells": (("wid",), """SELECT CAST(p_partkey // w AS BIGINT) * 100000 + p_partkey % w AS cell_id,
        CAST(p_partkey // w AS INT) AS row, CAST(p_partkey % w AS INT) AS col,
        p_retailprice + 20.0e0 * p_size AS elev,
        10 * (1 + CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) % 10) AS lc, p_type AS lith,
        p_size * 0.9e0 AS slope, p_partkey AS partkey, p_name AS pname FROM part, wid"""),
    "pc": (("wid",), """SELECT lineitem.*, CAST(l_partkey // w AS BIGINT) * 100000 + l_partkey % w AS cell_id,
        CAST(l_partkey // w AS INT) AS row, CAST(l_partkey % w AS INT) AS col FROM lineitem, wid"""),
    "flags": (("pc",), "SELECT DISTINCT cell_id, row, col FROM pc WHERE l_quantity = 50 AND l_returnflag = 'R'"),
    "sources": (("pc",), """SELECT DISTINCT cell_id, row, col, l_linenumber % 4 AS bit FROM pc
        WHERE l_quantity = 50 AND l_discount > 0.085e0"""),
    "cell_rain": (("cells",), """SELECT *, CAST((row // 5 * 10 + col // 5) % (SELECT count(*) FROM supplier) AS BIGINT) AS rain_id FROM cells"""),
    "labelled": (("cells", "sources"), """SELECT *, CASE WHEN cell_id IN (SELECT cell_id FROM sources) THEN 1 ELSE 0 END AS label FROM cells"""),
    "ev": ((), """SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS day,
        o_custkey % (SELECT count(*) FROM supplier) AS station,
        CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN '1km' ELSE '5km' END AS accuracy,
        CAST(substr(o_orderpriority, 1, 1) AS INT) AS size, o_custkey AS custkey, o_totalprice AS amount FROM orders"""),
    "basins": ((), """SELECT c_custkey AS basin, CASE WHEN c_custkey = 0 THEN -1 ELSE (c_custkey - 1) // 2 END AS next_down,
        CAST(1 + c_custkey % 97 AS DOUBLE) AS sub_area, c_custkey % (SELECT count(*) FROM supplier) AS rain_pt FROM customer"""),
    "verts": ((), """SELECT s_suppkey AS fid, part, seq, 10.0e0 * (s_suppkey % 10) + lo + side * a AS x,
        10.0e0 * (s_suppkey // 10) + lo + side * b AS y FROM supplier,
        (VALUES (0, 0.25e0, 8.0e0), (1, 3.25e0, 2.0e0)) r(part, lo, side),
        (VALUES (0,0,0),(1,1,0),(2,1,1),(3,0,1),(4,0,0)) p(seq, a, b) WHERE part = 0 OR s_suppkey % 2 = 0"""),
    "edges": (("verts",), """SELECT * FROM (SELECT fid, part, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2
        FROM verts WINDOW w AS (PARTITION BY fid, part ORDER BY seq)) WHERE x2 IS NOT NULL"""),
    "lines": ((), """SELECT o_custkey AS fid, 0 AS part, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq,
        92.0e0 + (o_orderkey % 1000) / 10000.0e0 AS x, 27.0e0 + (CAST(floor(o_totalprice) AS BIGINT) % 1000) / 10000.0e0 AS y FROM orders"""),
    "pieces": ((), """SELECT o_custkey AS road_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq,
        1.0e0 + o_orderkey % 3 AS km, CAST(o_orderkey % 6 AS INT) AS cls,
        27.0e0 + (CAST(floor(o_totalprice) AS BIGINT) % 1000) / 1000.0e0 AS lat, 92.0e0 + (o_orderkey % 1000) / 1000.0e0 AS lon FROM orders"""),
    "places": (("cells",), """SELECT partkey AS place_id, pname AS name, 27.0e0 + row * 0.01e0 AS lat, 92.0e0 + col * 0.01e0 AS lon,
        'town' AS kind FROM cells"""),
    "scenes": ((), """SELECT event_id AS scene_id, user_id AS site, CAST(ts AS DATE) AS day,
        CAST(CAST(floor(value) AS BIGINT) % 101 AS INT) AS cloud,
        CASE WHEN event_id % 2 = 0 THEN 'asc' ELSE 'desc' END AS orbit, event_type AS mode FROM events"""),
    "scores": ((), """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_quantity / 50.0e0 AS score, CAST(l_suppkey % 5 AS INT) AS fold FROM lineitem"""),
}


def register_cte(name: str, needs: tuple[str, ...], body: str) -> None:
    _CTE[name] = (needs, body)


def twin(body: str, *needs: str, recursive: bool = False, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the CTEs it needs, in dependency order."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _CTE[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in needs:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({_CTE[n][1]})" for n in order]
    parts += [f"{n} AS ({b})" for n, b in (extra or {}).items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" + body) if parts else body
