"""Feature collections of every geometry type."""

import json

from slopecast.session import scratch_path
from slopecast.sources import ingest as I


def read(spark, features, multi_line=False):
    path = scratch_path(spark, "collection")
    lines = [json.dumps({"type": "FeatureCollection", "features": features}, indent=1 if multi_line else None)]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return I.read_features(spark, path, "id long, name string", multi_line)


def feature(i, geometry):
    return {"type": "Feature", "properties": {"id": i, "name": f"n{i}", "other": 1}, "geometry": geometry}


SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
HOLE = [[1, 1], [2, 1], [2, 2], [1, 1]]


def test_four_features_of_four_types_give_four(spark):
    shapes = [("Point", [1.5, 2]), ("LineString", [[0, 0], [1, 1]]), ("Polygon", [SQUARE, HOLE]), ("MultiPolygon", [[SQUARE, HOLE], [SQUARE]])]
    f = read(spark, [feature(i, {"type": t, "coordinates": c}) for i, (t, c) in enumerate(shapes)])
    assert [(r.id, r.name, r.geom_type) for r in f.orderBy("id").collect()] == [(i, f"n{i}", t) for i, (t, _) in enumerate(shapes)]
    v = I.vertices(f, "id").collect()
    assert {r.fid for r in v} == {0, 1, 2, 3}
    assert {(r.member, r.ring, r.part) for r in v if r.fid == 3} == {(0, 0, 0), (0, 1, 1), (1, 0, 2)}
    assert sorted((r.seq, r.x, r.y) for r in v if r.fid == 3 and r.part == 1) == [(i, float(x), float(y)) for i, (x, y) in enumerate(HOLE)]


def test_features_without_usable_geometry_keep_their_rows(spark):
    odd = [None, {"type": "Sphere", "coordinates": [1]}, {"type": "Point", "coordinates": "north"}, {"type": "MultiPoint", "coordinates": []}, {"type": "GeometryCollection", "geometries": []}]
    f = read(spark, [feature(i, g) for i, g in enumerate(odd)])
    assert [(r.id, r.geom_type) for r in f.orderBy("id").collect()] == [(i, g and g["type"]) for i, g in enumerate(odd)]
    assert I.vertices(f, "id").count() == 0


def test_collections_and_extra_positions(spark):
    g = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2, 300]}, {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5], [6, 6]]]}]}
    v = I.vertices(read(spark, [feature(1, g)]), "id").orderBy("part", "seq").collect()
    assert [(r.geom_type, r.member, r.part, r.seq, r.x, r.y) for r in v] == [
        ("GeometryCollection", 0, 0, 0, 1.0, 2.0), ("GeometryCollection", 1, 1, 0, 0.0, 0.0), ("GeometryCollection", 1, 1, 1, 1.0, 1.0),
        ("GeometryCollection", 2, 2, 0, 5.0, 5.0), ("GeometryCollection", 2, 2, 1, 6.0, 6.0)]


def test_pretty_printed_documents(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [feature(1, {"type": "Polygon", "coordinates": [SQUARE]})]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2))
    assert I.vertices(I.read_features(spark, str(tmp_path), "id long", multi_line=True), "id").count() == 5
