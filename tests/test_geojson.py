"""A10: feature collections cut between features against the JSON module."""

import json
import random

import pytest

from envspark.sources.polygons import FEATURE_MARK, _read_features, read_geojson_polygons


def _ring(rnd, n):
    pts = [[rnd.uniform(100, 110), rnd.uniform(8, 24)] for _ in range(n)]
    return pts + pts[:1]


def _feature(rnd, name, kind=None, vertices=8):
    kind = kind or rnd.choice(["Polygon", "MultiPolygon"])
    rings = [_ring(rnd, rnd.randint(3, vertices)) for _ in range(rnd.randint(1, 3))]
    shape = rings if kind == "Polygon" else [rings, [_ring(rnd, 4)]]
    return {"type": "Feature", "properties": {"shapeName": name, "shapeISO": 7}, "geometry": {"type": kind, "coordinates": shape}}


def _expected(collections):
    polys, rings = [], []
    for f in (f for c in collections for f in c["features"]):
        k = len(polys)
        polys.append((k, (f["properties"] or {}).get("shapeName") or "Unknown", k))
        g = f["geometry"]
        shape = g["coordinates"] if g["type"] == "Polygon" else [r for p in g["coordinates"] for r in p]
        rings += [(k, i, j, *map(float, xy[:2])) for i, r in enumerate(shape) for j, xy in enumerate(r[:-1])]
    return polys, sorted(rings)


def _read(spark, path):
    polys, rings = read_geojson_polygons(spark, str(path))
    return sorted(map(tuple, polys.collect())), sorted(map(tuple, rings.collect()))


def _collections(seed):
    rnd = random.Random(seed)
    names = ["Đà Nẵng", "", None, 'a "Feature" b', "x}, {", "Hà Nội"]
    return [{"type": "FeatureCollection", "features": [_feature(rnd, rnd.choice(names)) for _ in range(n)]} for n in (40, 1, 7)]


@pytest.mark.parametrize("style", [{}, {"separators": (",", ":")}, {"indent": 2}, {"ensure_ascii": False}])
def test_collections_of_a_folder(spark, tmp_path, style):
    made = _collections(1)
    for k, c in enumerate(made):
        (tmp_path / f"part-{k}.json").write_text(json.dumps(c, **style))
    assert _read(spark, tmp_path) == _expected(made)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    rnd = random.Random(2)
    made = {"type": "FeatureCollection", "features": [_feature(rnd, f"p{k}", vertices=60) for k in range(300)]}
    (tmp_path / "a.json").write_text(json.dumps(made))
    size = (tmp_path / "a.json").stat().st_size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 9))
        assert _read_features(spark, str(tmp_path / "a.json")).rdd.getNumPartitions() >= 9
        assert _read(spark, tmp_path / "a.json") == _expected([made])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_of_other_forms_are_read_whole(spark, tmp_path):
    rnd = random.Random(4)
    plain = [_feature(rnd, f"n{k}") for k in range(4)]
    turned = [{k: f[k] for k in ("geometry", "properties", "type")} for f in plain]
    tricky = [_feature(rnd, "Feature"), {"type": "Feature", "properties": {"type": "Feature", "shapeName": "t"}, "geometry": plain[0]["geometry"]},
              {"type": "Feature", "properties": {"parts": [{"a": 1}, {"type": "Feature"}], "shapeName": "u"}, "geometry": plain[1]["geometry"]},
              {"type": "Feature", "properties": None, "geometry": plain[2]["geometry"]}]
    made = [{"type": "FeatureCollection", "features": f} for f in (plain, turned, tricky, [])]
    for k, c in enumerate(made):
        (tmp_path / f"f{k}.json").write_text(json.dumps(c))
    assert FEATURE_MARK in json.dumps(tricky)
    assert _read(spark, tmp_path) == _expected(made)
