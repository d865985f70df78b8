"""Lines against polygons: the fixtures' classes, subdivision, areas, WKB, validity."""

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import planar, split
from wayfold.sources import features

BOX = lambda x, y, n: ((x, y), (x + n, y), (x + n, y + n), (x, y + n))
SQUARE, HOLE = BOX(0.0, 0.0, 10.0), BOX(4.0, 4.0, 2.0)
RINGS = "region string, ring int, is_hole boolean, seq int, x1 double, y1 double, x2 double, y2 double"


def rings(spark, **regions):
    rows = [(name, k, hole, i, *v[i], *v[(i + 1) % len(v)]) for name, parts in regions.items() for k, (hole, v) in enumerate(parts) for i in range(len(v))]
    return spark.createDataFrame(rows, RINGS)


def lines(spark, *rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "line int, ax double, ay double, bx double, by double")


def test_all_classes(spark):
    r = rings(spark, square=[(False, SQUARE)], holed=[(False, SQUARE), (True, HOLE)], two=[(False, BOX(0.0, 0.0, 2.0)), (False, BOX(4.0, 0.0, 2.0))], far=[(False, BOX(20.0, 0.0, 10.0)), (False, SQUARE)])
    want = {
        ((-1, 5, 11, 5), "square"): ("crossing", 1, 2), ((-1, 5, 5, 5), "square"): ("entering", 1, 1), ((5, 5, 11, 5), "square"): ("exiting", 1, 1), ((-1, 1, 1, -1), "square"): ("tangential_touch", 0, 1),
        ((0, 5, -5, 5), "square"): ("endpoint_on_boundary", 0, 1), ((0, 2, 0, 8), "square"): ("overlap_along_boundary", 0, 2), ((3, 5, 7, 5), "holed"): ("crossing_polygon_hole_boundary", 2, 2),
        ((-1, 1, 7, 1), "two"): ("multiple_crossings", 2, 4), ((21, 5, 29, 5), "far"): ("fully_inside", 1, 0), ((1, 1, 9, 9), "square"): ("fully_inside", 1, 0), ((-2, -2, -1, -1), "square"): ("fully_outside", 0, 0),
        ((3, 3, 3, 3), "square"): ("degenerate_numerical_case", 0, 0),
    }
    ls = lines(spark, *[k[0] for k in want])
    for cell in (3.0, 50.0):
        pairs = ls.select("line").join(r.select("region").distinct())
        got = {(x["line"], x["region"]): tuple(x)[2:] for x in planar.classified(ls, r, cell, pairs).collect()}
        assert {k: got[i, k[1]] for i, k in enumerate(want)} == want
    assert {v[0] for v in want.values()} == set(planar.CLASSES)
    found = planar.classified(ls, r, 3.0)
    assert found.count() < pairs.count()
    total = {(x["region"], x["class"]): x["n"] for x in planar.accounted(ls, r, found).collect()}
    for region in ("square", "holed", "two", "far"):
        assert sum(n for (k, _), n in total.items() if k == region) == len(want)
        assert total.get((region, "crossing"), 0) == sum(v[0] == "crossing" for (_, k), v in got.items() if k == region)


def test_fractions_of_the_event_list(spark):
    r, ls = rings(spark, s=[(False, SQUARE)]), lines(spark, (-1, 5, 11, 5), (11, 5, -1, 5))
    cut = planar.pieces(ls, r, planar.candidates(ls, r, 4.0), 4.0)
    got = [(x["line"], str(x["fraction"]), x["category"]) for x in planar.events(cut, ls, r, 4.0).orderBy("line", "fraction").collect()]
    assert got == [(k, f, c) for k in (0, 1) for f, c in (("0.083333333333", "entering"), ("0.916666666667", "exiting"))]


def test_coalescing():
    one, half = split.ONE, split.ONE // 2
    assert split.coalesce([0, half, half + 1, one], 1_000_000) == ([0, half, one], [0, half, half, one])
    assert split.coalesce([0, half, half + 1, one], 0) == ([0, one], [0, 0, one, one])
    assert split.coalesce([0, 1, one], 10) == ([0, one], [0, 0, one]) or split.coalesce([0, 1, one], 10)[0] == [0, one]
    assert split.allocate(10, [0, one // 3, 2 * one // 3, one]) == [3, 4, 3] or sum(split.allocate(10, [0, one // 3, 2 * one // 3, one])) == 10
    with pytest.raises(ValueError):
        split.coalesce([0, half], 5)


def test_subdivision(spark):
    nested = {str(b): [(False, BOX(-n, -n, 2.0 * n))] for b, n in ((0, 500.0), (1, 300.0), (2, 100.0))}
    r = rings(spark, **nested)
    edges = spark.createDataFrame([("e", -800.0, 0.0, 800.0, 1.0, 1600, 97), ("f", 2000.0, 0.0, 2100.0, 0.0, 100, 9), ("g", 499.9, 3.0, 500.1, 3.0, 1, 4)], "line string, ax double, ay double, bx double, by double, length_u bigint, duration_u bigint")
    s = split.Split(edges, r, 250.0, "raw", "0")
    assert s.preserved(edges).first().asDict() == {"parents": 3, "children": 9, "split_parents": 1, "lost": 0}
    got = s.children.where("line = 'e'").orderBy("ordinal").collect()
    assert [x["mask"] for x in got] == [0, 1, 3, 7, 3, 1, 0] and sum(x["length_u"] for x in got) == 1600 and got[2]["child"] == "e@2"
    assert s.internal().count() == 6
    turns = spark.createDataFrame([("e", "f", 5), ("f", "e", 6)], "in_edge string, out_edge string, turn_u bigint")
    assert {tuple(x)[:3] for x in s.inherited(turns).collect()} == {("e@6", "f@0", 5), ("f@0", "e@0", 6)}
    gates = s.gates.where("line = 'e'").collect()
    assert len(gates) == 6 and {(g["in_child"], g["out_child"]) for g in gates} == {(f"e@{k}", f"e@{k + 1}") for k in range(6)}
    # the short edge keeps one child: its gate lies at an end
    g = s.gates.where("line = 'g'").collect()
    assert len(g) == 1 and None in (g[0]["in_child"], g[0]["out_child"]) and s.children.where("line = 'g'").count() == 1
    assert s.points.count() == 7 and s.points.select("point_id").distinct().count() == 7


def test_measures_wkb_and_validity(spark, tmp_path):
    import sqlite3

    r = rings(spark, a=[(False, SQUARE), (True, HOLE)], b=[(False, SQUARE[::-1]), (False, BOX(20.0, 0.0, 1.0))], c=[(False, ((0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)))])
    m = {x["region"]: tuple(x)[1:] for x in planar.measured(r).collect()}
    assert m["a"] == (96.0, 48.0, 1, 1) and m["b"] == (101.0, 44.0, 2, 0)
    assert {tuple(x) for x in planar.invalid(r, 3.0).collect()} == {("c", 0, "self-intersection")}
    assert planar.invalid(r.where("NOT (region = 'a' AND ring = 0 AND seq = 2)"), 3.0).where("region = 'a'").first()["reason"] == "not closed"
    wkb = planar.encoded(r.where("region <> 'c'"))
    turned = rings(spark, a=[(True, HOLE[2:] + HOLE[:2]), (False, SQUARE[::-1])], b=[(False, BOX(20.0, 0.0, 1.0)), (False, SQUARE[1:] + SQUARE[:1])])
    assert {tuple(x)[::2] for x in wkb.collect()} == {tuple(x)[::2] for x in planar.encoded(turned).collect()}
    back = planar.measured(planar.decoded(wkb.select("region", "wkb")))
    assert {x["region"]: tuple(x)[1:] for x in back.collect()} == {k: m[k] for k in "ab"}
    assert wkb.select(F.hex("wkb")).count() == 2 and features.part_count(bytes(wkb.where("region = 'b'").first()["wkb"])) == 2
    db = sqlite3.connect(tmp_path / "t.gpkg")
    db.execute("CREATE TABLE layer (code TEXT, geom BLOB)")
    db.executemany("INSERT INTO layer VALUES (?, ?)", [(x["region"], b"GP\0\1" + bytes(4) + bytes(x["wkb"])) for x in wkb.collect()])
    db.execute("CREATE TABLE edges (edge_id TEXT, cost REAL)")
    db.executemany("INSERT INTO edges VALUES (?, ?)", [(f"e{i}", i / 2) for i in range(25)])
    db.commit()
    assert {tuple(x) for x in features.read_geopackage(spark, f"{tmp_path}/t.gpkg", "layer", "code").collect()} == {tuple(x)[:2] for x in wkb.collect()}
    got = features.read_sqlite(spark, f"{tmp_path}/t.gpkg", "edges", "edge_id string, cost double", "cost", 4)
    assert [x["cost"] for x in got.collect()] == [i / 2 for i in range(25)]
    assert planar.out_of_domain(spark.createDataFrame([(1.0, 2.0), (None, 1.0), (181.0, 0.0), (float("nan"), 1.0)], "lon double, lat double")).first() == (4, 3)


def test_projection_and_back(spark):
    at = spark.createDataFrame([(14.1, 49.0), (19.0, 52.0), (24.1, 54.9), (20.98634735, 52.268784436)], "lon double, lat double")
    x, y = geo.project(F.col("lon"), F.col("lat"))
    lon, lat = geo.unproject(F.col("x"), F.col("y"))
    for r in at.select("*", x.alias("x"), y.alias("y")).select("*", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r["a"] - r["lon"]) < 1e-9 and abs(r["b"] - r["lat"]) < 1e-9
