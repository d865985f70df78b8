"""Relational, graph and geometry operators on small fixtures."""

from pyspark.sql import functions as F

from wayfold.operators import geometry, graph, relational

SQUARE = ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))


def rings(spark, **regions):
    rows = []
    for name, parts in regions.items():
        for k, (hole, v) in enumerate(parts):
            rows += [(name, k, hole, i, *v[i], *v[(i + 1) % len(v)]) for i in range(len(v))]
    return spark.createDataFrame(rows, "region string, ring int, is_hole boolean, seq int, x1 double, y1 double, x2 double, y2 double")


def lines(spark, *rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "line int, ax double, ay double, bx double, by double")


def test_collapse_and_allocate(spark):
    df = spark.createDataFrame([(0, 0, True, 102), (0, 1, False, 1), (1, 0, False, 5), (1, 1, True, 7), (2, 0, False, 9)], "g int, i int, is_real boolean, ds bigint")
    got = relational.collapsed(df, "g", ["i"], F.col("is_real"), "ds").orderBy("g").collect()
    assert [tuple(r) for r in got] == [(0, 1, 103, 1), (1, 1, 12, 1)]
    df = spark.createDataFrame([(0, i, 10, 1) for i in range(3)] + [(1, 0, 5, 0), (1, 1, 5, 0)], "g int, i int, total bigint, w bigint")
    got = relational.allocated(df, "g", ["i"], "total", "w").orderBy("g", "i").collect()
    assert [r["share"] for r in got] == [4, 3, 3, 1, 1]


def test_joins_and_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "q"), (4, "w")], "k int, v string")
    assert {tuple(r) for r in relational.version_diff(a, b, ["k"]).collect()} == {(1, "removed"), (3, "changed"), (4, "added")}
    assert [r["k"] for r in relational.unmatched(a, b, "k").collect()] == [1]
    right = spark.createDataFrame([(1, 5, 2), (1, 4, 9), (1, 4, 3)], "k int, cost int, id int")
    best = relational.argmin_join(a, right, ["k"], [F.col("cost"), F.col("id")], "best").collect()
    assert [(r["k"], r["best"]["id"]) for r in best] == [(1, 3)]
    assert relational.digest(a).first() == relational.digest(a.repartition(3)).first()
    e = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (5, 6), (6, 5)], "from_node int, to_node int")
    assert {tuple(r) for r in relational.unique_continuation(e).collect()} == {(1, 2), (5, 6), (6, 5)}


def test_first_hits(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 6), (1, 2, 1), (2, 0, 4)], "g int, pos int, mask int")
    assert {r["g"]: r["order"] for r in relational.first_hits(df, "g", "pos", "mask", 3).collect()} == {1: [0, 1, 2], 2: [2]}


def test_graph(spark):
    p = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (1, 3, 20), (3, 4, 1)], "from_node bigint, to_node bigint, cost bigint")
    seed = spark.createDataFrame([(1,)], "node bigint")
    assert {tuple(r) for r in graph.reachable(p, seed, 2).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    assert {tuple(r) for r in graph.shortest(p, seed, 2).collect()} == {(1, 0), (2, 5), (3, 10), (4, 21)}
    marks = spark.createDataFrame([(3, 1), (2, 0)], "node bigint, bit int")
    done = lambda order: {r["node"]: r["cost"] for r in graph.fixed_order(p, marks, seed, order, 4).where("progress = 2").collect()}
    assert done([0, 1]) == {3: 10, 4: 11} and done([1, 0]) == {}
    cities = [f"c{i}" for i in range(18)]
    s = graph.schedule(spark, cities, [cities] * 3, 1)
    assert s.count() == 197 and s.where("array_size(array_distinct(order)) <> 18").count() == 0


def test_geometry_classes(spark):
    r = rings(spark, square=[(False, SQUARE)], holed=[(False, SQUARE), (True, ((4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)))])
    ls = lines(spark, (-1, 5, 11, 5), (-1, 5.5, 5, 5.5), (5, 5.5, 11, 5.5), (1, 1, 9, 9.5), (-2, -2, -1, -1))
    got = {(x["line"], x["region"]): x["class"] for x in geometry.classified(geometry.intervals(ls, r)).collect()}
    assert [got[i, "square"] for i in range(5)] == ["crossing", "entering", "exiting", "fully_inside", "fully_outside"]
    assert got[0, "holed"] == "multiple_crossings"


def test_nearest_and_contained(spark):
    ls = lines(spark, (0, 0, 10, 0), (0, 3, 10, 3), (5, 5, 5, 5))
    assert tuple(geometry.nearest(ls, 4.0, 2.0, ["line"]).first()) == (1000, 1, 0.4)
    p = spark.createDataFrame([(0, 5.0, 5.0), (1, 15.0, 5.0)], "id int, x double, y double")
    assert {r["id"]: r["inside"] for r in geometry.containment(p, rings(spark, s=[(False, SQUARE)]), ["id"]).collect()} == {0: True, 1: False}


def test_erosion_against_sampling(spark):
    ring = ((0.0, 0.0), (40.0, 5.0), (30.0, 40.0), (20.0, 15.0), (5.0, 35.0))
    rows = [(-5, 3, 45, 30), (1, 30, 38, 6), (20, -3, 21, 44), (10, 10, 12, 11)]
    got = geometry.eroded(lines(spark, *rows), rings(spark, s=[(False, ring)]), 2.0).collect()

    def ok(x, y):
        inside, near = False, 1e9
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                inside = not inside
            t = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            near = min(near, ((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) ** 0.5)
        return inside and near >= 2.0

    for i, (ax, ay, bx, by) in enumerate(rows):
        for k in range(1, 400):
            f = k / 400
            edge = any(abs(f - e) < 1e-6 for r in got if r["line"] == i for e in (r["f0"], r["f1"]))
            mine = any(r["f0"] <= f <= r["f1"] for r in got if r["line"] == i)
            assert edge or mine == ok(ax + f * (bx - ax), ay + f * (by - ay)), (i, f)
