"""Column factories on small literal tables, with the published expected values."""

import math

from pyspark.sql import functions as F

from wayfold.functions import bits, fractions, geo, ids, tags


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_ids(spark):
    r = one(spark, ids.pair_key(F.lit(7), F.lit(12)), ids.stable_id(*map(F.lit, (10, 0, 1, 2, 1))), ids.parse_stable_id(F.lit("10/0/1/2/1")), ids.parse_stable_id(F.lit("10/0/1/2")), ids.parse_stable_id(F.lit("10/0/x/2/1")))
    assert r == ("00000000000000000007/00000000000000000012", "10/0/1/2/1", [10, 0, 1, 2, 1], None, None)


def test_fractions(spark):
    f = fractions.canonical_fraction
    r = one(spark, f(F.lit(0.5)), f(F.lit(0.5000000000004)), f(F.lit(-3.0)), f(F.lit(7.0)))
    assert r[0] == r[1] and [float(x) for x in r] == [0.5, 0.5, 0.0, 1.0]
    breaks = F.array(*map(F.lit, (0.0, 0.5, 0.95, 1.0)))
    assert one(spark, fractions.containing_interval(breaks, F.lit(0.922313075358)), fractions.containing_interval(breaks, F.lit(1.0)), fractions.containing_interval(breaks, F.lit(0.5))) == (1, 2, 1)
    widths = F.array(*[F.lit(333333333333).cast("decimal(18,0)"), F.lit(333333333334).cast("decimal(18,0)"), F.lit(333333333333).cast("decimal(18,0)")])
    assert one(spark, fractions.shares(F.lit(10).cast("bigint"), widths))[0] == [3, 4, 3]
    assert one(spark, fractions.to_units(F.lit("0.125").cast("decimal(20,6)"), 100))[0] == 12


def test_unit_of_double(spark):
    """Doubles whose shortest text ends in a half at the thirteenth place are rounded as SQL does."""
    import duckdb

    values = [0.7742562033245, 0.9427103679975, 0.7813720703125, 0.6578870179145, 1e-13, 0.0, 1.0, *[round(i * 0.000123456789, 12) + 5e-13 for i in range(1, 2000)]]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(fractions.unit_of(F.col("x"))).collect()]
    want = [duckdb.execute("SELECT CAST(round(CAST(?::DOUBLE AS DECIMAL(30,18)), 12) AS DECIMAL(13,12))", [x]).fetchall()[0][0] for x in values]
    assert got == want


def test_tags(spark):
    s = lambda x: tags.numeric_speed(F.lit(x))
    r = one(spark, s("50"), s("30 mph;60"), s("walk"), s(""), s(" 80 ; 70 "))
    assert (r[0], round(r[1], 3), r[2], r[3], r[4]) == (50.0, 48.28, None, None, 70.0)
    r = one(spark, tags.dimension(F.lit("3,5 t"), "weight"), tags.dimension(F.lit("10 ft"), "length"), tags.dimension(F.lit("none"), "length"))
    assert (r[0], round(r[1], 4), r[2]) == (3500.0, 3.048, None)
    m = F.create_map(F.lit("motorcar:forward"), F.lit(""), F.lit("motor_vehicle"), F.lit("private"), F.lit("access"), F.lit("yes"))
    assert one(spark, tags.access_decision(tags.access_value(m, "forward")), tags.access_decision(F.lit(None).cast("string"))) == ("forbidden:private", "public_default")
    d = lambda v, h="residential": tags.directions(F.create_map(F.lit("oneway"), F.lit(v)), F.lit(h))
    r = one(spark, d("yes"), d("-1"), d("no", "motorway"), d(None, "motorway"), d("alternating"))
    assert [tuple(x) for x in r] == [(True, False), (False, True), (True, True), (True, False), (True, True)]
    assert one(spark, tags.expected_duration(F.lit(68.3), F.lit(24.0)), tags.excepted(F.lit("bus; motorcar"), ("motorcar",)), tags.excepted(F.lit(None).cast("string"), ("motorcar",))) == (102, True, False)


def test_bits(spark):
    r = one(spark, bits.names(F.lit(6), ["w", "l", "k"]), bits.nested(F.lit(2), F.lit(3), F.lit(7)), bits.nested(F.lit(8), F.lit(3)))
    assert r == (["l", "k"], True, False)


def test_projection_golden_pair(spark):
    x, y = geo.project(F.lit(20.98634735), F.lit(52.268784436))
    r = one(spark, F.round(x, 3), F.round(y, 3))
    assert r == (635498.142, 491053.819)


def test_distances(spark):
    r = one(spark, geo.haversine(*map(F.lit, (20.0, 52.0, 20.0, 53.0))), geo.box_gap_m(tuple(map(F.lit, (0.0, 0.0, 1.0, 1.0))), tuple(map(F.lit, (2.0, 0.5, 3.0, 4.0)))), geo.turn_penalty(F.lit(0.0), F.lit(True)))
    assert math.isclose(r[0], 6372797.560856 * math.pi / 180, rel_tol=1e-12) and r[1] == 60000.0 and r[2] > 20
