"""Readers, writers and relation shapes on small files."""

import hashlib
import json

from pyspark.sql import functions as F

from wayfold.sources import tables


def test_tsv_and_checksums(spark, tmp_path):
    df = spark.createDataFrame([("10/0/0/1/2", "10/0/1/2/1", "0.5", "allowed")], "in_edge string, out_edge string, turn_s string, status string")
    tables.write_tsv(df, f"{tmp_path}/t")
    got = tables.read_tsv(spark, f"{tmp_path}/t", tables.TURNS).first()
    assert (got["in_edge"], float(got["turn_s"])) == ("10/0/0/1/2", 0.5)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_bytes(b"abc")
    sums = spark.createDataFrame([("a.txt", hashlib.sha256(b"abc").hexdigest())], "name string, sha256 string")
    assert tables.verified(spark, f"{tmp_path}/f", sums).count() == 0
    (tmp_path / "f" / "a.txt").write_bytes(b"abd")
    assert tables.verified(spark, f"{tmp_path}/f", sums).count() == 1


def test_log_and_features(spark, tmp_path):
    (tmp_path / "log").write_text("parsed 45 relations\ninvalid 3\naccepted 42 turns\n")
    got = {r["name"]: (r["n"], r["value"]) for r in tables.log_counts(spark, f"{tmp_path}/log", {"p": r"parsed (\d+)", "i": r"invalid (\d+)", "a": r"accepted (\d+)", "x": r"none (\d+)"}).collect()}
    assert got == {"p": (1, 45), "i": (1, 3), "a": (1, 42), "x": (0, None)}
    (tmp_path / "g.xml").write_text("<c><f><name>A</name><pos>0 0 1 0 1 1 0 0</pos></f><f><name>B</name><pos>5 5 6 5 5 5</pos></f></c>")
    f = tables.read_features(spark, f"{tmp_path}/g.xml", "f", "name string, pos string").withColumn("p", tables.positions(F.col("pos")))
    assert {r["name"]: r["n"] for r in tables.ring_segments(f, ["name"], "p").groupBy("name").agg(F.count("*").alias("n")).collect()} == {"A": 3, "B": 2}
    j = json.dumps({"type": "Polygon", "coordinates": [[[0, 1], [2, 3]]]})
    assert spark.createDataFrame([(j,)], "j string").select(tables.geojson_coordinates(F.col("j"))).first()[0] == [[0.0, 1.0], [2.0, 3.0]]
    assert tables.dumps({"b": 1, "a": 2}).startswith('{\n  "a": 2')


def test_relations(spark):
    members = [("w", 10, "from"), ("n", 2, "via"), ("w", 12, "to")]
    df = spark.createDataFrame([(members, "no_u_turn", [1, 2], [2, 5]), (members[:1], "no_left_turn_on_red", [1, 9], [2, 5])], "m array<struct<type string, ref bigint, role string>>, k string, a array<bigint>, b array<bigint>")
    got = df.select(tables.restriction_shape(F.col("m"), F.col("k")).alias("s"), tables.via_path(F.col("a"), F.col("b"), F.lit(2).cast("bigint")).alias("v")).collect()
    assert got[0]["s"]["fits"] and got[0]["s"]["rule"] == "no" and tuple(got[0]["v"]) == (1, 2, 5)
    assert not got[1]["s"]["fits"] and got[1]["s"]["rule"] is None and got[1]["v"] is None
    ways = spark.createDataFrame([(10, [1, 2, 3]), (11, [4])], "way_id bigint, nodes array<bigint>")
    assert sorted(tuple(r) for r in tables.segments_of(ways).collect()) == [(10, 0, 1, 2), (10, 1, 2, 3)]
    turns = spark.createDataFrame([(1, 2, True, True, 5), (3, 4, False, True, 6)], "source int, target int, forward boolean, backward boolean, seconds int")
    assert sorted(tuple(r) for r in tables.directed(turns).collect()) == [(1, 2, 5), (2, 1, 5), (4, 3, 6)]
