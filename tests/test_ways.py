"""Profile rules, legal segments, restriction proof, start directions, contracts, manifests on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from wayfold.audit import contracts
from wayfold.functions import text
from wayfold.functions.profile import Profile
from wayfold.operators import relational, restrictions, ways
from wayfold.sources import features, manifest, tables

WAYS = "way_id bigint, tags map<string,string>, nodes array<bigint>"
RELATIONS = "relation_id bigint, tags map<string,string>, members array<struct<type string, ref bigint, role string>>"


def test_fixture_ways(spark):
    rows = [(10, {"highway": "residential", "maxspeed": "30", "oneway": "alternating"}, [1, 2]), (11, {"highway": "service", "access": "private"}, [2, 3]), (12, {"route": "ferry"}, [3, 4]), (13, {"highway": "primary", "smoothness": "impassable"}, [4, 5]), (14, {"highway": "path"}, [5, 6]), (15, {"highway": "motorway", "bridge": "movable", "maxwidth": "1,5"}, [6, 7, 8]), (16, {"highway": "service"}, [1])]
    df, p = spark.createDataFrame(rows, WAYS), Profile()
    got = sorted((r["way_id"], r["direction"], r["from_node"], r["to_node"], r["speed_kmh"]) for r in ways.legal_segments(df, p).collect())
    assert got == [(10, 0, 1, 2, 24.0), (10, 1, 2, 1, 24.0)]
    assert ways.rejections(df, p).first().asDict() == {"ways_read": 7, "ferry": 2, "rejected": 6, "legal": 2}
    needed = spark.createDataFrame([(2, 1)], "from_node bigint, to_node bigint")
    assert ways.legal_segments(df, p, needed).count() == 1 and ways.ways_of(df, needed.select(F.lit(11).cast("bigint").alias("way_id"))).count() == 1
    from pyspark.sql import Observation

    seen = Observation("legal")
    ways.legal_segments(df, p, observed=seen).collect()
    assert seen.get == {"legal_candidates": 2, "backward": 1}
    graph = spark.createDataFrame([("15/1/0/7/8",)], "edge_id string")
    start = {r["name"]: r["reasons"] for r in ways.start_directions(df.where("way_id = 15"), 1, graph, p).collect()}
    assert start == {"forward": ["forbidden_by_vehicle_dimensions"], "backward": ["forbidden_by_oneway_tag", "forbidden_by_vehicle_dimensions", "directed_edge_absent_from_osrm_graph"]}
    e = spark.createDataFrame([("a", 1, 0, 5, 6), ("b", 1, 0, 6, 5), ("c", 1, 1, 5, 6)], "edge_id string, way_id int, ordinal int, from_node int, to_node int")
    assert {r["edge_id"] for r in ways.same_segment(e, e.where("edge_id = 'b'")).collect()} == {"a", "b"}


def test_tags_judged_once(spark):
    """Ways of equal tags, in whatever order and with nulls, are judged once and give the same segments and counts."""
    tags = [{"highway": "residential", "maxspeed": "30"}, {"maxspeed": "30", "highway": "residential"}, {"highway": "service", "access": None}, {"route": "ferry"}, {"highway": "service", "access": "private"}, {}, {"highway": "motorway"}]
    df, p = spark.createDataFrame([(i, tags[i % 7], list(range(i % 4))) for i in range(60)], WAYS), Profile()
    rows = lambda x: sorted(map(tuple, x.collect()), key=repr)
    assert rows(ways.legal_segments(df, p, tag_sets=df.select("tags"))) == rows(ways.legal_segments(df, p)) and ways.verdicts(df, p).count() == 6
    counted = df.select("way_id", "tags", F.greatest(F.size("nodes") - 1, F.lit(0)).alias("n"))
    got = ways.rejections(counted, p).first()
    assert got == ways.rejections(df, p).first() and got["ways_read"] == 60 and got["legal"] == ways.legal_segments(df, p).count()


def test_nodes_and_turns(spark):
    p = Profile()
    rows = [({"barrier": "gate"}, False, 60.0), ({"barrier": "bollard"}, True, 0.0), ({"barrier": "bollard", "bollard": "rising"}, False, 0.0), ({"barrier": "height_restrictor", "maxheight": "1.8"}, True, 0.0), ({"access": "private", "barrier": "gate"}, True, 0.0), ({"barrier": "kerb", "highway": "crossing"}, False, 0.0), ({}, False, 0.0)]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "i int, t map<string,string>")
    assert [tuple(r["n"]) for r in df.orderBy("i").select(p.node(F.col("t")).alias("n")).collect()] == [(b, s) for _, b, s in rows]
    t = lambda roads, u: p.turn(F.lit(90.0), F.lit(roads), F.lit(u), F.lit(False), F.array(F.lit(60.0), F.lit(2.0)))
    a, b, c = spark.range(1).select(t(2, False), t(3, False), t(2, True)).first()
    assert a == 62.0 and 62 < b < 70 and c == b + 20
    assert spark.range(1).select(p.blocked_by_limit(F.lit(" 0 mph")), p.blocked_by_limit(F.lit("none")), p.blocked_by_limit(F.lit("-5"))).first() == (True, False, True)


@pytest.mark.parametrize("rule, turns, want", [("no_u_turn", [("10/0/0/1/2", "10/0/1/2/1")], (1, 0, 1, 0)), ("no_u_turn", [], (1, 1, 0, 0)), ("only_straight_on", [("11/0/0/1/2", "13/0/0/2/4")], (1, 1, 0, 1))])
def test_restriction_partition(spark, rule, turns, want):
    """Way 10 and 11 run in parallel from 1 to 2; 12 and 13 lead on to 3 and 4."""
    w = spark.createDataFrame([(i, {}, n) for i, n in ((10, [1, 2]), (11, [1, 2]), (12, [2, 3]), (13, [2, 4]))], WAYS)
    to = 10 if rule == "no_u_turn" else 12
    rel = spark.createDataFrame([(20, {"restriction": rule}, [("w", 10, "from"), ("n", 2, "via"), ("w", to, "to")]), (21, {"restriction": "no_left_turn_on_red"}, []), (22, {"restriction": "no_left_turn", "except": "bus;motorcar"}, [("w", 10, "from"), ("n", 2, "via"), ("w", 13, "to")]), (23, {"type": "route"}, [])], RELATIONS)
    ids = ["10/0/0/1/2", "11/0/0/1/2"] + (["10/0/1/2/1"] if to == 10 else ["12/0/0/2/3", "13/0/0/2/4"])
    e = spark.createDataFrame([(i, int(i.split("/")[0]), int(i.split("/")[3]), int(i.split("/")[4])) for i in ids], "edge_id string, way_id bigint, from_node bigint, to_node bigint")
    t = spark.createDataFrame(turns, "in_edge string, out_edge string")
    direct = restrictions.direct(ways.restrictions(rel))
    assert [r["relation_id"] for r in direct.collect()] == [20]
    parts = restrictions.partition(restrictions.transitions(restrictions.paths(direct, w), e), t)
    c = restrictions.certificate(parts).first()
    assert (c["candidates"], c["prohibited"], c["observed"], c["legacy"]) == want and c["is_partition"]
    if want[3]:
        assert parts.where("status = 'legacy'").first()["reasons"] == [restrictions.OTHER_WAY]
    assert restrictions.sample(parts, "prohibited").count() == want[1]


def _shuffled(spark, run):
    """The result of run() and the bytes that it shuffled."""
    store, gate = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total():
        stages = store.stageList(None, False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    out = run()
    return out, total() - before


def test_restrictions_at_nodes(spark):
    """The same parts as over a stored turn table, with parallel ways, a loop and a way out that is missing; a hub's pairs are not shuffled."""
    ends = [(1, 5, 9), (2, 5, 9), (3, 9, 9), (4, 9, 7), (5, 9, 8), (6, 9, 7), (7, 8, 9), (8, 5, 9)]
    e = spark.createDataFrame([(f"{w}/0/0/{a}/{b}", w, a, b, w * 3) for w, a, b in ends], "edge_id string, way_id bigint, from_node bigint, to_node bigint, x bigint")
    paths = [(1, 11, "no", 1, 4, 5, 9, 7), (2, 12, "only", 2, 5, 5, 9, 8), (3, 13, "only", 3, 3, 9, 9, 9), (4, 14, "no", 7, 99, 8, 9, 7), (5, 15, "no", 1, 4, 5, 9, 7), (6, 16, "only", 42, 5, 5, 9, 8), (7, 17, "only", 8, 98, 5, 9, 8)]
    p = spark.createDataFrame(paths, "path bigint, relation_id bigint, rule string, from_way bigint, to_way bigint, from_node bigint, via_node bigint, to_node bigint")
    rule = (F.col("in_x") + F.col("out_x")) % 2 == 0
    a, b = e.select(F.col("edge_id").alias("in_edge"), F.col("to_node").alias("v"), F.col("x").alias("in_x")), e.select(F.col("edge_id").alias("out_edge"), F.col("from_node").alias("v"), F.col("x").alias("out_x"))
    want = restrictions.partition(restrictions.transitions(p, e.drop("x")), a.join(b, "v").where(rule).select("in_edge", "out_edge"))
    got = restrictions.at_nodes(p, e, rule)
    rows = lambda df: sorted(map(tuple, df.select("in_edge", "out_edge", "relations", "reasons", "status").collect()))
    assert rows(got) == rows(want) and {r[4] for r in rows(got)} == {"prohibited", "observed", "legacy"}
    hub = spark.range(3000).select(F.concat_ws("/", F.col("id"), F.lit("0/0/1/2")).alias("edge_id"), F.col("id").alias("way_id"), F.when(F.col("id") < 1500, 1).otherwise(2).cast("bigint").alias("from_node"), F.when(F.col("id") < 1500, 2).otherwise(3 + F.col("id")).cast("bigint").alias("to_node"), F.col("id").alias("x"))
    at = hub.where("way_id < 1500").select(F.col("way_id").alias("path"), F.col("way_id").alias("relation_id"), F.lit("only").alias("rule"), F.col("way_id").alias("from_way"), F.lit(1500).cast("bigint").alias("to_way"), F.lit(1).cast("bigint").alias("from_node"), F.lit(2).cast("bigint").alias("via_node"), F.lit(1503).cast("bigint").alias("to_node"))
    c, size = _shuffled(spark, lambda: restrictions.certificate(restrictions.at_nodes(at.where("path < 3"), hub, rule)).drop("digest").first())
    assert c["candidates"] == 3 * 1499 and c["is_partition"] and size < 2_000_000


def test_rule_replay(spark):
    """A turn table that is a rule gives the same replay as a stored one."""
    from wayfold.operators import turns

    rows = [(r, k, r * 10 + k, (r * 7 + k * 3) % 5, (r * 7 + (k + 1) * 3) % 5 if (r, k) != (3, 1) else 9, (r * k) % 60 + 1, 5, (k % 3 == 0) * 2) for r in range(6) for k in range(4)]
    e = spark.createDataFrame([(str(w), *x) for *x, w in [(r, k, a, b, c, n, m, i) for r, k, i, a, b, c, n, m in rows]], "edge_id string, route bigint, pos bigint, from_node bigint, to_node bigint, cost bigint, length bigint, mask int")
    cost = lambda x, y: F.when(x % 3 != y % 3, (x + y) % 7)
    a, b = e.select(F.col("edge_id").alias("in_edge"), F.col("to_node").alias("v"), F.col("cost").alias("x")), e.select(F.col("edge_id").alias("out_edge"), F.col("from_node").alias("v"), F.col("cost").alias("y"))
    met = a.join(b, "v").select("in_edge", "out_edge", cost(F.col("x"), F.col("y")).alias("turn_cost")).where("turn_cost IS NOT NULL")
    columns = ["route", "steps", "cost", "length", "illegal", "broken", "missing", "order", "certified"]
    want = turns.replayed(e.select("route", "pos", "edge_id"), e, met, 3)
    got = turns.replayed_by_rule(e, e.where("mask <> 0").select("route", "pos", "mask"), cost(F.col("before_cost"), F.col("cost")), 3)
    both = [sorted(map(tuple, df.select(*columns).collect())) for df in (want, got)]
    assert both[0] == both[1] and sum(r[5] for r in both[1]) > 0 and sum(r[4] for r in both[1]) > 0


def test_version_counts(spark):
    """Counts at nodes are those of the pairs, with parallel edges, loops and nulls; a hub's pairs are not shuffled."""
    from wayfold.operators import turns

    v = spark.createDataFrame([(1, 2, 50), (1, 2, 1), (2, 1, 50), (2, 1, 1), (2, 2, 50), (2, 3, 1), (3, 2, 20), (2, 4, None), (None, 2, 50), (4, None, 1)], "from_node bigint, to_node bigint, d bigint")
    v = v.withColumn("i", F.monotonically_increasing_id())
    p = v.select(F.col("i").alias("a"), F.col("from_node").alias("f"), F.col("to_node").alias("v"), F.col("d").alias("x")).join(v.select(F.col("i").alias("b"), F.col("from_node").alias("v"), F.col("to_node").alias("t"), F.col("d").alias("y")), "v")
    change = F.when((F.col("x") > 40) & (F.col("y") >= 5), "removed").when((F.col("x") <= 40) & (F.col("y") < 5), "added")
    want = p.withColumn("change", change).where("change IS NOT NULL").groupBy("change", F.when(F.col("f") == F.col("t"), "u_turn").otherwise("ordinary_turn").alias("kind")).count()
    got = turns.version_counts(v, F.col("d") > 40, F.col("d") < 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    hub = spark.range(40000).select(F.when(F.col("id") < 20000, F.col("id") + 10).otherwise(1).alias("from_node"), F.when(F.col("id") < 20000, 1).otherwise(F.col("id") + 10).alias("to_node"), (F.col("id") % 2 * 50).alias("d"))
    n, size = _shuffled(spark, lambda: sorted(map(tuple, turns.version_counts(hub, F.col("d") > 40, F.col("d") < 5).collect())))
    assert n == [("added", "ordinary_turn", 10**8), ("removed", "ordinary_turn", 10**8)] and size < 4_000_000


def test_contracts(spark):
    schema = "edge_id string, from_node bigint, to_node bigint, length_m double, duration_s double, speed_kmh double, access string, ferry string"
    good = [("10/0/0/1/2", 1, 2, 68.3, 10.3, 24.0, "public_default", "not_ferry"), ("10/0/1/2/1", 2, 1, 68.3, 10.2, 24.0, "allowed:yes", "not_ferry")]
    e = spark.createDataFrame(good, schema)
    t = spark.createDataFrame([("10/0/0/1/2", "10/0/1/2/1", 20.0, "allowed")], "in_edge string, out_edge string, turn_s double, status string")
    assert contracts.certified(e, t)["status"] == "PASS"
    bad = e.unionByName(spark.createDataFrame([("11/0/0/1", 1, 2, float("nan"), -1.0, 0.0, "forbidden:private", "ferry")], schema))
    got = contracts.certified(bad, t.unionByName(t), {"n": 1}, [contracts.Rule("n", lambda m: m["n"] == 1), contracts.Rule("missing", lambda m: m["x"] > 0)])
    assert got["status"] == "FAIL" and [k for k, v in got["edges"]["checks"].items() if v] == ["unique"] and not got["turns"]["checks"]["unique"] and got["stage"]["checks"] == {"n": True, "missing": False}
    loaded = contracts.loaded(e.select("edge_id", F.col("duration_s").alias("cost"), F.col("length_m").alias("length"), F.lit(3).alias("mask")), t.select("in_edge", "out_edge", F.col("turn_s").alias("turn_cost")), 2, {"edges": 2, "turns": 1})
    assert loaded["status"] == "PASS" and len(loaded["checks"]) == 8
    assert contracts.same_build(e, e.repartition(3)) and not contracts.same_build(e, bad)
    want = hashlib.sha256(b"10/0/0/1/2\t1\n10/0/1/2/1\t2\n").hexdigest()
    assert contracts.ordered_digest(e, "edge_id", "from_node").first()[0] == want
    assert contracts.documents_differ({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 1, "c": 3}, "e": 1}) == ["/a/c", "/d", "/e"]
    assert contracts.has_schema(e, "edge_id string, from_node int, x int") != [] and contracts.has_schema(e, e.schema) == []
    assert contracts.same_features(e, e.limit(1), "edge_id").first() == (1, 0, 0)
    assert contracts.one_match(e.limit(1).select("edge_id"), e, ["edge_id"]).count() == 1
    with pytest.raises(Exception, match="features of a target"):
        contracts.one_match(e.select("edge_id"), e.unionByName(e), ["edge_id"]).collect()
    with pytest.raises(ValueError, match="SHA-256"):
        contracts.pinned(b"x", "0", "input")
    assert contracts.within_budget(spark.createDataFrame([("a", 5), ("b", 6)], "name string, bytes bigint"), 10).first() == (2, 11, False)
    new = t.withColumn("out_edge", F.lit("11/0/0/2/3"))
    key = lambda df: df.select("in_edge", "out_edge", "turn_s")
    diff = contracts.turn_versions(key(t), key(new), new.select("in_edge", "out_edge", F.array(F.lit(7).cast("bigint")).alias("relations")))
    assert contracts.causes(diff) == {"removed/u_turn/unexplained": 1, "added/ordinary_turn/relation": 1}
    rows = spark.createDataFrame([("a", [0, 1], "FEASIBLE", 7, 60, 2, None), ("b", [0, 1], "TIMEOUT", None, None, 2, "late")], "route string, order array<int>, category string, cost bigint, length bigint, reached int, reason string")
    assert contracts.outcomes(rows, 2, ("FEASIBLE", "TIMEOUT"), 1, ("a",))["status"] == "PASS" and contracts.outcomes(rows, 3, ("FEASIBLE",))["status"] == "FAIL"
    assert relational.strictly_ascending(spark.range(100).select("id", F.when(F.col("id") == 50, 0).otherwise(F.col("id")).alias("k")), "k", "id", 7).first() == (100, 1)
    assert relational.gaps(spark.createDataFrame([(0,), (1,), (3,)], "k int"), "k").first()["is_dense"] is False
    with pytest.raises(Exception, match="no real row"):
        relational.collapsed(spark.createDataFrame([(1, 0, False, 5)], "g int, i int, r boolean, ds int"), "g", ["i"], F.col("r"), "ds", strict=True).collect()


def test_text(spark):
    df = spark.createDataFrame([("Łódź́", "{urn:x}Gmina", "'a b'", '<a timeStamp="2024-01-01" b="">', "urn:ogc:def:crs:EPSG::2180")], "a string, b string, c string, d string, e string")
    r = df.select(text.city_key(F.lit("KRAKÓW")), text.layer_label(F.lit("  Granice: Gmín — 2 ")), text.local_name(F.col("b")), text.unquoted(F.col("c")), text.alias(F.lit("x"), {"x": "y"}), text.timestamp_of(F.col("d")), text.without_timestamp(F.col("d"), "T"), text.epsg_of(F.col("e")), text.order_text(F.array(F.lit("a"), F.lit("b")))).first()
    assert tuple(r) == ("kraków", "granice_gmin_2", "Gmina", "a b", "y", "2024-01-01", '<a timeStamp="T" b="">', 2180, "a -> b")
    assert "<fes:Or>" in text.or_filter("k", ["1", "<2"]) and "&lt;2" in text.or_filter("k", ["<2"]) and text.peak_rss_kb() > 0 and text.srs_name(2180).endswith("2180")
    events = F.array(F.struct(F.lit(2).alias("bit"), F.lit("b").alias("c")), F.struct(F.lit(1).alias("bit"), F.lit("a").alias("c")))
    assert spark.range(1).select(text.event_json(events)).first()[0] == '[{"bit":1,"c":"a"},{"bit":2,"c":"b"}]'
    assert text.value_at({"a": [{"b": 3}]}, "a", 0, "b") == 3 and text.value_at({}, "a") is None
    assert spark.range(1).select(text.is_multipart(F.unhex(F.lit("0106000000"))), text.is_multipart(F.unhex(F.lit("0000000003")))).first() == (True, False)


def test_features_and_manifests(spark, tmp_path):
    (tmp_path / "g.xml").write_text("<c><f><key>01</key><name>A</name><id>x1</id><srs>urn:ogc:def:crs:EPSG::2180</srs><exterior>0 0 4 0 4 4 0 0</exterior><interior>1 0 2 0 2 1 1 0</interior></f><f><key>02</key><name>B</name><id>x2</id><srs>EPSG:2180</srs></f></c>")
    rings = features.read_geometries(spark, f"{tmp_path}/g.xml", "f", {"01": "A"}, 2180).orderBy("ring").collect()
    assert [(r["is_hole"], len(r["points"])) for r in rings] == [(False, 4), (True, 4)]
    with pytest.raises(ValueError, match="expected one named Z"):
        features.read_geometries(spark, f"{tmp_path}/g.xml", "f", {"01": "Z"}, 2180)
    (tmp_path / "cap.xml").write_text("<w><FeatureType><Name>ms:A03_Gminy</Name><Title>t</Title></FeatureType><FeatureType><Name>ms:A02</Name><Title>u</Title></FeatureType></w>")
    assert features.only_layer(spark, f"{tmp_path}/cap.xml", "a03_gminy") == "ms:A03_Gminy"
    with pytest.raises(ValueError, match="feature types"):
        features.only_layer(spark, f"{tmp_path}/cap.xml", "none")
    (tmp_path / "s.xsd").write_text('<schema><element name="JPT" type="xs:string"/><element name="geom" type="gml:Multi"/></schema>')
    assert features.fields(spark, f"{tmp_path}/s.xsd", ("JPT",)) == {"JPT": "string", "geom": "Multi"}
    with pytest.raises(ValueError, match="missing fields: id"):
        features.fields(spark, f"{tmp_path}/s.xsd", ("id",))
    m = manifest.parse_manifest("a: 1\nlist:\n  - x: 'yes'\n    y: 2.5\n  - x: no # c\ntext: >-\n  two\n  words\nempty: null\nflat:\n- 1\n- b\nnest:\n  k:v: true\n")
    assert m == {"a": 1, "list": [{"x": "yes", "y": 2.5}, {"x": "no"}], "text": "two words", "empty": None, "flat": [1, "b"], "nest": {"k:v": True}}
    targets = [{"bit": 0, "city": "A", "code": "0101", "unit": "01", "lon": 20, "lat": 52}, {"bit": 2, "city": "A", "code": "0201", "unit": "03", "lon": 200, "lat": 52}]
    assert len(manifest.target_faults(targets, 3)) == 5 and manifest.target_faults(targets[:1], 1) == []
    import zstandard

    raw = b"<gml/>"
    (tmp_path / "r.zst").write_bytes(zstandard.compress(raw))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest.materialised(f"{tmp_path}/r.zst", f"{tmp_path}/r.gml", sha((tmp_path / "r.zst").read_bytes()), sha(raw))
    assert (tmp_path / "r.gml").read_bytes() == raw
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes(b"abc")
    assert manifest.sums_text(spark, f"{tmp_path}/t") == f"{sha(b'abc')}  a.txt\n"
    (tmp_path / "x.tsv.zst").write_bytes(zstandard.compress(b"a\t1\n"))
    assert manifest.read_maybe_packed(spark, f"{tmp_path}/x.tsv", "a string, b int").first() == ("a", 1)
    lin = manifest.lineage(spark.createDataFrame([("p", "1")], "name string, sha256 string"), {"in": "2"}, "3").first()
    assert lin["inputs"] == {"in": "2"} and json.loads(manifest.contract(("a",), {"m": 0.0}, {"t": "x int"}))["classes"] == ["a"]
    assert "| n | 1 |" in manifest.report("T", {"s": {"n": 1}, "l": ["x"]})
    inv = spark.createDataFrame([(2, "b"), (1, "a")], "bit int, city string")
    manifest.write_inventory(inv, f"{tmp_path}/inv", "bit")
    assert [r["city"] for r in manifest.read_csv(spark, f"{tmp_path}/inv/inventory-csv", "bit int, city string").collect()] == ["a", "b"]
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 0.0))])
    features.write_geojson(inv.select(features.geojson(F.col("bit"), square, F.struct("city")).alias("feature")), f"{tmp_path}/o.geojson")
    assert len(json.loads((tmp_path / "o.geojson").read_text())["features"]) == 2
    (tmp_path / "log").write_text("parsed 45 relations\ninvalid 3\naccepted 42 turns\n")
    pats = {"p": r"parsed (\d+)", "i": r"invalid (\d+)", "a": r"accepted (\d+)"}
    assert tables.required_counts(spark, f"{tmp_path}/log", pats, "p", ("i", "a"))["p"] == 45
    with pytest.raises(ValueError, match="exactly one line: x"):
        tables.required_counts(spark, f"{tmp_path}/log", pats | {"x": r"none (\d+)"})
