"""Registered queries of the road-graph operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bits, fractions, geo, ids, tags
from ..operators import geometry, graph, relational
from .carrier import BITS, EDGES, EVENT_TYPES, HITS, LINES, MARKS, PAIRS, TIES, edges, hits, lines, marks, pairs, table

REGISTRY: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


@query(f"""WITH {EDGES}, {MARKS}, steps AS (
  SELECT route, pos, to_node, duration_ds, bit FROM edges LEFT JOIN marks ON to_node = node
), first AS (SELECT route, bit, min(pos) AS p0 FROM steps WHERE bit IS NOT NULL GROUP BY ALL),
orders AS (SELECT route, string_agg(CAST(bit AS VARCHAR), '>' ORDER BY p0, bit) AS visited FROM first GROUP BY route),
cost AS (SELECT route, CAST(sum(duration_ds) AS BIGINT) AS cost_ds, count(*) AS steps FROM edges GROUP BY route)
SELECT cost.route, coalesce(visited, '') AS visited, cost_ds, steps FROM cost LEFT JOIN orders USING (route)""")
def path_replay(spark, d) -> DataFrame:
    """Each order's walk: marks in the order of first visits, and its cost."""
    walk = edges(spark, d)
    steps = walk.join(marks(spark, d), F.col("to_node") == F.col("node"), "left").withColumn("mask", F.when(F.col("bit").isNotNull(), bits.bit(F.col("bit"))))
    order = relational.first_hits(steps.where("mask IS NOT NULL"), "route", "pos", "mask", BITS)
    cost = walk.groupBy("route").agg(F.sum("duration_ds").alias("cost_ds"), F.count(F.lit(1)).alias("steps"))
    visited = F.coalesce(F.array_join(F.transform("order", lambda b: b.cast("string")), ">"), F.lit(""))
    return cost.join(order, "route", "left").select("route", visited.alias("visited"), "cost_ds", "steps")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_shipdate >= TIMESTAMP '2000-01-01' AND l_quantity < 5")
def scan_project_filter(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").where("l_returnflag = 'A' AND l_shipdate >= TIMESTAMP '2000-01-01' AND l_quantity < 5").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


@query(f"""WITH {EDGES} SELECT edge_id, printf('%020d/%020d', from_node, to_node) AS pair_key, edge_id || '@1' AS child_id,
  CAST(split_part(edge_id, '/', 1) AS BIGINT) AS way, CAST(split_part(edge_id, '/', 5) AS BIGINT) AS last_node FROM edges""")
def stable_ids(spark, d) -> DataFrame:
    parsed = ids.parse_stable_id(F.col("edge_id"))
    return edges(spark, d).select("edge_id", ids.pair_key(F.col("from_node"), F.col("to_node")).alias("pair_key"), ids.child_id(F.col("edge_id"), F.lit(1)).alias("child_id"), parsed[0].alias("way"), parsed[4].alias("last_node"))


@query(f"""WITH {EDGES} SELECT route, sha256(string_agg(edge_id, chr(10) ORDER BY pos)) AS path_hash,
  sha256(string_agg(edge_id || chr(10), '' ORDER BY pos)) AS lines_hash, sha256(CAST(route AS VARCHAR) || '|' || count(*)) AS content_id FROM edges GROUP BY route""")
def content_hash_ids(spark, d) -> DataFrame:
    path = F.transform(F.array_sort(F.collect_list(F.struct("pos", "edge_id"))), lambda x: x["edge_id"])
    got = edges(spark, d).groupBy("route").agg(path.alias("path"))
    return got.select("route", ids.path_hash(F.col("path")).alias("path_hash"), ids.lines_hash(F.col("path")).alias("lines_hash"), ids.content_id(F.col("route"), F.size("path")).alias("content_id"))


@query("""SELECT s_suppkey, CAST(round(least(1::DECIMAL(30,18), greatest(0::DECIMAL(30,18), CAST(s_suppkey * 0.001 - 0.02 AS DECIMAL(30,18)))), 12) AS DECIMAL(13,12))::VARCHAR AS fraction FROM supplier""")
def canonical_fraction(spark, d) -> DataFrame:
    x = F.col("s_suppkey") * F.lit("0.001").cast("decimal(4,3)") - F.lit("0.02").cast("decimal(3,2)")
    return table(spark, d, "supplier").select("s_suppkey", fractions.canonical_fraction(x).cast("string").alias("fraction"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 3 WHEN o_totalprice >= 300000 THEN 2 WHEN o_totalprice >= 150000 THEN 1 ELSE 0 END AS interval_no FROM orders""")
def interval_lookup(spark, d) -> DataFrame:
    breaks = F.array(*[F.lit(float(x)) for x in (0, 150000, 300000, 400000, 10**12)])
    return table(spark, d, "orders").select("o_orderkey", fractions.containing_interval(breaks, F.col("o_totalprice")).alias("interval_no"))


def _limits(spark, d) -> DataFrame:
    p, k, w = table(spark, d, "part"), F.col("p_partkey") % 5, F.col("p_partkey") % 4
    speed = F.when(k == 0, "50").when(k == 1, "30 mph;40").when(k == 2, "walk").when(k == 3, " 80;60 ").otherwise("")
    weight = F.when(w == 0, "3,5 t").when(w == 1, "7500 kg").when(w == 2, "12").otherwise("none")
    return p.select("p_partkey", "p_size", speed.alias("maxspeed"), weight.alias("maxweight"))


@query("""SELECT p_partkey, speed_kmh, weight_kg, least(speed_kmh, 90.0::DOUBLE, p_size * 2.0::DOUBLE) AS capped FROM (SELECT p_partkey, p_size,
  CASE p_partkey % 5 WHEN 0 THEN 50.0::DOUBLE WHEN 1 THEN 40.0::DOUBLE WHEN 3 THEN 60.0::DOUBLE END AS speed_kmh,
  CASE p_partkey % 4 WHEN 0 THEN 3500.0::DOUBLE WHEN 1 THEN 7500.0::DOUBLE WHEN 2 THEN 12000.0::DOUBLE END AS weight_kg FROM part)""")
def parse_limits(spark, d) -> DataFrame:
    speed = F.round(tags.numeric_speed(F.col("maxspeed")), 6)
    return _limits(spark, d).select("p_partkey", speed.alias("speed_kmh"), F.round(tags.dimension(F.col("maxweight"), "weight"), 6).alias("weight_kg"), tags.capped_speed(speed, F.lit(90.0), F.col("p_size") * 2.0).alias("capped"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'no' WHEN 'F' THEN '' END AS forward, CASE o_orderpriority WHEN '1-URGENT' THEN 'yes' WHEN '5-LOW' THEN 'private' END AS general FROM orders),
  v AS (SELECT o_orderkey, coalesce(nullif(forward, ''), nullif(general, '')) AS v FROM t)
  SELECT o_orderkey, CASE WHEN v IS NULL THEN 'public_default' WHEN v IN ('yes', 'motorcar', 'motor_vehicle', 'vehicle', 'permissive', 'designated') THEN 'allowed:' || v ELSE 'forbidden:' || v END AS decision FROM v""")
def access_hierarchy(spark, d) -> DataFrame:
    forward = F.when(F.col("o_orderstatus") == "P", "no").when(F.col("o_orderstatus") == "F", "")
    both = F.when(F.col("o_orderpriority") == "1-URGENT", "yes").when(F.col("o_orderpriority") == "5-LOW", "private")
    tagged = table(spark, d, "orders").select("o_orderkey", F.create_map(F.lit("motorcar:forward"), forward, F.lit("access"), both).alias("tags"))
    return tagged.select("o_orderkey", tags.access_decision(tags.access_value(F.col("tags"), "forward")).alias("decision"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN true ELSE true END AS forward,
  CASE p_partkey % 6 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS back FROM part""")
def one_way(spark, d) -> DataFrame:
    k = F.col("p_partkey") % 6
    oneway = F.when(k == 0, "yes").when(k == 1, "-1").when(k == 2, "no")
    junction, highway = F.when(k == 3, "roundabout"), F.when(k == 4, "motorway").otherwise("residential")
    flags = tags.directions(F.create_map(F.lit("oneway"), oneway, F.lit("junction"), junction), highway)
    return table(spark, d, "part").select("p_partkey", flags["forward"].alias("forward"), flags["back"].alias("back"))


@query("""SELECT s_suppkey, round(CASE WHEN a >= 0 THEN 7.5 / (1 + exp(-((13 / 1.075) * a / 180 - 6.5 * 1.075))) ELSE 7.5 / (1 + exp(-((13 * 1.075) * -a / 180 - 6.5 / 1.075))) END
  + CASE WHEN u THEN 20.0 ELSE 0.0 END, 6) AS penalty_s FROM (SELECT s_suppkey, CAST(s_suppkey % 361 - 180 AS DOUBLE) AS a, s_suppkey % 7 = 0 AS u FROM supplier)""")
def turn_penalty(spark, d) -> DataFrame:
    angle = (F.col("s_suppkey") % 361 - 180).cast("double")
    return table(spark, d, "supplier").select("s_suppkey", F.round(geo.turn_penalty(angle, F.col("s_suppkey") % 7 == 0), 6).alias("penalty_s"))


@query(f"""WITH {HITS}, m AS (SELECT user_id, bit_or(mask) AS mask FROM hits GROUP BY user_id)
  SELECT user_id, mask, CAST(bit_count(mask) AS INTEGER) AS n, concat_ws(',', {", ".join(f"CASE WHEN mask & {1 << i} > 0 THEN '{e}' END" for i, e in enumerate(EVENT_TYPES))}) AS names FROM m""")
def mask_decode(spark, d) -> DataFrame:
    m = hits(spark, d).groupBy("user_id").agg(F.bit_or("mask").alias("mask"))
    return m.select("user_id", "mask", F.bit_count("mask").alias("n"), F.array_join(bits.names(F.col("mask"), EVENT_TYPES), ",").alias("names"))


@query(f"""WITH {HITS} SELECT user_id, bit_or(CASE WHEN value > 50 THEN mask ELSE 0 END) AS inner_mask, bit_or(CASE WHEN value > 10 THEN mask ELSE 0 END) AS outer_mask,
  bit_or(CASE WHEN value > 50 THEN mask ELSE 0 END) & ~bit_or(CASE WHEN value > 10 THEN mask ELSE 0 END) = 0 AS nests FROM hits GROUP BY user_id""")
def mask_nesting(spark, d) -> DataFrame:
    part = lambda v: F.bit_or(F.when(F.col("value") > v, F.col("mask")).otherwise(0))
    m = hits(spark, d).groupBy("user_id").agg(part(50).alias("inner_mask"), part(10).alias("outer_mask"))
    return m.withColumn("nests", bits.nested(F.col("inner_mask"), F.col("outer_mask")))


@query("""WITH s AS (SELECT l_partkey, l_suppkey, min(abs(CAST(round(l_extendedprice * 100) AS BIGINT) - CAST(round(p_retailprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT))) AS err FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
  SELECT l_partkey AS p_partkey, arg_min(l_suppkey, err * 1000000 + l_suppkey) AS supplier, min(err) AS err FROM s GROUP BY l_partkey""")
def merge_join_argmin(spark, d) -> DataFrame:
    """Each part's supplier with the least price error; ties by supplier."""
    part = table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("bigint").alias("price"))
    sold = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("paid"), F.col("l_quantity").cast("bigint").alias("q"))
    err = F.abs(F.col("paid") - F.col("price") * F.col("q"))
    best = relational.argmin_join(part, sold, ["p_partkey"], [err, F.col("l_suppkey")], "best")
    return best.select("p_partkey", F.col("best.l_suppkey").alias("supplier"), F.abs(F.col("best.paid") - F.col("price") * F.col("best.q")).alias("err"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unmatched_keys(spark, d) -> DataFrame:
    sold = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.unmatched(table(spark, d, "orders").select("o_orderkey"), sold, "o_orderkey")


@query(f"""WITH {EDGES} SELECT count(*) AS n_edges, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = from_node)) AS dangling_from,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = to_node AND p_size > 5)) AS dangling_to FROM edges""")
def dangling_endpoints(spark, d) -> DataFrame:
    nodes = table(spark, d, "part").select("p_partkey", "p_size")
    e = edges(spark, d).join(nodes.select(F.col("p_partkey").alias("a")), F.col("from_node") == F.col("a"), "left")
    e = e.join(nodes.where("p_size > 5").select(F.col("p_partkey").alias("b")), F.col("to_node") == F.col("b"), "left")
    return e.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("a").isNull()).alias("dangling_from"), F.count_if(F.col("b").isNull()).alias("dangling_to"))


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))")
def semi_pushdown(spark, d) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").join(c, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(o, "l_orderkey", "left_semi").select("l_partkey").distinct()


@query(f"WITH {LINES} SELECT l_orderkey, arg_min(l_partkey, pos) AS first_value, arg_max(l_partkey, pos) AS last_value, count(*) AS n FROM lines GROUP BY l_orderkey")
def first_last_per_group(spark, d) -> DataFrame:
    return relational.first_last(lines(spark, d), "l_orderkey", "l_partkey", ["pos"])


@query(f"""WITH {EDGES}, ends AS (SELECT route, arg_max(edge_id, pos) AS last_edge, arg_min(edge_id, pos) AS first_edge FROM edges GROUP BY route)
  SELECT a.route AS in_route, b.route AS out_route, a.last_edge AS in_edge, b.first_edge AS out_edge FROM ends a JOIN ends b ON b.route = a.route + 1""")
def positional_join(spark, d) -> DataFrame:
    """A dense key takes the place of an array index: the last edge of a route and the first of the next."""
    e = relational.first_last(edges(spark, d), "route", "edge_id", ["pos"])
    out = e.select((F.col("route") - 1).alias("in_route"), F.col("route").alias("out_route"), F.col("first_value").alias("out_edge"))
    return e.select(F.col("route").alias("in_route"), F.col("last_value").alias("in_edge")).join(out, "in_route").select("in_route", "out_route", "in_edge", "out_edge")


@query(f"WITH {LINES}, m AS (SELECT l_orderkey, max(pos) AS last FROM lines GROUP BY 1) SELECT o_orderkey, coalesce(last, 0) AS last FROM orders LEFT JOIN m ON o_orderkey = l_orderkey")
def default_left_join(spark, d) -> DataFrame:
    last = lines(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("pos").alias("last"))
    return relational.with_default(table(spark, d, "orders").select("o_orderkey"), last, "o_orderkey", "last", 0)


@query("""WITH c AS (SELECT c_nationkey, CAST(floor(min(c_acctbal)) AS BIGINT) AS lo, CAST(floor(quantile_disc(c_acctbal, 0.5)) AS BIGINT) AS hi FROM customer GROUP BY 1)
  SELECT s_suppkey, c_nationkey FROM supplier JOIN c ON floor(s_acctbal) BETWEEN lo AND hi AND abs(s_nationkey - c_nationkey) <= 2""")
def bbox_overlap_join(spark, d) -> DataFrame:
    """Ranges of nations (25 rows, so broadcast) against suppliers by two overlaps."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.floor(F.min("c_acctbal")).alias("lo"), F.floor(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY c_acctbal)")).alias("hi"))
    on = F.floor("s_acctbal").between(F.col("lo"), F.col("hi")) & (F.abs(F.col("s_nationkey") - F.col("c_nationkey")) <= 2)
    return table(spark, d, "supplier").join(F.broadcast(c), on).select("s_suppkey", "c_nationkey")


@query(f"""WITH {EDGES} SELECT f.edge_id AS in_edge, e.edge_id AS out_edge, e.duration_ds FROM edges f JOIN edges e ON f.to_node = e.from_node WHERE f.from_node = 7
  UNION ALL SELECT edge_id, edge_id || '@1', 0 FROM edges WHERE from_node = 7""")
def frontier_expand(spark, d) -> DataFrame:
    e = edges(spark, d)
    f = e.where("from_node = 7").select(F.col("edge_id").alias("in_edge"), F.col("to_node").alias("via"))
    turns = f.join(e, F.col("via") == F.col("from_node")).select("in_edge", F.col("edge_id").alias("out_edge"), "duration_ds")
    inner = f.select("in_edge", ids.child_id(F.col("in_edge"), F.lit(1)).alias("out_edge"), F.lit(0).cast("bigint").alias("duration_ds"))
    return turns.unionByName(inner)


@query("SELECT a.n_name AS source, b.n_name AS target FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey")
def ordered_pairs(spark, d) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    m = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("target"))
    return n.join(F.broadcast(m), F.col("n_nationkey") != F.col("k")).select(F.col("n_name").alias("source"), "target")


@query("""WITH s(status) AS (VALUES ('O'), ('F'), ('P'), ('X')), p(priority) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')),
  n AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT status, priority, coalesce(n, 0) AS n, (SELECT count(*) FROM orders) - coalesce(n, 0) AS others
  FROM s CROSS JOIN p LEFT JOIN n ON status = o_orderstatus AND priority = o_orderpriority""")
def counts_complement(spark, d) -> DataFrame:
    every = spark.createDataFrame([(s, p) for s in "OFPX" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")], "status string, priority string")
    n = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    filled = F.broadcast(every).join(n, ["status", "priority"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("others", F.sum("n").over(W.partitionBy()) - F.col("n"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark, d) -> DataFrame:
    return table(spark, d, "orders").rollup(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {HITS} SELECT event_type, min(user_id) AS min_user, max(user_id) AS max_user, min(value) AS min_value, max(value) AS max_value, count(*) AS n FROM hits GROUP BY event_type""")
def bbox_per_bit(spark, d) -> DataFrame:
    return hits(spark, d).groupBy("event_type").agg(F.min("user_id").alias("min_user"), F.max("user_id").alias("max_user"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDGES}, {MARKS} SELECT bit, min(edge_id) AS first_edge, count(*) AS n FROM edges JOIN marks ON to_node = node GROUP BY bit")
def min_id_per_bit(spark, d) -> DataFrame:
    return edges(spark, d).join(marks(spark, d), F.col("to_node") == F.col("node")).groupBy("bit").agg(F.min("edge_id").alias("first_edge"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey)))::VARCHAR AS suppliers FROM lineitem GROUP BY l_orderkey")
def collect_sorted_sets(spark, d) -> DataFrame:
    s = F.array_sort(F.collect_set("l_suppkey"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.transform(s, lambda x: x.cast("string")), ", "), F.lit("]")).alias("suppliers"))


@query(f"""WITH {EDGES}, {MARKS}, first AS (SELECT route, bit, min(pos) AS p0 FROM edges JOIN marks ON to_node = node GROUP BY ALL),
  o AS (SELECT route, string_agg(CAST(bit AS VARCHAR), '>' ORDER BY p0, bit) AS visited FROM first GROUP BY route), c AS (SELECT route, CAST(sum(duration_ds) AS BIGINT) AS cost FROM edges GROUP BY route)
  SELECT visited, min(cost) AS cost, arg_min(route, cost * 10000000 + route) AS route FROM o JOIN c USING (route) GROUP BY visited""")
def dedupe_cheapest(spark, d) -> DataFrame:
    return path_replay(spark, d).where("visited <> ''").groupBy("visited").agg(F.min("cost_ds").alias("cost"), F.min_by("route", F.struct("cost_ds", "route")).alias("route"))


@query("""SELECT o_orderpriority, o_orderkey, cents, rank, gap FROM (SELECT o_orderpriority, o_orderkey, cents, row_number() OVER w AS rank, lead(cents) OVER w - cents AS gap
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY cents, o_orderkey)) WHERE rank <= 3""")
def topk_gap(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return relational.top_with_gap(o, "o_orderpriority", "cents", "o_orderkey", 3)


@query(f"""WITH {LINES}, m AS (SELECT *, l_discount > 0 AS is_real, CAST(l_quantity * 10 AS BIGINT) AS ds, greatest(1, sum(CASE WHEN l_discount > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY pos)) AS g FROM lines)
  SELECT l_orderkey, CAST(g AS BIGINT) AS ordinal, CAST(sum(ds) AS BIGINT) AS ds, count(*) FILTER (NOT is_real) AS folded FROM m GROUP BY 1, 2 HAVING bool_or(is_real)""")
def collapse_degenerate(spark, d) -> DataFrame:
    x = lines(spark, d).withColumn("ds", (F.col("l_quantity") * 10).cast("bigint"))
    return relational.collapsed(x, "l_orderkey", ["pos"], F.col("l_discount") > 0, "ds").withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query(f"""WITH {LINES}, j AS (SELECT l_orderkey, pos, CAST(l_quantity AS BIGINT) AS w, CAST(round(o_totalprice * 100) AS BIGINT) AS total, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) AS s FROM lines JOIN orders ON l_orderkey = o_orderkey),
  f AS (SELECT *, CAST(total * w // s AS BIGINT) AS fl, (total * w) % s AS rest FROM j),
  r AS (SELECT *, total - sum(fl) OVER (PARTITION BY l_orderkey) AS lft, row_number() OVER (PARTITION BY l_orderkey ORDER BY rest DESC, pos) AS rk FROM f)
  SELECT l_orderkey, pos, CAST(fl + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS BIGINT) AS share FROM r""")
def largest_remainder(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total"))
    x = lines(spark, d).select("l_orderkey", "pos", F.col("l_quantity").cast("bigint").alias("w")).join(o, "l_orderkey")
    return relational.allocated(x, "l_orderkey", ["pos"], "total", "w").select("l_orderkey", "pos", "share")


@query("""SELECT count(*) AS n_groups, 0 AS n_lost FROM (SELECT DISTINCT l_orderkey FROM lineitem)""")
def preservation_totals(spark, d) -> DataFrame:
    """Shares add up to what was allocated, for every order."""
    got = largest_remainder(spark, d).groupBy("l_orderkey").agg(F.sum("share").alias("s"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total"))
    return got.join(o, "l_orderkey").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("s") != F.col("total")).cast("int").alias("n_lost"))


@query(f"WITH {EDGES} SELECT count(*) AS n, count(DISTINCT edge_id) AS n_keys, count(*) = count(DISTINCT edge_id) AS is_unique FROM edges")
def sorted_unique_audit(spark, d) -> DataFrame:
    return relational.sorted_unique(edges(spark, d), ["edge_id"], ["edge_id"])


@query(f"""WITH {EDGES} SELECT count(*) AS n, count(*) FILTER (duration_ds < 0) AS negative, count(*) FILTER (from_node = to_node) AS loops, count(*) FILTER (length_u <= 0) AS empty,
  count(*) FILTER (split_part(edge_id, '/', 4) <> CAST(from_node AS VARCHAR)) AS mismatched, CAST(sum(duration_ds) AS BIGINT) AS total_ds FROM edges""")
def edge_audit(spark, d) -> DataFrame:
    """One pass over the table for all of its rules."""
    parsed = ids.parse_stable_id(F.col("edge_id"))
    return edges(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("duration_ds") < 0).alias("negative"), F.count_if(F.col("from_node") == F.col("to_node")).alias("loops"), F.count_if(F.col("length_u") <= 0).alias("empty"),
        F.count_if(parsed[3] != F.col("from_node")).alias("mismatched"), F.sum("duration_ds").alias("total_ds"),
    )


def turns(spark, d) -> DataFrame:
    """in_edge, out_edge, via, next_node: consecutive edges of a walk."""
    w = W.partitionBy("route").orderBy("pos")
    return edges(spark, d).withColumn("in_edge", F.lag("edge_id").over(w)).withColumn("in_to", F.lag("to_node").over(w)).where("in_edge IS NOT NULL").select("in_edge", F.col("edge_id").alias("out_edge"), "in_to", F.col("from_node").alias("via"), F.col("to_node").alias("next_node"))


_TURNS = f"{EDGES}, turns AS (SELECT * FROM (SELECT lag(edge_id) OVER w AS in_edge, edge_id AS out_edge, lag(to_node) OVER w AS in_to, from_node AS via, to_node AS next_node FROM edges WINDOW w AS (PARTITION BY route ORDER BY pos)) WHERE in_edge IS NOT NULL)"


@query(f"WITH {_TURNS} SELECT count(*) AS n, count(*) FILTER (in_to <> via) AS broken, count(DISTINCT in_edge) AS n_in FROM turns")
def turn_audit(spark, d) -> DataFrame:
    return turns(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("in_to") != F.col("via")).alias("broken"), F.count_distinct("in_edge").alias("n_in"))


@query(f"WITH {_TURNS} SELECT in_edge, out_edge, 0 AS cost FROM turns")
def internal_chain(spark, d) -> DataFrame:
    return turns(spark, d).select("in_edge", "out_edge", F.lit(0).alias("cost"))


@query(f"""WITH {_TURNS}, r(kind, via_brand, next_brand) AS (VALUES ('no', 'Brand#1', 'Brand#2'), ('no', 'Brand#3', 'Brand#4'), ('only', 'Brand#5', 'Brand#6')),
  t AS (SELECT in_edge, out_edge, kind, v.p_brand AS b, n.p_brand = next_brand AS hit FROM turns JOIN part v ON via = v.p_partkey JOIN part n ON next_node = n.p_partkey JOIN r ON v.p_brand = via_brand)
  SELECT kind, b AS via_brand, count(*) AS candidates, count(*) FILTER ((kind = 'no') = hit) AS prohibited, count(*) FILTER ((kind = 'no') <> hit) AS observed FROM t GROUP BY kind, b""")
def restriction_partition(spark, d) -> DataFrame:
    """Turns at restricted nodes, split into what `no` and `only` rules prohibit and what they leave."""
    rules = spark.createDataFrame([("no", "Brand#1", "Brand#2"), ("no", "Brand#3", "Brand#4"), ("only", "Brand#5", "Brand#6")], "kind string, via_brand string, next_brand string")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    t = turns(spark, d).join(p.select(F.col("p_partkey").alias("via"), F.col("p_brand").alias("via_brand")), "via").join(F.broadcast(rules), "via_brand")
    t = t.join(p.select(F.col("p_partkey").alias("next_node"), F.col("p_brand").alias("b")), "next_node")
    gone = (F.col("kind") == "no") == (F.col("b") == F.col("next_brand"))
    return t.groupBy("kind", "via_brand").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(gone).alias("prohibited"), F.count_if(~gone).alias("observed"))


@query(f"WITH {HITS}, f AS (SELECT user_id, event_type, min(pos) AS p0 FROM hits GROUP BY ALL) SELECT user_id, string_agg(event_type, '>' ORDER BY p0) AS visited FROM f GROUP BY user_id")
def first_hit_order(spark, d) -> DataFrame:
    order = relational.first_hits(hits(spark, d), "user_id", "pos", "mask", len(EVENT_TYPES))
    every = F.array(*map(F.lit, EVENT_TYPES))
    return order.select("user_id", F.array_join(F.transform("order", lambda b: F.get(every, b)), ">").alias("visited"))


@query("""SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL""")
def distinct_by_key(spark, d) -> DataFrame:
    return relational.one_per_key(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


_OLD, _NEW = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 3", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 10 <> 7"


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 10 <> 7").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 5, "X").otherwise(F.col("o_orderstatus")))
    return o.where("o_orderkey % 10 <> 3"), new


@query(f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT 'removed' AS side, * FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'added', * FROM (FROM b EXCEPT FROM a)")
def sym_diff(spark, d) -> DataFrame:
    a, b = _versions(spark, d)
    gone = a.exceptAll(b).distinct().select(F.lit("removed").alias("side"), "*")
    return gone.unionByName(b.exceptAll(a).distinct().select(F.lit("added").alias("side"), "*"))


@query(f"""WITH a AS ({_OLD}), b AS ({_NEW}) SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus""")
def version_diff(spark, d) -> DataFrame:
    return relational.version_diff(*_versions(spark, d), ["o_orderkey"])


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS only_left, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS only_right, true AS is_subset")
def set_identities(spark, d) -> DataFrame:
    a, b = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "o_orderkey", "full_outer")
    return both.agg(F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right")).withColumn("is_subset", F.col("only_right") == 0)


_PLACES = "SELECT s_suppkey, 14 + (s_suppkey * 37 % 1000) / 100.0 AS lon, 49 + (s_suppkey * 91 % 600) / 100.0 AS lat FROM supplier"


def _places(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", (14 + (k * 37 % 1000) / F.lit(100.0)).alias("lon"), (49 + (k * 91 % 600) / F.lit(100.0)).alias("lat"))


@query(f"""SELECT s_suppkey, round(2 * 6372797.560856 * asin(least(1.0, sqrt(pow(sin(radians(52.25 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(52.25)) * pow(sin(radians(21.0 - lon) / 2), 2)))), 3) AS metres
  FROM (SELECT s_suppkey, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat FROM ({_PLACES}))""")
def haversine(spark, d) -> DataFrame:
    return _places(spark, d).select("s_suppkey", F.round(geo.haversine(F.col("lon"), F.col("lat"), F.lit(21.0), F.lit(52.25)), 3).alias("metres"))


def _projected_sql() -> str:
    radius, c = geo.series()
    e = (geo.FLAT * (2 - geo.FLAT)) ** 0.5
    x = " + ".join(["eta"] + [f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(c, 1)])
    y = " + ".join(["xi"] + [f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(c, 1)])
    return f"""WITH p AS (SELECT s_suppkey, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat FROM ({_PLACES})),
      a AS (SELECT s_suppkey, radians(lon - 19.0) AS dl, sin(radians(lat)) AS s FROM p), b AS (SELECT s_suppkey, dl, sinh(atanh(s) - {e!r} * atanh({e!r} * s)) AS t FROM a),
      g AS (SELECT s_suppkey, atan2(t, cos(dl)) AS xi, asinh(sin(dl) / sqrt(t * t + pow(cos(dl), 2))) AS eta FROM b)
      SELECT s_suppkey, round(500000.0 + {geo.K0 * radius!r} * ({x}), 3) AS x, round(-5300000.0 + {geo.K0 * radius!r} * ({y}), 3) AS y FROM g"""


@query(_projected_sql())
def tm_project(spark, d) -> DataFrame:
    x, y = geo.project(F.col("lon"), F.col("lat"))
    return _places(spark, d).select("s_suppkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


#: region, ring, is_hole, vertices.
POLYGONS = (
    ("a", 0, False, ((10.0, 10.0), (60.0, 10.0), (60.0, 60.0), (10.0, 60.0))),
    ("a", 1, True, ((25.0, 25.0), (45.0, 25.0), (45.0, 45.0), (25.0, 45.0))),
    ("b", 0, False, ((50.0, 40.0), (90.0, 50.0), (70.0, 95.0))),
    ("c", 0, False, ((0.0, 70.0), (30.0, 65.0), (35.0, 99.0), (5.0, 95.0))),
)
RING_ROWS = [(r, k, h, i, *v[i], *v[(i + 1) % len(v)]) for r, k, h, v in POLYGONS for i in range(len(v))]
RINGS = "rings(region, ring, is_hole, seq, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"('{r}', {k}, {str(h).lower()}, {i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for r, k, h, i, a, b, c, e in RING_ROWS) + ")"
_XY = "SELECT s_suppkey AS line, CAST(s_suppkey * 37 % 101 AS DOUBLE) + 0.37 AS ax, CAST(s_suppkey * 53 % 103 AS DOUBLE) + 0.11 AS ay, CAST(s_suppkey * 71 % 107 AS DOUBLE) + 0.53 AS bx, CAST(s_suppkey * 29 % 109 AS DOUBLE) + 0.29 AS b_y FROM supplier"


def rings(spark) -> DataFrame:
    return spark.createDataFrame(RING_ROWS, "region string, ring int, is_hole boolean, seq int, x1 double, y1 double, x2 double, y2 double")


def roads(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    at = lambda m, n, o: (k * m % n).cast("double") + o
    return table(spark, d, "supplier").select(k.alias("line"), at(37, 101, 0.37).alias("ax"), at(53, 103, 0.11).alias("ay"), at(71, 107, 0.53).alias("bx"), at(29, 109, 0.29).alias("by"))


_CROSS = f"""lines AS ({_XY}), {RINGS}, m AS (SELECT *, nullif((bx - ax) * (y2 - y1) - (b_y - ay) * (x2 - x1), 0.0) AS den FROM lines, rings),
  tu AS (SELECT *, ((x1 - ax) * (y2 - y1) - (y1 - ay) * (x2 - x1)) / den AS t, ((x1 - ax) * (b_y - ay) - (y1 - ay) * (bx - ax)) / den AS u FROM m),
  cuts AS (SELECT DISTINCT line, region, is_hole, CAST(round(CAST(t AS DECIMAL(30,18)), 12) AS DECIMAL(13,12)) AS fraction FROM tu WHERE t >= 0 AND t <= 1 AND u >= 0 AND u < 1)"""


@query(f"WITH {_CROSS} SELECT line, region, is_hole, round(CAST(fraction AS DOUBLE), 9) AS fraction FROM cuts")
def segment_cross(spark, d) -> DataFrame:
    return geometry.crossings(roads(spark, d), rings(spark)).withColumn("fraction", F.round(F.col("fraction").cast("double"), 9))


@query(f"""WITH lines AS ({_XY}), {RINGS} SELECT line, region, sum(CASE WHEN (y1 > ay) <> (y2 > ay) AND ax < x1 + (ay - y1) * (x2 - x1) / nullif(y2 - y1, 0.0) THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM lines, rings GROUP BY ALL""")
def point_in_polygon(spark, d) -> DataFrame:
    points = roads(spark, d).select("line", F.col("ax").alias("x"), F.col("ay").alias("y"))
    return geometry.containment(points, rings(spark), ["line"])


_PIECES = f"""{_CROSS}, every AS (SELECT line, region, fraction FROM cuts UNION SELECT line, region, f::DECIMAL(13,12) FROM lines, (SELECT DISTINCT region FROM rings), (VALUES (0), (1)) AS v(f)),
  pieces AS (SELECT * FROM (SELECT line, region, fraction AS f0, lead(fraction) OVER w AS f1, row_number() OVER w - 1 AS ordinal FROM every WINDOW w AS (PARTITION BY line, region ORDER BY fraction)) WHERE f1 IS NOT NULL),
  mids AS (SELECT p.*, ax + CAST((f0 + f1) / 2 AS DOUBLE) * (bx - ax) AS x, ay + CAST((f0 + f1) / 2 AS DOUBLE) * (b_y - ay) AS y FROM pieces p JOIN lines USING (line)),
  placed AS (SELECT line, mids.region, ordinal, f0, f1, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0.0) THEN 1 ELSE 0 END) % 2 = 1 AS inside
    FROM mids JOIN rings ON mids.region = rings.region GROUP BY ALL)"""


@query(f"""WITH {_PIECES}, r AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER (PARTITION BY line, region ORDER BY ordinal), false) THEN 1 ELSE 0 END AS new FROM placed),
  g AS (SELECT line, region, arg_min(inside, ordinal) AS a, arg_max(inside, ordinal) AS b, bool_or(inside) AS s, bool_and(inside) AS al, CAST(sum(new) AS BIGINT) AS runs FROM r GROUP BY ALL)
  SELECT line, region, CASE WHEN al THEN 'fully_inside' WHEN NOT s THEN 'fully_outside' WHEN runs > 1 THEN 'multiple_crossings' WHEN a THEN 'exiting' WHEN b THEN 'entering' ELSE 'crossing' END AS class, runs AS inside_runs FROM g""")
def interval_classify(spark, d) -> DataFrame:
    return geometry.classified(geometry.intervals(roads(spark, d), rings(spark)))


@query(None)
def erosion_intervals(spark, d) -> DataFrame:
    return geometry.eroded(roads(spark, d), rings(spark), 5.0)


@query(f"""WITH lines AS ({_XY}), t AS (SELECT *, greatest(0.0, least(1.0, ((50.5 - ax) * (bx - ax) + (50.5 - ay) * (b_y - ay)) / nullif((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay), 0.0))) AS t FROM lines),
  m AS (SELECT line, CAST(round_even(sqrt(pow(50.5 - ax - t * (bx - ax), 2) + pow(50.5 - ay - t * (b_y - ay), 2)) * 1000, 0) AS BIGINT) AS mm, round(t, 9) AS fraction FROM t)
  SELECT mm, line, fraction FROM m ORDER BY mm, line LIMIT 1""")
def nearest_segment(spark, d) -> DataFrame:
    return geometry.nearest(roads(spark, d), 50.5, 50.5, ["line"])


@query(f"""WITH {HITS}, b AS (SELECT event_type, min(value) / 100 + 14 AS lo, max(value) / 400 + 14 AS hi, min(user_id) / 100.0 + 49 AS la, max(user_id) / 100.0 + 49 AS ha FROM hits GROUP BY 1)
  SELECT a.event_type AS source, c.event_type AS target, round(sqrt(pow(greatest(0.0, c.lo - a.hi, a.lo - c.hi) * 60000, 2) + pow(greatest(0.0, c.la - a.ha, a.la - c.ha) * 110000, 2)), 3) AS gap_m FROM b a, b c""")
def bbox_bound(spark, d) -> DataFrame:
    b = hits(spark, d).groupBy("event_type").agg((F.min("value") / 100 + 14).alias("lo"), (F.max("value") / 400 + 14).alias("hi"), (F.min("user_id") / 100.0 + 49).alias("la"), (F.max("user_id") / 100.0 + 49).alias("ha"))
    c = b.select([F.col(x).alias(f"{x}_2") for x in b.columns])
    box = lambda s: tuple(F.col(f"{x}{s}") for x in ("lo", "la", "hi", "ha"))
    return b.join(F.broadcast(c)).select(F.col("event_type").alias("source"), F.col("event_type_2").alias("target"), F.round(geo.box_gap_m(box(""), box("_2")), 3).alias("gap_m"))


def _reach_sql(a: str, b: str, n: int) -> str:
    return f"""WITH RECURSIVE {PAIRS}, walk(node, hops) AS (SELECT 7::BIGINT, 0 UNION SELECT {b}, hops + 1 FROM walk JOIN pairs ON node = {a} WHERE hops < {n}) SELECT node, min(hops) AS hops FROM walk GROUP BY node"""


def _seed(spark) -> DataFrame:
    return spark.createDataFrame([(7,)], "node bigint")


@query(_reach_sql("from_node", "to_node", 2))
def reach_k(spark, d) -> DataFrame:
    return graph.reachable(pairs(spark, d), _seed(spark), 2)


@query(_reach_sql("to_node", "from_node", 2))
def reach_reverse_k(spark, d) -> DataFrame:
    return graph.reachable(pairs(spark, d).select(F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node")), _seed(spark), 2)


def _chain_sql(n: int) -> str:
    rounds = "".join(f", l{h} AS (SELECT node, min(cost) AS cost FROM (SELECT node, cost FROM l{h - 1} UNION ALL SELECT to_node, l.cost + p.cost FROM l{h - 1} l JOIN pairs p ON node = from_node) GROUP BY node)" for h in range(1, n + 1))
    return f"WITH {PAIRS}, l0 AS (SELECT 7::BIGINT AS node, 0::BIGINT AS cost){rounds} SELECT node, CAST(cost AS BIGINT) AS cost FROM l{n}"


@query(_chain_sql(4))
def shortest_k_hop(spark, d) -> DataFrame:
    return graph.shortest(pairs(spark, d), _seed(spark), 4)


def _order_sql(order: list[int], n: int) -> str:
    index = " ".join(f"WHEN {b} THEN {i}" for i, b in enumerate(order))
    step = "SELECT to_node AS node, progress + CASE WHEN i = progress THEN 1 ELSE 0 END AS progress, l.cost + p.cost AS cost FROM l{} l JOIN p ON node = from_node WHERE i <= progress"
    rounds = "".join(f", l{h} AS (SELECT node, progress, min(cost) AS cost FROM (SELECT * FROM l{h - 1} UNION ALL {step.format(h - 1)}) GROUP BY node, progress)" for h in range(1, n + 1))
    return f"""WITH {PAIRS}, {MARKS}, p AS (SELECT from_node, to_node, cost, coalesce(CASE bit {index} END, -1) AS i FROM pairs LEFT JOIN marks ON to_node = node),
      l0 AS (SELECT 7::BIGINT AS node, 0 AS progress, 0::BIGINT AS cost){rounds} SELECT node, progress, CAST(cost AS BIGINT) AS cost FROM l{n} WHERE progress = {len(order)}"""


ORDER = [3, 11, 5]


@query(_order_sql(ORDER, 5))
def fixed_order_route(spark, d) -> DataFrame:
    return graph.fixed_order(pairs(spark, d), marks(spark, d), _seed(spark), ORDER, 5).where(F.col("progress") == len(ORDER))


@query("SELECT source, count(*) AS n, CAST(18 AS INTEGER) AS n_cities FROM (SELECT unnest(list_concat(list_resize(['fixed'], 3, 'fixed'), list_resize(['candidate'], 58, 'candidate'), list_resize(['terminal'], 136, 'terminal'))) AS source) GROUP BY source")
def order_schedule(spark, d) -> DataFrame:
    """How many routes of each source the schedule has: 3 + 58 + 17 * 8 = 197."""
    cities = [f"c{i:02d}" for i in range(18)]
    fixed = [cities, cities[:1] + cities[:0:-1], cities[9:] + cities[:9]]
    s = graph.schedule(spark, cities, fixed, 20260726)
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("order")).alias("n_cities"))


@query("""SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1""")
def json_extract(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.from_json("props", "k int")["k"].alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS INTEGER) AS n_numbers, coalesce(regexp_extract_all(text, '[0-9]+')[1], '') AS first_number FROM documents""")
def log_counters(spark, d) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.size(found).alias("n_numbers"), F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("first_number"))


from . import roads as _roads  # noqa: E402, F401  registers its queries


def queries() -> dict:
    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql}
