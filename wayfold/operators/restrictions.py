"""Proof that prohibited turns are absent: relations to paths, paths to transitions, transitions to what was observed.

edges: edge_id, way_id, from_node, to_node. turns: in_edge, out_edge. restrictions: from ways.restrictions()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import via_path

NO_IN, NO_OUT, OTHER_WAY = "restriction_from_way_has_no_legal_incoming_edge", "restriction_to_way_has_no_legal_outgoing_edge", "incoming_way_id_differs_from_restriction_from_way"


def direct(restrictions: DataFrame) -> DataFrame:
    """Unconditional relations over exactly one via node that name ways on both sides and are not excepted."""
    s = F.col("shape")
    fits = s["rule"].isNotNull() & ~F.col("ignored") & s["fits"] & (F.size(s["via_nodes"]) == 1) & (F.size(s["via_ways"]) == 0) & (F.size(s["from_ways"]) > 0) & (F.size(s["to_ways"]) > 0)
    return restrictions.where(fits).select("relation_id", s["rule"].alias("rule"), s["from_ways"].alias("from_ways"), s["to_ways"].alias("to_ways"), F.get(s["via_nodes"], F.lit(0)).alias("via"))


def paths(direct_rows: DataFrame, ways: DataFrame) -> DataFrame:
    """path, relation_id, rule, from_way, to_way, from_node, via_node, to_node: every pair of a relation's ways that meet at its via node."""
    nodes = lambda name: ways.select(F.col("way_id").alias(f"{name}_way"), F.col("nodes").alias(f"{name}_nodes"))
    pairs = direct_rows.select("relation_id", "rule", "via", F.explode("from_ways").alias("from_way"), "to_ways").select("relation_id", "rule", "via", "from_way", F.explode("to_ways").alias("to_way"))
    met = pairs.join(nodes("from"), "from_way").join(nodes("to"), "to_way").withColumn("p", via_path(F.col("from_nodes"), F.col("to_nodes"), F.col("via")))
    return met.where("p IS NOT NULL").select(F.xxhash64("relation_id", "from_way", "to_way").alias("path"), "relation_id", "rule", "from_way", "to_way", "p.*")


def transitions(path_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """path, relation_id, from_way, in_edge, in_way, out_edge, candidate, reason: what each path prohibits at its node.

    `no` prohibits the designated way out, `only` all others. A transition is a candidate if it comes in over the
    restriction's own way and the path has legal edges on both sides; else `reason` says why it is none."""
    into = edges.select(F.col("edge_id").alias("in_edge"), F.col("way_id").alias("in_way"), F.col("from_node").alias("from_node"), F.col("to_node").alias("via_node"))
    out = edges.select(F.col("edge_id").alias("out_edge"), F.col("way_id").alias("out_way"), F.col("from_node").alias("via_node"), F.col("to_node").alias("next_node"))
    coming = path_rows.join(into, ["from_node", "via_node"])
    going = path_rows.select("path", "rule", "to_way", "to_node", "via_node").join(out, "via_node")
    designated = (F.col("next_node") == F.col("to_node")) & (F.col("out_way") == F.col("to_way"))
    has_in = coming.groupBy("path").agg(F.bool_or(F.col("in_way") == F.col("from_way")).alias("has_in"))
    has_out = going.groupBy("path").agg(F.bool_or(designated).alias("has_out"))
    prohibited = going.where(((F.col("rule") == "no") & designated) | ((F.col("rule") == "only") & (F.col("next_node") != F.col("to_node")))).select("path", "out_edge")
    both = coming.select("path", "relation_id", "from_way", "in_edge", "in_way").join(prohibited, "path").join(has_in, "path").join(has_out, "path", "left")
    own = F.col("in_way") == F.col("from_way")
    reason = F.when(~F.col("has_in"), NO_IN).when(~F.coalesce("has_out", F.lit(False)), NO_OUT).when(~own, OTHER_WAY)
    return both.select("path", "relation_id", "from_way", "in_edge", "in_way", "out_edge", reason.isNull().alias("candidate"), reason.alias("reason"))


def partition(transition_rows: DataFrame, turns: DataFrame) -> DataFrame:
    """in_edge, out_edge, relations (sorted ids), status: prohibited (no such turn), observed, or legacy (a turn that only the way-blind projection would prohibit)."""
    pair = ["in_edge", "out_edge"]
    of = transition_rows.groupBy(*pair).agg(F.bool_or("candidate").alias("c"), F.array_sort(F.collect_set(F.when(F.col("candidate"), F.col("relation_id")))).alias("relations"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    seen = of.join(turns.select(*pair).distinct().withColumn("seen", F.lit(True)), pair, "left")
    status = F.when(F.col("c") & F.col("seen").isNull(), "prohibited").when(F.col("c"), "observed").when(F.col("seen"), "legacy")
    return seen.select(*pair, "relations", "reasons", status.alias("status")).where("status IS NOT NULL")


def at_nodes(path_rows: DataFrame, edges: DataFrame, has_turn: Column) -> DataFrame:
    """The rows of partition() where the turn table is a rule over two edges that meet, so that neither turns nor pairs are shuffled.

    edges: unique edge_id; further columns stand in has_turn as in_<name> and out_<name>. Paths are gathered for each edge
    that they come in over; then each pair is made once, beside its node's edges, and judged there."""
    more = [c for c in edges.columns if c not in ("edge_id", "way_id", "from_node", "to_node")]
    side = lambda name: [F.col(c).alias(f"{name}_{c}") for c in more]
    into = edges.select(F.col("edge_id").alias("in_edge"), F.col("way_id").alias("in_way"), "from_node", F.col("to_node").alias("via_node"), *side("in"))
    out = edges.select(F.col("edge_id").alias("out_edge"), F.col("way_id").alias("out_way"), F.col("from_node").alias("via_node"), F.col("to_node").alias("next_node"), *side("out"))
    ends = out.select("via_node", F.col("next_node").alias("to_node"), F.col("out_way").alias("to_way")).distinct().withColumn("has_out", F.lit(True))
    coming = path_rows.join(ends, ["via_node", "to_node", "to_way"], "left").join(into, ["from_node", "via_node"])
    own = F.col("in_way") == F.col("from_way")
    has_in = F.bool_or(own).over(W.partitionBy("from_node", "via_node", "path"))
    reason = F.when(~has_in, NO_IN).when(F.col("has_out").isNull(), NO_OUT).when(~own, OTHER_WAY)
    path = F.struct("relation_id", "rule", "to_way", "to_node", (own & F.col("has_out").isNotNull()).alias("candidate"), reason.alias("reason"))
    gathered = coming.withColumn("p", path).groupBy("from_node", "via_node", "in_edge", *[f"in_{c}" for c in more]).agg(F.collect_list("p").alias("p"))
    met = gathered.join(out, "via_node")
    other = lambda p: F.col("next_node") != p["to_node"]
    hit = F.filter("p", lambda p: ((p["rule"] == "no") & ~other(p) & (F.col("out_way") == p["to_way"])) | ((p["rule"] == "only") & other(p)))
    met = met.select("in_edge", "out_edge", hit.alias("hit"), F.coalesce(has_turn, F.lit(False)).alias("seen")).where("size(hit) > 0")
    c = F.exists("hit", lambda p: p["candidate"])
    status = F.when(c & ~F.col("seen"), "prohibited").when(c, "observed").when(F.col("seen"), "legacy")
    relations = F.array_sort(F.array_distinct(F.transform(F.filter("hit", lambda p: p["candidate"]), lambda p: p["relation_id"])))
    reasons = F.array_sort(F.array_distinct(F.filter(F.transform("hit", lambda p: p["reason"]), lambda r: r.isNotNull())))
    return met.select("in_edge", "out_edge", relations.alias("relations"), reasons.alias("reasons"), status.alias("status")).where("status IS NOT NULL")


def certificate(partition_rows: DataFrame) -> DataFrame:
    """One row: candidates, prohibited, observed, legacy, whether the parts add up, and a digest of the prohibited pairs."""
    n = lambda s: F.count_if(F.col("status") == s)
    line = F.when(F.col("status") == "prohibited", F.xxhash64("in_edge", "out_edge").cast("decimal(38,0)"))
    out = partition_rows.agg(F.count_if(F.col("status") != "legacy").alias("candidates"), n("prohibited").alias("prohibited"), n("observed").alias("observed"), n("legacy").alias("legacy"), F.sum(line).alias("digest"))
    return out.withColumn("is_partition", F.col("candidates") == F.col("prohibited") + F.col("observed"))


def sample(partition_rows: DataFrame, status: str, n: int = 32) -> DataFrame:
    """The first n pairs of a status in canonical order."""
    return partition_rows.where(F.col("status") == status).orderBy("in_edge", "out_edge").limit(n)
