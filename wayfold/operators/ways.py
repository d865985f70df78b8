"""Ways to directed legal segments, relations to restrictions, and what the start of a route may do.

ways: way_id, tags (map), nodes (array). relations: relation_id, tags, members (array of type, ref, role)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import ids, tags
from ..functions.profile import Profile
from ..sources.tables import restriction_shape
from .stored import kept

#: Sets of tags that are broadcast; more are joined.
FEW = 100_000
NAMESPACES = ("motorcar", "motor_vehicle", "vehicle")


def both_directions(ways: DataFrame, profile: Profile) -> DataFrame:
    """A row for each way and direction, with `x`, the profile's verdict; n segments each."""
    way = lambda name, bit: F.struct(F.lit(bit).alias("direction"), profile.way(F.col("tags"), name).alias("x"))
    n = F.greatest(F.size("nodes") - 1, F.lit(0)).alias("n")
    return ways.select("way_id", "tags", "nodes", n, F.explode(F.array(way("forward", 0), way("backward", 1))).alias("d")).select("way_id", "tags", "nodes", "n", "d.*")


def verdicts(tag_sets: DataFrame, profile: Profile) -> DataFrame:
    """_key, tags, d (direction and verdict): what the profile says of each distinct set of tags. Sets are counted, and broadcast if they are few."""
    way = lambda name, bit: F.struct(F.lit(bit).alias("direction"), profile.way(F.col("tags"), name).alias("x"))
    found = kept(tag_sets.groupBy(_key().alias("_key")).agg(F.first("tags").alias("tags")))
    found = kept(found.select("_key", profile.considered(F.col("tags")).alias("_considered"), F.array(way("forward", 0), way("backward", 1)).alias("_d")))
    return F.broadcast(found) if found.limit(FEW + 1).count() <= FEW else found


def _key() -> Column:
    return F.array_sort(F.map_entries("tags"))


def rejections(ways: DataFrame, profile: Profile) -> DataFrame:
    """One row of counters: ways, ferry segments (both ways), rejected segments of enabled directions, legal segments.

    Ways of equal tags are counted together and judged once. `n`, a way's segments, may stand in place of its nodes."""
    size = F.col("n") if "n" in ways.columns else F.greatest(F.size("nodes") - 1, F.lit(0))
    same = ways.groupBy(_key().alias("_key")).agg(F.first("tags").alias("tags"), F.count(F.lit(1)).alias("ways"), F.sum(size.cast("long")).alias("n"))
    way = lambda name, bit: F.struct(F.lit(bit).alias("direction"), profile.way(F.col("tags"), name).alias("x"))
    each, t = same.select("tags", "ways", "n", F.explode(F.array(way("forward", 0), way("backward", 1))).alias("d")).select("tags", "ways", "n", "d.*"), F.col("tags")
    considered = profile.considered(t)
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.agg(
        F.coalesce(F.sum(F.when(F.col("direction") == 0, F.col("ways"))), F.lit(0)).alias("ways_read"), count(profile.ferry(t)).alias("ferry"),
        count(considered & F.col("x.enabled") & ~F.col("x.legal")).alias("rejected"), count(considered & F.col("x.legal")).alias("legal"),
    )


def legal_segments(ways: DataFrame, profile: Profile, needed: DataFrame | None = None, observed: Observation | None = None, tag_sets: DataFrame | None = None) -> DataFrame:
    """Directed legal segments; of those in `needed` (from_node, to_node), if given. observed: counts them as they pass.

    tag_sets: a table that has all tags of the ways; each distinct set is judged once then, not each way."""
    if tag_sets is None:
        each = both_directions(ways, profile).where(profile.considered(F.col("tags")) & F.col("x.legal"))
    else:
        n = F.greatest(F.size("nodes") - 1, F.lit(0)).alias("n")
        judged = ways.select("way_id", "tags", "nodes", n, _key().alias("_key")).join(verdicts(tag_sets, profile).where("_considered"), "_key")
        each = judged.select("way_id", "tags", "nodes", "n", F.explode("_d").alias("d")).select("way_id", "tags", "nodes", "n", "d.*").where("x.legal")
    at = lambda i: F.get("nodes", i)
    back = F.col("direction") == 1
    out = each.where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ordinal"))
    out = out.select(
        "way_id", "ordinal", "direction", F.when(back, at(F.col("ordinal") + 1)).otherwise(at(F.col("ordinal"))).alias("from_node"),
        F.when(back, at(F.col("ordinal"))).otherwise(at(F.col("ordinal") + 1)).alias("to_node"), F.col("tags")["highway"].alias("highway"), F.col("x.speed_kmh").alias("speed_kmh"), F.col("x.access").alias("access"),
    )
    out = out.join(needed.select("from_node", "to_node").distinct(), ["from_node", "to_node"], "left_semi") if needed is not None else out
    return out.observe(observed, F.count(F.lit(1)).alias("legal_candidates"), F.count_if(F.col("direction") == 1).alias("backward")) if observed else out


def ways_of(ways: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ways whose ids a table lists: a second, much smaller pass."""
    return ways.join(wanted.select("way_id").distinct(), "way_id", "left_semi")


def restrictions(relations: DataFrame) -> DataFrame:
    """relation_id, shape, values, conditional, ignored of the relations that restrict turns."""
    keys = F.filter(F.map_keys("tags"), lambda k: (k == "restriction") | F.startswith(k, F.lit("restriction:")))
    t = F.col("tags")
    plain = F.filter(keys, lambda k: (k != "restriction:conditional") & ~F.endswith(k, F.lit(":conditional")))
    values = F.array_sort(F.array_distinct(F.transform(plain, lambda k: t[k])))
    known = F.filter(values, lambda v: F.startswith(v, F.lit("only_")) | (F.startswith(v, F.lit("no_")) & ~F.endswith(v, F.lit("_on_red"))))
    out = relations.where(F.size(keys) > 0).select(
        "relation_id", known.alias("values"), F.exists(keys, lambda k: F.endswith(k, F.lit(":conditional"))).alias("conditional"),
        tags.excepted(t["except"], NAMESPACES).alias("ignored"), restriction_shape(F.col("members"), F.get(known, F.lit(0))).alias("shape"),
    )
    return out.where("size(values) > 0 OR conditional")


def start_directions(way: DataFrame, ordinal: int, graph_edges: DataFrame, profile: Profile) -> DataFrame:
    """Both directions of one segment of one way with the reasons that forbid them. graph_edges: edge_id."""
    t = F.col("tags")
    a, b = F.get("nodes", F.lit(ordinal)), F.get("nodes", F.lit(ordinal + 1))
    each = [F.struct(F.lit(name).alias("name"), F.lit(bit).alias("direction"), ids.stable_id(F.col("way_id"), F.lit(ordinal), F.lit(bit), x, y).alias("edge_id")) for name, bit, x, y in (("forward", 0, a, b), ("backward", 1, b, a))]
    rows = way.where(F.size("nodes") > ordinal + 1).select("tags", F.explode(F.array(*each)).alias("d")).select("tags", "d.*")
    rows = rows.join(graph_edges.select("edge_id", F.lit(True).alias("_in")), "edge_id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    why = F.when(F.col("direction") == 0, profile.reasons(t, "forward", F.col("_in"))).otherwise(profile.reasons(t, "backward", F.col("_in")))
    return rows.select("edge_id", "name", "direction", why.alias("reasons")).withColumn("legal", F.size("reasons") == 0)


def same_segment(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """All directions of selected segments: edges with the same way, ordinal and unordered ends. Both: way_id, ordinal, from_node, to_node."""
    ends = lambda: (F.least("from_node", "to_node").alias("_lo"), F.greatest("from_node", "to_node").alias("_hi"))
    key = ["way_id", "ordinal", "_lo", "_hi"]
    return edges.select("*", *ends()).join(selected.select("way_id", "ordinal", *ends()).distinct(), key, "left_semi").drop("_lo", "_hi")
