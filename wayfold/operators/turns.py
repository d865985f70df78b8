"""Turn tables: resolving, legality, implicit continuations, adjacency, replays of paths.

edges: edge_id, from_node, to_node, cost, length, mask. turns: in_edge, out_edge, turn_cost, category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bits
from .relational import first_hits

EXPLICIT, IMPLICIT = "inherited_stage2a_turn", "implicit_edge_based_geometry_continuation"


def resolved(raw: DataFrame, segments: DataFrame) -> DataFrame:
    """Turns between groups of segments (in_ebn, out_ebn, turn_cost, status) as turns between the last segment of one and the first of the other.

    segments: ebn, ordinal, edge_id. Turns of unknown groups keep a null edge: unresolved() counts them."""
    ends = segments.groupBy("ebn").agg(F.min_by("edge_id", "ordinal").alias("first"), F.max_by("edge_id", "ordinal").alias("last"))
    coming = ends.select(F.col("ebn").alias("in_ebn"), F.col("last").alias("in_edge"))
    going = ends.select(F.col("ebn").alias("out_ebn"), F.col("first").alias("out_edge"))
    return raw.join(coming, "in_ebn", "left").join(going, "out_ebn", "left").select("in_edge", "out_edge", "turn_cost", "status")


def legality(turns: DataFrame) -> DataFrame:
    """One row: turns, those that are not allowed, and those without an edge on either side."""
    return turns.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("status").eqNullSafe("allowed")).alias("violations"), F.count_if(F.col("in_edge").isNull() | F.col("out_edge").isNull()).alias("unresolved"))


def allowed(turns: DataFrame, guard: bool = False) -> DataFrame:
    """The allowed turns; with `guard` another status fails the query instead."""
    ok = F.col("status").eqNullSafe("allowed")
    if guard:
        ok = F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("turn is not allowed: "), F.coalesce("status", F.lit("null")))))
    return turns.where(ok).select("in_edge", "out_edge", "turn_cost")


def continuations(edges: DataFrame, turns: DataFrame) -> DataFrame:
    """in_edge, out_edge, turn_cost 0 where nothing but one geometry goes on.

    edges: edge_id, parent, ordinal, from_node, to_node. The last child of a parent without a turn continues to the only
    first child without a turn into it that starts at its end and does not turn back."""
    after = edges.select(F.col("parent").alias("parent"), (F.col("ordinal") - 1).alias("ordinal"))
    lasts = edges.join(after, ["parent", "ordinal"], "left_anti").join(turns.select(F.col("in_edge").alias("edge_id")), "edge_id", "left_anti")
    firsts = edges.where("ordinal = 0").join(turns.select(F.col("out_edge").alias("edge_id")), "edge_id", "left_anti")
    going = firsts.select(F.col("edge_id").alias("out_edge"), F.col("from_node").alias("via"), F.col("to_node").alias("next"))
    met = lasts.select(F.col("edge_id").alias("in_edge"), F.col("from_node").alias("back"), F.col("to_node").alias("via")).join(going, "via").where("next <> back")
    one = met.groupBy("in_edge").agg(F.min("out_edge").alias("out_edge"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return one.select("in_edge", "out_edge", F.lit(0).cast("bigint").alias("turn_cost"))


def every_turn(turns: DataFrame, implicit: DataFrame) -> DataFrame:
    """Explicit and implicit turns in one table, the cheapest of parallel ones."""
    both = turns.select("in_edge", "out_edge", "turn_cost", F.lit(EXPLICIT).alias("category")).unionByName(implicit.select("in_edge", "out_edge", "turn_cost", F.lit(IMPLICIT).alias("category")))
    return both.groupBy("in_edge", "out_edge").agg(F.min("turn_cost").alias("turn_cost"), F.min("category").alias("category"))


def outgoing(all_turns: DataFrame, keys: DataFrame) -> DataFrame:
    """The turns out of a table of edges (edge_id)."""
    return all_turns.join(keys.select(F.col("edge_id").alias("in_edge")).distinct(), "in_edge", "left_semi")


def incoming(all_turns: DataFrame, keys: DataFrame) -> DataFrame:
    return all_turns.join(keys.select(F.col("edge_id").alias("out_edge")).distinct(), "out_edge", "left_semi")


def induced(edges: DataFrame, all_turns: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of a set and the turns that stay inside it."""
    return edges.join(keys.select("edge_id").distinct(), "edge_id", "left_semi"), incoming(outgoing(all_turns, keys), keys)


def u_turn(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """`u_turn` if the second edge goes back over the first one's ends, else `ordinary_turn`."""
    return F.when((a_from == b_to) & (a_to == b_from), "u_turn").otherwise("ordinary_turn")


def version_counts(edges: DataFrame, gone: Column, late: Column) -> DataFrame:
    """change, kind, n: contracts.turn_versions() counted, where the old version has all turns but those into `late` edges and the new one all but those out of `gone` edges.

    edges: from_node, to_node and what the two conditions read. At a node, turns are pairs of an edge in and an edge out, so counts of either
    multiply; turns back are those pairs that share the other node, too. No pair is made."""
    way_in = F.struct(F.col("to_node").alias("via"), F.col("from_node").alias("other"), F.when(gone, 0).when(~gone, 1).alias("side"))
    way_out = F.struct(F.col("from_node").alias("via"), F.col("to_node").alias("other"), F.when(~late, 2).when(late, 3).alias("side"))
    ends = edges.select(F.explode(F.array(way_in, way_out)).alias("x")).select("x.*").where("via IS NOT NULL AND side IS NOT NULL").repartition("via")
    sides = [f"n{i}" for i in range(4)]
    by_other = ends.groupBy("via", "other").agg(*[F.count_if(F.col("side") == i).alias(n) for i, n in enumerate(sides)])
    u = lambda a, b: F.when(F.col("other").isNotNull(), F.col(a) * F.col(b)).otherwise(0)
    at = by_other.groupBy("via").agg(F.sum(u("n0", "n2")).alias("u_removed"), F.sum(u("n1", "n3")).alias("u_added"), *[F.sum(n).alias(n) for n in sides])
    one = at.agg(F.sum("u_removed").alias("ur"), F.sum("u_added").alias("ua"), F.sum(F.col("n0") * F.col("n2")).alias("r"), F.sum(F.col("n1") * F.col("n3")).alias("a"))
    row = lambda change, kind, n: F.struct(F.lit(change).alias("change"), F.lit(kind).alias("kind"), n.alias("n"))
    rows = F.array(row("removed", "u_turn", F.col("ur")), row("removed", "ordinary_turn", F.col("r") - F.col("ur")), row("added", "u_turn", F.col("ua")), row("added", "ordinary_turn", F.col("a") - F.col("ua")))
    return one.select(F.explode(rows).alias("x")).select("x.*").where("n > 0")


def replayed(path: DataFrame, edges: DataFrame, all_turns: DataFrame, bit_count: int, free_start: bool = False) -> DataFrame:
    """For each route (route, pos, edge_id) one row: steps, cost, length, first-hit order, mask, illegal, broken, missing, certified.

    A step costs the cheapest legal turn from the edge before and the edge itself; an edge on which a route was snapped to
    its start is free. illegal counts steps without a turn, broken those whose ends do not meet, missing unknown edges."""
    w = W.partitionBy("route").orderBy("pos")
    steps = path.withColumn("in_edge", F.lag("edge_id").over(w)).withColumnRenamed("edge_id", "out_edge")
    cheapest = all_turns.groupBy("in_edge", "out_edge").agg(F.min("turn_cost").alias("turn_cost"))
    own = edges.select(F.col("edge_id").alias("out_edge"), F.col("from_node").alias("f"), F.col("to_node").alias("t"), "cost", "length", "mask")
    walked = steps.join(cheapest, ["in_edge", "out_edge"], "left").join(own, "out_edge", "left")
    walked = walked.withColumns({"before": F.lag("t").over(w), "first": F.col("in_edge").isNull()})
    return _summed(walked, walked.where("mask <> 0"), bit_count, free_start)


def replayed_by_rule(walk: DataFrame, visits: DataFrame, turn_cost: Column, bit_count: int) -> DataFrame:
    """replayed() without its mask where the turn table is a rule over two edges that meet: no table of turns is made.

    walk: route, pos, from_node, to_node, cost, length of each step. turn_cost: over `before_cost` and `cost`, null where
    there is no turn. visits: route, pos, mask of the steps inside a place."""
    w = W.partitionBy("route").orderBy("pos")
    lag = lambda c: F.lag(c).over(w)
    steps = walk.select("route", "pos", F.col("from_node").alias("f"), F.col("to_node").alias("t"), "cost", "length", lag("cost").alias("before_cost"), lag("to_node").alias("before"), lag(F.lit(1)).isNull().alias("first"))
    return _summed(steps.withColumn("turn_cost", F.when(F.col("before") == F.col("f"), turn_cost)), visits, bit_count, False)


def _summed(walked: DataFrame, visits: DataFrame, bit_count: int, free_start: bool) -> DataFrame:
    """walked: route, pos, first, before (the node where the step before ends), f, t, cost, length, turn_cost, and mask where it is asked for."""
    first = F.col("first")
    paid = F.lit(not free_start) | ~first
    total = lambda c: F.coalesce(F.sum(F.when(paid, F.col(c))), F.lit(0))
    masks = [F.coalesce(F.bit_or("mask"), F.lit(0)).alias("mask")] if "mask" in walked.columns else []
    sums = walked.groupBy("route").agg(
        F.count(F.lit(1)).alias("steps"), (total("cost") + F.coalesce(F.sum("turn_cost"), F.lit(0))).alias("cost"), total("length").alias("length"), *masks,
        F.count_if(~first & F.col("turn_cost").isNull()).alias("illegal"), F.count_if(~first & ~F.coalesce(F.col("before") == F.col("f"), F.lit(False))).alias("broken"), F.count_if(F.col("f").isNull()).alias("missing"),
        F.count_if((F.col("cost") < 0) | (F.col("length") < 0) | (F.col("turn_cost") < 0)).alias("negative"),
    )
    order = first_hits(visits, "route", "pos", "mask", bit_count)
    ok = (F.col("illegal") == 0) & (F.col("broken") == 0) & (F.col("missing") == 0) & (F.col("negative") == 0)
    return sums.join(order, "route", "left").withColumn("order", F.coalesce("order", F.array().cast("array<int>"))).withColumn("certified", ok)


def states(path: DataFrame, edges: DataFrame) -> DataFrame:
    """route, pos, edge_id, mask, seen: the steps that visit a place, with all that was visited up to there."""
    w = W.partitionBy("route").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    on = path.join(edges.select("edge_id", "mask"), "edge_id")
    return on.withColumn("seen", F.bit_or("mask").over(w)).where("mask <> 0")


def names_of(order: Column, names: list[str]) -> Column:
    return F.transform(order, lambda b: F.get(F.array(*map(F.lit, names)), b))


def mask_of(bit: Column) -> Column:
    return F.coalesce(F.when(bit.isNotNull(), bits.bit(bit)), F.lit(0))
