"""Reachability and fixed-order routes over edges and turns, round by round until nothing improves.

Every round joins only the labels that have just improved with the turns, and its labels are a written table, so a
round's plan does not grow with the number of rounds and an executor that is lost costs one round. The folder is that of
`spark.checkpoint.dir`, or a temporary one where the session runs in one process.

A label is (edge, progress): a walk that meets a place out of order, or one that the order lacks, is dropped, so
progress says which places were visited."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .relational import one_per_key
from .stored import kept

#: Metres a second that no road exceeds.
FASTEST = 25.0
CATEGORIES = ("FEASIBLE", "UNREACHABLE", "ORDER_INVALID_BY_FIRST_HIT", "TIMEOUT", "INVALID_INPUT", "CHECKER_MISMATCH", "EXCEPTION")


@dataclass(frozen=True)
class RoadGraph:
    """What a search needs, wherever it is stored. edges: edge_id, cost, length, mask, x, y (its end). turns: in_edge, out_edge, turn_cost."""

    edges: DataFrame
    turns: DataFrame
    #: turns holds no parallel ones, so none have to be reduced
    unique: bool = False

    def steps(self) -> DataFrame:
        """in_edge, out_edge, cost (of the turn and the edge that it enters), length, mask, x, y; clustered by in_edge, parallel turns reduced to the cheapest."""
        cheapest = self.turns.select("in_edge", "out_edge", "turn_cost") if self.unique else self.turns.groupBy("in_edge", "out_edge").agg(F.min("turn_cost").alias("turn_cost"))
        e = self.edges.select(F.col("edge_id").alias("out_edge"), "cost", "length", "mask", *[c for c in ("x", "y") if c in self.edges.columns])
        return cheapest.join(e, "out_edge").withColumn("cost", F.col("turn_cost") + F.col("cost")).drop("turn_cost")

    def first_edge(self, bit: int) -> DataFrame:
        """The least edge inside a place."""
        return self.edges.where(F.col("mask").bitwiseAND(1 << bit) != 0).agg(F.min("edge_id").alias("edge_id"))

    def bounds(self, bit_count: int) -> DataFrame:
        """bit, x1, y1, x2, y2 of the edges inside each place."""
        from ..functions.bits import set_bits

        each = self.edges.select("x", "y", F.explode(set_bits(F.col("mask"), bit_count)).alias("bit"))
        return each.groupBy("bit").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))


def reachable(steps: DataFrame, start: DataFrame, most_rounds: int = 10_000, gates: DataFrame | None = None, all_bits: int = 0) -> DataFrame:
    """edge_id, hops: all edges that turns lead to. steps: in_edge, out_edge; reverse them for the way back.

    With gates (edge_id, mask) it stops as soon as edges of all bits of `all_bits` were met."""
    steps = kept(steps.select("in_edge", "out_edge").distinct())
    frontier = kept(start.select("edge_id").distinct().withColumn("hops", F.lit(0)))
    found = [frontier]
    for h in range(1, most_rounds + 1):
        seen = found[0] if len(found) == 1 else _union(found)
        if gates is not None and all_bits and (seen.join(gates, "edge_id").agg(F.bit_or("mask").alias("m")).first()["m"] or 0) & all_bits == all_bits:
            break
        new = frontier.join(steps, F.col("edge_id") == F.col("in_edge")).select(F.col("out_edge").alias("edge_id")).distinct()
        frontier = kept(new.join(seen, "edge_id", "left_anti").withColumn("hops", F.lit(h)))
        if frontier.isEmpty():
            break
        found.append(frontier)
        if len(found) >= 16:
            found = [kept(_union(found))]
    return _union(found)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def witnesses(found: DataFrame, gates: DataFrame, bit_count: int) -> DataFrame:
    """bit, witness (its least gate that was reached), verdict: one row for each place."""
    from ..functions.bits import set_bits

    met = found.join(gates, "edge_id").select("edge_id", F.explode(set_bits(F.col("mask"), bit_count)).alias("bit")).groupBy("bit").agg(F.min("edge_id").alias("witness"))
    every = found.sparkSession.range(bit_count).select(F.col("id").cast("int").alias("bit"))
    return every.join(met, "bit", "left").withColumn("verdict", F.when(F.col("witness").isNull(), "UNREACHABLE").otherwise("REACHABLE"))


def connected_pairs(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """source, target, from_gate, to_gate, verdict of all ordered pairs of places: there is a way through the start if one reaches it and it reaches the other."""
    a = backward.select(F.col("bit").alias("source"), F.col("witness").alias("from_gate"))
    b = forward.select(F.col("bit").alias("target"), F.col("witness").alias("to_gate"))
    both = a.join(b, F.col("source") != F.col("target"))
    return both.withColumn("verdict", F.when(F.col("from_gate").isNotNull() & F.col("to_gate").isNotNull(), "CONNECTED").otherwise("UNKNOWN"))


def advance(progress: Column, mask: Column, order: list[int]) -> Column:
    """The progress after an edge with a mask; -1 where it meets a place out of order or one that the order lacks.

    New places of one edge are met in ascending order of bits, so they must be the next ones of the order, ascending."""
    def visited(p: int) -> int:
        return sum(1 << b for b in order[:p])

    def after(p: int, new: int) -> int | None:
        run = [b for b in range(new.bit_length()) if new >> b & 1]
        return p + len(run) if order[p : p + len(run)] == run else None

    out = F.lit(-1)
    for p in range(len(order) + 1):
        new = mask.bitwiseAND(F.lit(~visited(p) & ((1 << 62) - 1)))
        steps = F.when(new == 0, p)
        # of all masks only runs of the order's next places, ascending, go on
        run = 0
        for k in range(p, len(order)):
            if k > p and order[k] < order[k - 1]:
                break
            run |= 1 << order[k]
            steps = steps.when(new == run, k + 1)
            assert after(p, run) == k + 1
        out = F.when(progress == p, F.coalesce(steps, F.lit(-1))).otherwise(out)
    return out


def off_order(*orders: list[int]) -> Column:
    """Whether a mask has no place that none of the orders names."""
    known = sum(1 << b for b in {b for o in orders for b in o})
    return F.col("mask").bitwiseAND(F.lit(~known & ((1 << 62) - 1))) == 0


def _bounds_left(bounds: dict[int, tuple[float, float, float, float]], order: list[int]) -> list[float]:
    """Seconds that are left at least once a place of the order is reached."""
    left = [0.0] * (len(order) + 1)
    for i in range(len(order) - 2, -1, -1):
        a, b = bounds[order[i]], bounds[order[i + 1]]
        dx, dy = max(0.0, b[0] - a[2], a[0] - b[2]) * geo.LON_M, max(0.0, b[1] - a[3], a[1] - b[3]) * geo.LAT_M
        left[i] = left[i + 1] + (dx * dx + dy * dy) ** 0.5 / FASTEST
    return left


def lower_bound(progress: Column, x: Column, y: Column, bounds: dict[int, tuple[float, float, float, float]], order: list[int]) -> Column:
    """Seconds from a point to the end of the order, at least: to the next place's box, then from box to box."""
    left, out = _bounds_left(bounds, order), F.lit(0.0)
    for p in range(len(order)):
        x1, y1, x2, y2 = bounds[order[p]]
        gap = F.hypot(F.greatest(F.lit(0.0), F.lit(x1) - x, x - F.lit(x2)) * geo.LON_M, F.greatest(F.lit(0.0), F.lit(y1) - y, y - F.lit(y2)) * geo.LAT_M)
        out = F.when(progress == p, gap / FASTEST + left[p]).otherwise(out)
    return out


class FixedOrder:
    """The cheapest walk from an edge that meets the places of an order first in that order.

    free_start: the walk was snapped to a point of its first edge, whose cost does not count. beam: at most so many
    labels of a round go on, those with the least cost and bound (an upper bound of the cost, no optimum). bounds: boxes
    of places by bit (x1, y1, x2, y2), units: label cost units in a second. most_rounds bounds the walk's edges."""

    def __init__(self, graph: RoadGraph, start: str, order: list[int], free_start: bool = False, bounds: dict | None = None, units: float = 1.0, beam: int | None = None, most_rounds: int = 100_000, steps: DataFrame | None = None):
        self.order, self.goal = order, len(order)
        # an edge in a place that the order lacks neither goes on nor counts as rejected
        steps = (kept(graph.steps()) if steps is None else steps).where(off_order(order))
        first = graph.edges.where(F.col("edge_id") == start)
        # the first place of an order is where it starts, whether or not the edge lies in it
        mask = F.col("mask").bitwiseOR(F.lit(1 << order[0]))
        zero = F.lit(0).cast("bigint")
        labels = first.select("edge_id", advance(F.lit(0), mask, order).alias("progress"), (zero if free_start else F.col("cost").cast("bigint")).alias("cost"), (zero if free_start else F.col("length").cast("bigint")).alias("length"), F.lit(None).cast("string").alias("from_edge"), F.lit(None).cast("int").alias("from_progress"))
        self.started = not first.isEmpty()
        labels = kept(labels.where("progress >= 0"))
        frontier, rejected, self.rounds = labels, None, 0
        while self.rounds < most_rounds and not frontier.isEmpty():
            self.rounds += 1
            best = labels.where(F.col("progress") == self.goal).agg(F.min("cost").alias("c")).first()["c"]
            step = frontier.select(F.col("edge_id").alias("in_edge"), F.col("progress").alias("p"), F.col("cost").alias("c"), F.col("length").alias("l")).where(F.col("progress") < self.goal).join(steps, "in_edge")
            moved = step.select(F.col("out_edge").alias("edge_id"), advance(F.col("p"), F.col("mask"), order).alias("progress"), (F.col("c") + F.col("cost")).alias("cost"), (F.col("l") + F.col("length")).alias("length"), F.col("in_edge").alias("from_edge"), F.col("p").alias("from_progress"), "mask", *[x for x in ("x", "y") if x in steps.columns])
            # one pass over the steps: what went on and what was rejected are read from the round's own table
            moved = kept(moved)
            bad = moved.where("progress < 0").select("cost", "from_edge", "edge_id")
            worst = bad.agg(F.min(F.struct("cost", "from_edge", "edge_id")).alias("x")).first()["x"]
            rejected = min(filter(None, (rejected, worst and tuple(worst))), default=None)
            moved = moved.where("progress >= 0")
            if bounds:
                bound = F.col("cost") / units + lower_bound(F.col("progress"), F.col("x"), F.col("y"), bounds, order)
                moved = moved.withColumn("_b", bound)
                moved = moved.where(F.col("_b") < best / units) if best is not None else moved
            else:
                moved = moved.withColumn("_b", F.col("cost").cast("double"))
                moved = moved.where(F.col("cost") < best) if best is not None else moved
            if beam:
                moved = moved.orderBy("_b", "edge_id").limit(beam)
            moved = one_per_key(moved.select("edge_id", "progress", "cost", "length", "from_edge", "from_progress"), ["edge_id", "progress"])
            old = labels.select("edge_id", "progress", F.col("cost").alias("_c"))
            better = kept(moved.join(old, ["edge_id", "progress"], "left").where("_c IS NULL OR cost < _c").drop("_c"))
            labels = kept(labels.join(better, ["edge_id", "progress"], "left_anti").unionByName(better))
            frontier = better
        #: edge_id, progress, cost, length, from_edge, from_progress
        self.labels, self.rejected, self.stopped = labels, rejected, self.rounds >= most_rounds

    def goal_label(self) -> tuple | None:
        best = self.labels.where(F.col("progress") == self.goal).agg(F.min(F.struct("cost", "length", "edge_id")).alias("x")).first()["x"]
        return tuple(best) if best else None

    def path(self) -> list[str]:
        """The walk's edges, back over the labels. The predecessors of one walk, not all labels, come to the driver."""
        if not (goal := self.goal_label()):
            return []
        at, out = (goal[2], self.goal), []
        while at[0] is not None:
            out.append(at[0])
            row = self.labels.where((F.col("edge_id") == at[0]) & (F.col("progress") == at[1])).select("from_edge", "from_progress").first()
            at = (row["from_edge"], row["from_progress"])
        return out[::-1]

    def outcome(self) -> dict:
        """One row's worth: category, cost, length, last edge, why it failed, and the longest order that was reached."""
        goal = self.goal_label()
        reached = self.labels.agg(F.max("progress").alias("p")).first()["p"] or 0
        if goal:
            return {"category": "FEASIBLE", "cost": goal[0], "length": goal[1], "reached": self.goal, "reason": None}
        if not self.started:
            return {"category": "INVALID_INPUT", "cost": None, "length": None, "reached": 0, "reason": "no such start"}
        if self.stopped:
            return {"category": "TIMEOUT", "cost": None, "length": None, "reached": reached, "reason": f"more than {self.rounds} rounds"}
        if self.rejected:
            return {"category": "ORDER_INVALID_BY_FIRST_HIT", "cost": None, "length": None, "reached": reached, "reason": f"{self.rejected[1]}->{self.rejected[2]}"}
        return {"category": "UNREACHABLE", "cost": None, "length": None, "reached": reached, "reason": "zero outgoing labels"}


def attempt(graph: RoadGraph, route: str, order: list[int], start: str, **options) -> dict:
    """An outcome row whatever happens."""
    try:
        return {"route": route, "order": order} | FixedOrder(graph, start, order, **options).outcome()
    except Exception as e:  # noqa: BLE001  each attempt is one row
        return {"route": route, "order": order, "category": "EXCEPTION", "cost": None, "length": None, "reached": 0, "reason": f"{type(e).__name__}: {e}"[:500]}


OUTCOMES = "route string, order array<int>, category string, cost bigint, length bigint, reached int, reason string"


def evaluated(graph: RoadGraph, schedule: list[tuple[str, list[int]]], start: str, **options) -> DataFrame:
    """OUTCOMES of a schedule of (route, order); equal orders are searched once."""
    memo: dict[tuple[int, ...], dict] = {}
    steps, rows = kept(graph.steps().where(off_order(*[o for _, o in schedule]))), []
    for route, order in schedule:
        if (key := tuple(order)) not in memo:
            memo[key] = attempt(graph, route, order, start, steps=steps, **options)
        rows.append(memo[key] | {"route": route})
    names = [x.split()[0] for x in OUTCOMES.split(", ")]
    return graph.edges.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in rows], OUTCOMES)


def reconciled(primary: DataFrame, checker: DataFrame, cost_within: int = 0, length_within: int = 0) -> DataFrame:
    """Outcomes beside an independent check (route, cost, length): a difference beyond the tolerance turns FEASIBLE into CHECKER_MISMATCH."""
    c = checker.select("route", F.col("cost").alias("_cost"), F.col("length").alias("_length"))
    both = primary.join(c, "route", "left")
    off = F.col("_cost").isNull() | (F.abs(F.col("cost") - F.col("_cost")) > cost_within) | (F.abs(F.col("length") - F.col("_length")) > length_within)
    bad = (F.col("category") == "FEASIBLE") & off
    return both.withColumn("category", F.when(bad, "CHECKER_MISMATCH").otherwise(F.col("category"))).drop("_cost", "_length")
