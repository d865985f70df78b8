"""Subdivision of edges at polygon borders: children with exact costs and masks, split points, gates, internal turns.

edges: line (the parent's id), ax, ay, bx, by, length_u, duration_u (integers). rings: region = bit of a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fractions, ids
from . import planar
from .stored import kept as stored

ONE = 10**12
INHERITED, INTERNAL = "inherited_stage2a_turn", "internal_split_continuation"


def allocate(total: int, breaks: list[int]) -> list[int]:
    """Largest-remainder shares of a total over intervals of integer breaks."""
    widths, whole = [b - a for a, b in zip(breaks, breaks[1:], strict=False)], breaks[-1] - breaks[0]
    shares = [total * w // whole for w in widths]
    by = sorted(range(len(widths)), key=lambda i: (-(total * widths[i] % whole), i))
    for i in by[: total - sum(shares)]:
        shares[i] += 1
    return shares


def coalesce(breaks: list[int], length: int) -> tuple[list[int], list[int]]:
    """Breaks without intervals of length 0, and where each given break went. An empty interval loses its right end, the last one its left end."""
    if len(breaks) < 2 or breaks[0] != 0 or breaks[-1] != ONE or any(a >= b for a, b in zip(breaks, breaks[1:], strict=False)):
        raise ValueError("breaks must ascend from 0 to 1")
    if length <= 0:
        return [0, ONE], [0 if 2 * b <= ONE else ONE for b in breaks]
    kept, to = list(breaks), {b: b for b in breaks}
    while len(kept) > 2 and 0 in (shares := allocate(length, kept)):
        i = shares.index(0)
        if i + 1 < len(kept) - 1:
            gone, target = kept.pop(i + 1), kept[i]
        elif i > 0:
            gone, target = kept.pop(i), kept[i]
        else:
            break
        to = {b: target if t == gone else t for b, t in to.items()}
    return kept, [to[b] for b in breaks]


def _coalesced(cuts: DataFrame) -> DataFrame:
    """line, f, to: each break in units of 10^-12 and where it goes. Only parents with an interval that may be empty go through Python."""
    units = (F.col("fraction") * ONE).cast("long")
    per = cuts.groupBy("line", "length_u").agg(F.array_sort(F.collect_set(units)).alias("breaks"))
    narrow = F.exists(F.arrays_zip(F.slice("breaks", 1, F.size("breaks") - 1).alias("a"), F.slice("breaks", 2, F.size("breaks") - 1).alias("b")), lambda x: (x["b"] - x["a"]).cast("decimal(38,0)") * F.col("length_u") < ONE)
    wide = per.where(~narrow & (F.col("length_u") > 0)).select("line", F.col("breaks").alias("f"), F.col("breaks").alias("to"))
    move = F.udf(lambda b, n: coalesce(list(b), n)[1], "array<bigint>", useArrow=True)
    rest = per.where(narrow | (F.col("length_u") <= 0)).select("line", F.col("breaks").alias("f"), move("breaks", "length_u").alias("to"))
    both = wide.unionByName(rest)
    return both.select("line", F.explode(F.arrays_zip("f", "to")).alias("x")).select("line", "x.*")


class Split:
    """The tables of one subdivision. Parents that meet no border have one child, with ordinal 0."""

    def __init__(self, edges: DataFrame, rings: DataFrame, cell: float, raw: str = "", depth: str = "0"):
        pairs = stored(planar.candidates(edges.select("line", "ax", "ay", "bx", "by"), rings, cell))
        lines = edges.select("line", "ax", "ay", "bx", "by")
        pieces = planar.pieces(lines, rings, pairs, cell)
        self.events = stored(planar.events(pieces, lines, rings, cell))
        ends = edges.select("line", "length_u", F.explode(F.array(F.lit(0).cast(planar.UNIT), F.lit(1).cast(planar.UNIT))).alias("fraction"))
        cuts = ends.unionByName(self.events.select("line", "fraction").distinct().join(edges.select("line", "length_u"), "line")).distinct()
        moved = stored(_coalesced(cuts))
        w = W.partitionBy("line").orderBy("f")
        kept = moved.select("line", F.col("to").alias("f")).distinct()
        child = kept.withColumns({"ordinal": F.row_number().over(w) - 1, "f1": F.lead("f").over(w)}).where("f1 IS NOT NULL").withColumnRenamed("f", "f0")
        both = child.join(edges, "line")
        grouped = both.groupBy(*edges.columns).agg(F.array_sort(F.collect_list(F.struct("ordinal", "f0", "f1"))).alias("c"))
        widths = F.transform("c", lambda x: (x["f1"] - x["f0"]).cast("decimal(18,0)"))
        shares = lambda of: fractions.shares(F.col(of), widths)
        zipped = F.arrays_zip(F.col("c"), shares("length_u").alias("length"), shares("duration_u").alias("duration"))
        flat = grouped.select("line", "ax", "ay", "bx", "by", F.explode(zipped).alias("z"))
        at = lambda a, b, f: F.col(a) + f / float(ONE) * (F.col(b) - F.col(a))
        f0, f1 = F.col("z.c.f0"), F.col("z.c.f1")
        flat = flat.select(
            "line", F.col("z.c.ordinal").alias("ordinal"), f0.alias("f0"), f1.alias("f1"), F.col("z.length").alias("length_u"), F.col("z.duration").alias("duration_u"),
            at("ax", "bx", f0).alias("x0"), at("ay", "by", f0).alias("y0"), at("ax", "bx", f1).alias("x1"), at("ay", "by", f1).alias("y1"),
        )
        flat = stored(flat)
        mids = flat.select("line", "ordinal", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")).join(pairs, "line")
        masks = planar.inside(mids, rings, ["line", "ordinal"], cell).where("inside").groupBy("line", "ordinal").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("region").cast("int"))).alias("mask"))
        #: line, ordinal, child, f0, f1, length_u, duration_u, x0, y0, x1, y1, mask
        self.children = flat.join(masks, ["line", "ordinal"], "left").withColumn("mask", F.coalesce("mask", F.lit(0))).withColumn("child", ids.child_id(F.col("line").cast("string"), F.col("ordinal")))
        met = self.events.withColumn("f", (F.col("fraction") * ONE).cast("long")).join(moved, ["line", "f"])
        kept_at = kept.withColumn("ordinal", F.row_number().over(w) - 1)
        n = kept.groupBy("line").agg((F.count(F.lit(1)) - 1).alias("n"))
        met = met.join(kept_at.select("line", F.col("f").alias("to"), "ordinal"), ["line", "to"]).join(n, "line")
        side = lambda o, there: F.when(there, ids.child_id(F.col("line").cast("string"), o))
        text = (F.col("to") / F.lit(ONE).cast("decimal(13,0)")).cast(planar.UNIT).cast("string")
        point = ids.content_id(F.col("line"), text, F.lit(raw), F.lit(depth))
        #: region (bit), category, point_id, line, fraction, in_child, out_child: a gate for each event
        self.gates = met.select("region", "category", point.alias("point_id"), "line", text.alias("fraction"), side(F.col("ordinal") - 1, F.col("ordinal") > 0).alias("in_child"), side(F.col("ordinal"), F.col("ordinal") < F.col("n")).alias("out_child"))
        bit = F.call_function("shiftleft", F.lit(1), F.col("region").cast("int"))
        event = F.struct(F.col("region").cast("int").alias("bit_index"), "category", F.col("hole").alias("hole_boundary"), F.col("raw").cast("string").alias("unquantized_fraction"))
        #: point_id, line, fraction, mask, raw_fractions, events (canonical JSON)
        self.points = met.select(point.alias("point_id"), "line", text.alias("fraction"), bit.alias("b"), F.col("raw").cast("string").alias("r"), event.alias("e")).groupBy("point_id", "line", "fraction").agg(
            F.bit_or("b").alias("mask"), F.to_json(F.array_sort(F.collect_set("r"))).alias("raw_fractions"), F.to_json(F.array_sort(F.collect_list("e"))).alias("events"))

    def internal(self) -> DataFrame:
        """in_edge, out_edge, turn_u, category: the turn from each child to the next one of its parent costs nothing."""
        text = F.col("line").cast("string")
        return self.children.where("ordinal > 0").select(ids.child_id(text, F.col("ordinal") - 1).alias("in_edge"), F.col("child").alias("out_edge"), F.lit(0).cast("bigint").alias("turn_u"), F.lit(INTERNAL).alias("category"))

    def inherited(self, turns: DataFrame) -> DataFrame:
        """Turns between parents (in_edge, out_edge, turn_u) from the last child of one to the first of the other. Most parents are not split: only the others' last ordinals travel."""
        last = self.children.groupBy(F.col("line").cast("string").alias("_l")).agg(F.max("ordinal").alias("k")).where("k > 0")
        out = turns.join(last, F.col("in_edge") == F.col("_l"), "left")
        return out.select(ids.child_id(F.col("in_edge"), F.coalesce("k", F.lit(0))).alias("in_edge"), ids.child_id(F.col("out_edge"), F.lit(0)).alias("out_edge"), "turn_u", F.lit(INHERITED).alias("category"))

    def preserved(self, edges: DataFrame) -> DataFrame:
        """One row: parents, children, split parents and whether lengths and durations are those of the parents."""
        wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
        of = self.children.groupBy("line").agg(F.count(F.lit(1)).alias("n"), wide("length_u").alias("l"), wide("duration_u").alias("d"))
        both = edges.join(of, "line", "left")
        lost = ~(F.col("l").eqNullSafe(F.col("length_u").cast("decimal(30,0)")) & F.col("d").eqNullSafe(F.col("duration_u").cast("decimal(30,0)")))
        return both.agg(F.count(F.lit(1)).alias("parents"), F.sum("n").alias("children"), F.count_if(F.col("n") > 1).alias("split_parents"), F.count_if(lost).alias("lost"))
