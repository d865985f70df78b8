"""Planar geometry over ring segments: crossings, containment, classes, erosion, nearest segment.

rings: region, ring, is_hole, seq, x1, y1, x2, y2. lines: line, ax, ay, bx, by. Tables of rings are
dealt with lines by an equality on a grid cell where they are large; a few literal rings are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fractions


def crossings(lines: DataFrame, rings: DataFrame) -> DataFrame:
    """line, region, is_hole, fraction (twelve places)."""
    met = lines.join(F.broadcast(rings)).withColumn("t", crossing_fraction())
    return met.where("t IS NOT NULL").select("line", "region", "is_hole", fractions.unit_of(F.col("t")).alias("fraction")).distinct()


def crossing_fraction() -> Column:
    """Where a line meets a ring segment, as a fraction of the line; null if it does not, or is parallel.

    The segment's start belongs to it and its end does not, so a shared vertex counts once."""
    dx, dy, ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    den = F.nullif(dx * ey - dy * ex, F.lit(0.0))
    t = ((F.col("x1") - F.col("ax")) * ey - (F.col("y1") - F.col("ay")) * ex) / den
    u = ((F.col("x1") - F.col("ax")) * dy - (F.col("y1") - F.col("ay")) * dx) / den
    return F.when((t >= 0) & (t <= 1) & (u >= 0) & (u < 1), t)


def crosses_ray(x: str, y: str) -> Column:
    """Does a ray to the right of the point cross the ring segment?"""
    above = (F.col("y1") > F.col(y)) != (F.col("y2") > F.col(y))
    at = F.col("x1") + (F.col(y) - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    return above & (F.col(x) < at)


def containment(points: DataFrame, rings: DataFrame, key: list[str]) -> DataFrame:
    """key, region, inside: by the parity of a ray's crossings. points: key, x, y."""
    met = points.join(F.broadcast(rings))
    return met.groupBy(*key, "region").agg((F.sum(F.coalesce(crosses_ray("x", "y"), F.lit(False)).cast("int")) % 2 == 1).alias("inside"))


def intervals(lines: DataFrame, rings: DataFrame) -> DataFrame:
    """line, region, ordinal, f0, f1, inside: the pieces of each line between its crossings with a region."""
    regions = rings.select("region").distinct()
    ends = lines.select("line").join(F.broadcast(regions)).select("line", "region", F.explode(F.array(F.lit(0).cast("decimal(13,12)"), F.lit(1).cast("decimal(13,12)"))).alias("fraction"))
    cuts = crossings(lines, rings).select("line", "region", "fraction").unionByName(ends).distinct()
    w = W.partitionBy("line", "region").orderBy("fraction")
    pieces = cuts.select("line", "region", F.col("fraction").alias("f0"), F.lead("fraction").over(w).alias("f1"), (F.row_number().over(w) - 1).alias("ordinal")).where("f1 IS NOT NULL")
    mid = ((F.col("f0") + F.col("f1")) / 2).cast("double")
    placed = pieces.join(lines, "line").withColumn("x", F.col("ax") + mid * (F.col("bx") - F.col("ax"))).withColumn("y", F.col("ay") + mid * (F.col("by") - F.col("ay")))
    points = placed.select("line", "region", "ordinal", "f0", "f1", "x", "y")
    met = points.join(F.broadcast(rings.withColumnRenamed("region", "_r")), F.col("region") == F.col("_r"))
    return met.groupBy("line", "region", "ordinal", "f0", "f1").agg((F.sum(F.coalesce(crosses_ray("x", "y"), F.lit(False)).cast("int")) % 2 == 1).alias("inside"))


def classified(pieces: DataFrame) -> DataFrame:
    """line, region, class by the pieces inside and outside."""
    first, last = F.min_by("inside", "ordinal"), F.max_by("inside", "ordinal")
    runs = W.partitionBy("line", "region").orderBy("ordinal")
    enters = pieces.withColumn("_in", (F.col("inside") & ~F.coalesce(F.lag("inside").over(runs), F.lit(False))).cast("int"))
    agg = enters.groupBy("line", "region").agg(first.alias("a"), last.alias("b"), F.bool_or("inside").alias("some"), F.bool_and("inside").alias("all"), F.sum("_in").alias("runs"))
    kind = F.when(F.col("all"), "fully_inside").when(~F.col("some"), "fully_outside").when(F.col("runs") > 1, "multiple_crossings").when(F.col("a"), "exiting").when(F.col("b"), "entering").otherwise("crossing")
    return agg.select("line", "region", kind.alias("class"), F.col("runs").cast("long").alias("inside_runs"))


def distance_to_segment(px: Column, py: Column) -> tuple[Column, Column]:
    """Distance of a point to the segment a-b and the fraction of its foot."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    norm = dx * dx + dy * dy
    t = F.when(norm == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - F.col("ax")) * dx + (py - F.col("ay")) * dy) / F.nullif(norm, F.lit(0.0)))))
    return F.sqrt(F.pow(px - F.col("ax") - t * dx, 2) + F.pow(py - F.col("ay") - t * dy, 2)), t


def nearest(lines: DataFrame, px: float, py: float, ties: list[str], within: float | None = None) -> DataFrame:
    """The line nearest to a point, by its distance in whole millimetres, then ties. One row; no sort.

    Only lines within a distance count, if there is one: a box around the point is tested first."""
    if within is not None:
        lines = lines.where((F.greatest("ax", "bx") >= px - within) & (F.least("ax", "bx") <= px + within) & (F.greatest("ay", "by") >= py - within) & (F.least("ay", "by") <= py + within))
        lines = lines.where(distance_to_segment(F.lit(px), F.lit(py))[0] <= within)
    d, t = distance_to_segment(F.lit(px), F.lit(py))
    mm = F.bround(d * 1000, 0).cast("bigint")
    best = F.min(F.struct(mm.alias("mm"), *ties, F.round(t, 9).alias("fraction")))
    return lines.agg(best.alias("x")).select("x.*")


def eroded(lines: DataFrame, rings: DataFrame, depth: float) -> DataFrame:
    """line, region, ordinal, f0, f1: the pieces of lines that are inside a region and at least `depth` from its border.

    A border segment forbids the fractions at which the line is within its capsule; their union is taken by
    gaps and islands and what is left of the inside pieces is returned. No polygon is buffered."""
    inside = intervals(lines, rings).where("inside").select("line", "region", F.col("f0").cast("double"), F.col("f1").cast("double"))
    spans = with_forbidden(lines.join(F.broadcast(rings)), depth).select("line", "region", F.explode("spans").alias("s")).where("s.lo IS NOT NULL AND s.hi IS NOT NULL")
    spans = spans.select("line", "region", F.round(F.greatest(F.lit(0.0), F.col("s.lo")), 12).alias("lo"), F.round(F.least(F.lit(1.0), F.col("s.hi")), 12).alias("hi")).where("lo < hi")
    before = W.partitionBy("line", "region").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    running = W.partitionBy("line", "region").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, 0)
    marked = spans.withColumn("new", (F.col("lo") > F.coalesce(F.max("hi").over(before), F.lit(-1.0))).cast("int")).withColumn("island", F.sum("new").over(running))
    merged = marked.groupBy("line", "region", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cut = inside.join(merged.groupBy("line", "region").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("gone")), ["line", "region"], "left")
    starts = F.concat(F.array("f0"), F.transform(F.coalesce("gone", F.array().cast("array<struct<lo:double,hi:double>>")), lambda g: F.greatest(F.col("f0"), g["hi"])))
    stops = F.concat(F.transform(F.coalesce("gone", F.array().cast("array<struct<lo:double,hi:double>>")), lambda g: F.least(F.col("f1"), g["lo"])), F.array("f1"))
    pieces = cut.select("line", "region", F.explode(F.arrays_zip(starts.alias("f0"), stops.alias("f1"))).alias("p")).select("line", "region", "p.*").where("f0 < f1")
    w = W.partitionBy("line", "region").orderBy("f0")
    return pieces.select("line", "region", (F.row_number().over(w) - 1).alias("ordinal"), "f0", "f1")


def with_forbidden(pairs: DataFrame, depth: float) -> DataFrame:
    """pairs of lines and border segments with `spans`: the fractions in the strip beside the segment and in the discs
    round its ends. Each step is a projection of its own, so that no expression is repeated in the next one."""
    no, low, high = F.lit(0.0), F.lit(float("-inf")), F.lit(float("inf"))
    c = F.col
    out = pairs.withColumns({"_dx": c("bx") - c("ax"), "_dy": c("by") - c("ay"), "_ex": c("x2") - c("x1"), "_ey": c("y2") - c("y1")})
    out = out.withColumns({"_aa": F.nullif(c("_dx") * c("_dx") + c("_dy") * c("_dy"), no), "_len": F.nullif(F.sqrt(c("_ex") * c("_ex") + c("_ey") * c("_ey")), no)})
    across = lambda x, y: (y * c("_ex") - x * c("_ey")) / c("_len")
    along = lambda x, y: (x * c("_ex") + y * c("_ey")) / (c("_len") * c("_len"))
    ux, uy = c("ax") - c("x1"), c("ay") - c("y1")
    out = out.withColumns({"_h0": across(ux, uy), "_hd": across(c("_dx"), c("_dy")), "_s0": along(ux, uy), "_sd": along(c("_dx"), c("_dy"))})
    steps = {}
    for n, a, b in (("h", -depth, depth), ("s", 0.0, 1.0)):
        v0, vd = c(f"_{n}0"), F.nullif(c(f"_{n}d"), no)
        inside = (v0 > a) & (v0 < b)
        steps[f"_{n}lo"] = F.coalesce(F.least((a - v0) / vd, (b - v0) / vd), F.when(inside, low).otherwise(high))
        steps[f"_{n}hi"] = F.coalesce(F.greatest((a - v0) / vd, (b - v0) / vd), F.when(inside, high).otherwise(low))
    out = out.withColumns(steps)
    for k, (cx, cy) in enumerate((("x1", "y1"), ("x2", "y2"))):
        vx, vy = c("ax") - c(cx), c("ay") - c(cy)
        out = out.withColumns({f"_b{k}": (vx * c("_dx") + vy * c("_dy")) / c("_aa"), f"_c{k}": (vx * vx + vy * vy - depth * depth) / c("_aa")})
        out = out.withColumn(f"_r{k}", F.sqrt(F.when(c(f"_b{k}") * c(f"_b{k}") > c(f"_c{k}"), c(f"_b{k}") * c(f"_b{k}") - c(f"_c{k}"))))
    span = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    discs = [span(-c(f"_b{k}") - c(f"_r{k}"), -c(f"_b{k}") + c(f"_r{k}")) for k in (0, 1)]
    strip = span(F.when(c("_len").isNotNull(), F.greatest("_hlo", "_slo")), F.least("_hhi", "_shi"))
    return out.withColumn("spans", F.array(strip, *discs))
