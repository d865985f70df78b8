"""Lines against polygon borders over a grid: contacts, the event list, eleven classes, areas, hashes, validity.

rings: region, ring, is_hole, seq, x1, y1, x2, y2. lines: line, ax, ay, bx, by. Lines and border segments meet through
an equality on a grid cell; a pair of boxes is kept only in the lower left of its common cells, so nothing is counted
twice and no table is broadcast. `cell` should be some times a line's length; a long segment stands in each cell of its box."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fractions
from .geometry import crosses_ray, distance_to_segment
from .stored import kept

#: Shorter shared pieces are touches, shorter lines are degenerate.
SHORT = 1e-9
#: Metres from a hole's border within which an event belongs to it.
HOLE_M = 0.01
UNIT = "decimal(13,12)"
CLASSES = (
    "degenerate_numerical_case", "overlap_along_boundary", "multiple_crossings", "crossing_polygon_hole_boundary", "tangential_touch", "fully_inside", "fully_outside",
    "exiting", "entering", "crossing", "endpoint_on_boundary",
)


def _cells(x1: str, y1: str, x2: str, y2: str, cell: float) -> Column:
    """cx, cy of the cells of a box, with its lowest ones."""
    low = lambda a, b: F.floor(F.least(a, b) / cell)
    high = lambda a, b: F.floor(F.greatest(a, b) / cell)
    row = lambda y: F.transform(F.sequence(low(x1, x2), high(x1, x2)), lambda x: F.struct(x.alias("cx"), y.alias("cy"), low(x1, x2).alias("lx"), low(y1, y2).alias("ly")))
    return F.flatten(F.transform(F.sequence(low(y1, y2), high(y1, y2)), row))


def near(lines: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """Pairs of lines and border segments whose boxes share a cell, each once."""
    a = lines.select("*", F.explode(_cells("ax", "ay", "bx", "by", cell)).alias("_a"))
    b = rings.select("*", F.explode(_cells("x1", "y1", "x2", "y2", cell)).alias("_b"))
    met = a.join(b, (F.col("_a.cx") == F.col("_b.cx")) & (F.col("_a.cy") == F.col("_b.cy")))
    return met.where((F.col("_a.cx") == F.greatest("_a.lx", "_b.lx")) & (F.col("_a.cy") == F.greatest("_a.ly", "_b.ly"))).drop("_a", "_b")


def boxes(rings: DataFrame) -> DataFrame:
    """region, x1, y1, x2, y2."""
    return rings.groupBy("region").agg(F.min(F.least("x1", "x2")).alias("x1"), F.min(F.least("y1", "y2")).alias("y1"), F.max(F.greatest("x1", "x2")).alias("x2"), F.max(F.greatest("y1", "y2")).alias("y2"))


def candidates(lines: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """line, region where the boxes of a line and a region overlap."""
    met = near(lines, boxes(rings), cell)
    apart = (F.greatest("ax", "bx") < F.col("x1")) | (F.least("ax", "bx") > F.col("x2")) | (F.greatest("ay", "by") < F.col("y1")) | (F.least("ay", "by") > F.col("y2"))
    return met.where(~apart).select("line", "region")


def accounted(lines: DataFrame, rings: DataFrame, found: DataFrame) -> DataFrame:
    """region, class, n: how many lines each region has of each class. What no box test let through is fully outside."""
    every = lines.agg(F.count(F.lit(1)).alias("n_lines"))
    counts = found.groupBy("region", "class").agg(F.count(F.lit(1)).alias("n"))
    met = rings.select("region").distinct().join(counts.groupBy("region").agg(F.sum("n").alias("met")), "region", "left").withColumn("n_lines", every.scalar())
    rest = met.select("region", F.lit("fully_outside").alias("class"), (F.col("n_lines") - F.coalesce("met", F.lit(0))).alias("n"))
    return counts.unionByName(rest).groupBy("region", "class").agg(F.sum("n").alias("n")).where("n > 0")


def contacts(lines: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """line, region, is_hole, t, overlap: where a line meets a border segment; both ends of a shared piece."""
    c = F.col
    dx, dy, ex, ey = c("bx") - c("ax"), c("by") - c("ay"), c("x2") - c("x1"), c("y2") - c("y1")
    met = near(lines, rings, cell).withColumns({"_dx": dx, "_dy": dy, "_ex": ex, "_ey": ey, "_ux": c("x1") - c("ax"), "_uy": c("y1") - c("ay")})
    met = met.withColumns({"_den": c("_dx") * c("_ey") - c("_dy") * c("_ex"), "_len2": c("_dx") * c("_dx") + c("_dy") * c("_dy"), "_off": c("_ux") * c("_dy") - c("_uy") * c("_dx")}).where(F.sqrt("_len2") > SHORT)
    t, u = (c("_ux") * c("_ey") - c("_uy") * c("_ex")) / F.nullif("_den", F.lit(0.0)), c("_off") / F.nullif("_den", F.lit(0.0))
    along = lambda x, y: ((c(x) - c("ax")) * c("_dx") + (c(y) - c("ay")) * c("_dy")) / c("_len2")
    met = met.withColumns({"_t": t, "_u": u, "_p": F.least(along("x1", "y1"), along("x2", "y2")), "_q": F.greatest(along("x1", "y1"), along("x2", "y2"))})
    lo, hi = F.greatest(F.lit(0.0), "_p"), F.least(F.lit(1.0), "_q")
    point = lambda x, o: F.struct(x.alias("t"), o.alias("overlap"))
    shared = (hi - lo) * F.sqrt("_len2") > SHORT
    parallel = F.when((c("_off") == 0) & (lo <= hi), F.array(point(lo, shared), point(hi, shared)))
    crossing = F.when((c("_t") >= 0) & (c("_t") <= 1) & (c("_u") >= 0) & (c("_u") <= 1), F.array(point(c("_t"), F.lit(False))))
    return met.select("line", "region", "is_hole", F.explode(F.when(c("_den") == 0, parallel).otherwise(crossing)).alias("p")).select("line", "region", "is_hole", "p.*")


def inside(points: DataFrame, rings: DataFrame, key: list[str], cell: float) -> DataFrame:
    """points (key, region, x, y) with `inside`, by the parity of a ray's crossings with the region's segments of the point's row."""
    rows = rings.select(F.col("region").alias("_r"), "x1", "y1", "x2", "y2", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))).alias("_cy"))
    met = points.join(rows, (F.col("region") == F.col("_r")) & (F.floor(F.col("y") / cell) == F.col("_cy")), "left")
    return met.groupBy(*key, "region").agg((F.sum(F.coalesce(crosses_ray("x", "y"), F.lit(False)).cast("int")) % 2 == 1).alias("inside"))


def on_hole(points: DataFrame, rings: DataFrame, key: list[str], cell: float, within: float = HOLE_M) -> DataFrame:
    """key, region of the points within a distance of a hole's border."""
    grown = points.select(*key, "region", "x", "y", (F.col("x") - within).alias("ax"), (F.col("y") - within).alias("ay"), (F.col("x") + within).alias("bx"), (F.col("y") + within).alias("by"))
    met = near(grown, rings.where("is_hole").withColumnRenamed("region", "_r"), cell).where("region = _r")
    met = met.select(*key, "region", "x", "y", F.col("x1").alias("ax"), F.col("y1").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by"))
    return met.where(distance_to_segment(F.col("x"), F.col("y"))[0] <= within).select(*key, "region").distinct()


def pieces(lines: DataFrame, rings: DataFrame, pairs: DataFrame, cell: float) -> DataFrame:
    """line, region, ordinal, f0, f1, raw0, raw1, overlap, inside: pairs' lines cut where they meet the border. A shared piece is not inside."""
    met = contacts(lines, rings, cell).withColumn("fraction", fractions.unit_of(F.col("t")))
    cuts = met.groupBy("line", "region", "fraction").agg(F.min("t").alias("raw"), F.bool_or("overlap").alias("overlap"))
    ends = pairs.select("line", "region", F.explode(F.array(F.lit(0).cast(UNIT), F.lit(1).cast(UNIT))).alias("fraction"))
    every = kept(ends.join(cuts, ["line", "region", "fraction"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(False))).unionByName(cuts.join(ends, ["line", "region", "fraction"], "left_anti").join(pairs, ["line", "region"], "left_semi")))
    w = W.partitionBy("line", "region").orderBy("fraction")
    nxt = lambda c: F.lead(c).over(w)
    cut = every.select("line", "region", (F.row_number().over(w) - 1).alias("ordinal"), F.col("fraction").alias("f0"), nxt("fraction").alias("f1"), F.col("raw").alias("raw0"), nxt("raw").alias("raw1"), "overlap").where("f1 IS NOT NULL")
    mid = ((F.col("f0") + F.col("f1")) / 2).cast("double")
    placed = cut.join(lines, "line").select(cut["*"], (F.col("ax") + mid * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + mid * (F.col("by") - F.col("ay"))).alias("y"))
    found = inside(placed, rings, ["line", "ordinal"], cell)
    on_border = on_border_at(placed, rings, cell)
    out = cut.join(found, ["line", "region", "ordinal"]).join(on_border, ["line", "region", "ordinal"], "left")
    return kept(out.select(*cut.columns, (F.col("inside") & F.col("on_border").isNull()).alias("inside")))


def on_border_at(points: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """line, region, ordinal of points that lie on the border itself."""
    at = points.select("line", "region", "ordinal", *[(F.col(c) + o).alias(n) for n, c, o in (("ax", "x", -SHORT), ("ay", "y", -SHORT), ("bx", "x", SHORT), ("by", "y", SHORT))], F.col("x").alias("px"), F.col("y").alias("py"))
    met = near(at, rings.withColumnRenamed("region", "_r"), cell).where("region = _r")
    met = met.select("line", "region", "ordinal", "px", "py", F.col("x1").alias("ax"), F.col("y1").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by"))
    return met.where(distance_to_segment(F.col("px"), F.col("py"))[0] <= SHORT).select("line", "region", "ordinal", F.lit(True).alias("on_border")).distinct()


def events(piece_rows: DataFrame, lines: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """line, region, fraction, raw, category, hole: what happens where a line meets the border."""
    w = W.partitionBy("line", "region").orderBy("ordinal")
    overlap = F.coalesce(F.bool_or("overlap").over(W.partitionBy("line", "region")), F.lit(False))
    starts = piece_rows.select("line", "region", F.col("f0").alias("fraction"), F.col("raw0").alias("raw"), F.lag("inside", 1, False).over(w).alias("before"), F.col("inside").alias("after"), overlap.alias("overlap"))
    stop = piece_rows.select("line", "region", F.col("f1").alias("fraction"), F.col("raw1").alias("raw"), F.col("inside").alias("before"), F.lit(False).alias("after"), overlap.alias("overlap")).where("fraction = 1")
    met = starts.unionByName(stop).where("raw IS NOT NULL")
    f = F.col("fraction").cast("double")
    at = met.join(lines, "line").select("line", "region", "fraction", (F.col("ax") + f * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + f * (F.col("by") - F.col("ay"))).alias("y"))
    holes = on_hole(at, rings, ["line", "fraction"], cell).withColumn("hole", F.lit(True))
    met = met.join(holes, ["line", "region", "fraction"], "left").withColumn("hole", F.coalesce("hole", F.lit(False)))
    turn = F.when(~F.col("before") & F.col("after"), "entering").when(F.col("before") & ~F.col("after"), "exiting")
    category = F.when((F.col("fraction") == 0) | (F.col("fraction") == 1), "endpoint_on_boundary").when(F.col("overlap"), "overlap_along_boundary").when(turn.isNull(), "tangential_touch").when(F.col("hole"), "crossing_polygon_hole_boundary").otherwise(turn)
    return met.select("line", "region", "fraction", "raw", category.alias("category"), "hole")


def classified(lines: DataFrame, rings: DataFrame, cell: float, pairs: DataFrame | None = None) -> DataFrame:
    """line, region, class, inside_runs, n_events of the given pairs, or of all whose boxes overlap."""
    pairs = kept(candidates(lines, rings, cell)) if pairs is None else pairs
    cut = pieces(lines, rings, pairs, cell)
    found = events(cut, lines, rings, cell)
    is_in = lambda *names: F.col("category").isin(*names)
    e = found.groupBy("line", "region").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(is_in("entering", "exiting", "crossing_polygon_hole_boundary")).alias("turns"), F.bool_or("hole").alias("hole"),
        F.bool_or(is_in("tangential_touch")).alias("touch"), F.bool_and(is_in("endpoint_on_boundary")).alias("ends"),
    )
    w = W.partitionBy("line", "region").orderBy("ordinal")
    runs = cut.withColumn("_new", (F.col("inside") & ~F.lag("inside", 1, False).over(w)).cast("int"))
    p = runs.groupBy("line", "region").agg(F.bool_or("inside").alias("some"), F.min_by("inside", "ordinal").alias("first"), F.max_by("inside", "ordinal").alias("last"), F.coalesce(F.bool_or("overlap"), F.lit(False)).alias("overlap"), F.sum("_new").alias("inside_runs"))
    c = F.col
    turns = F.coalesce("turns", F.lit(0))
    kind = (
        F.when(c("overlap"), "overlap_along_boundary").when(turns > 2, "multiple_crossings").when(F.coalesce("hole", F.lit(False)), "crossing_polygon_hole_boundary")
        .when(F.coalesce("touch", F.lit(False)) & ~c("some"), "tangential_touch").when(c("n_events").isNull(), F.when(c("some"), "fully_inside").otherwise("fully_outside"))
        .when(c("some") & c("first") & (turns == 1), "exiting").when(c("some") & c("last") & (turns == 1), "entering").when(c("some") & (turns >= 2), "crossing")
        .when(c("ends"), "endpoint_on_boundary").otherwise("fully_outside")
    )
    length = F.hypot(c("bx") - c("ax"), c("by") - c("ay"))
    short = lines.where(length <= SHORT).select("line", F.lit(True).alias("_short"))
    out = p.join(e, ["line", "region"], "left").join(short, "line", "left")
    is_short = c("_short").isNotNull()
    return out.select("line", "region", F.when(is_short, "degenerate_numerical_case").otherwise(kind).alias("class"), F.when(is_short, 0).otherwise(c("inside_runs")).cast("long").alias("inside_runs"), F.when(is_short, 0).otherwise(F.coalesce("n_events", F.lit(0))).cast("long").alias("n_events"))


def measured(rings: DataFrame) -> DataFrame:
    """region, area, perimeter, parts (rings that are no holes), holes. Holes count negative whatever their direction."""
    c = F.col
    ring = rings.groupBy("region", "ring", "is_hole").agg((F.abs(F.sum(c("x1") * c("y2") - c("x2") * c("y1"))) / 2).alias("area"), F.sum(F.hypot(c("x2") - c("x1"), c("y2") - c("y1"))).alias("perimeter"))
    return ring.groupBy("region").agg(F.sum(F.when(c("is_hole"), -c("area")).otherwise(c("area"))).alias("area"), F.sum("perimeter").alias("perimeter"), F.count_if(~c("is_hole")).alias("parts"), F.count_if("is_hole").alias("holes"))


def invalid(rings: DataFrame, cell: float) -> DataFrame:
    """region, ring, reason: rings that are not closed, of less than three segments, or whose segments cross each other."""
    c, w = F.col, W.partitionBy("region", "ring")
    at = rings.withColumns({"_nx": F.lead("x1").over(w.orderBy("seq")), "_ny": F.lead("y1").over(w.orderBy("seq")), "_fx": F.first("x1").over(w.orderBy("seq")), "_fy": F.first("y1").over(w.orderBy("seq")), "_n": F.count(F.lit(1)).over(w)})
    open_ = at.where((F.coalesce("_nx", "_fx") != c("x2")) | (F.coalesce("_ny", "_fy") != c("y2"))).select("region", "ring", F.lit("not closed").alias("reason"))
    few = at.where("_n < 3").select("region", "ring", F.lit("too few segments").alias("reason"))
    a = at.select(F.col("region").alias("r"), F.col("ring").alias("k"), F.col("seq").alias("s"), c("_n"), c("x1").alias("ax"), c("y1").alias("ay"), c("x2").alias("bx"), c("y2").alias("by"))
    met = near(a, rings, cell).where("region = r AND ring = k AND s < seq AND seq - s > 1 AND NOT (s = 0 AND seq = _n - 1)")
    side = lambda px, py, x1, y1, x2, y2: F.signum((c(x2) - c(x1)) * (c(py) - c(y1)) - (c(y2) - c(y1)) * (c(px) - c(x1)))
    apart = (side("x1", "y1", "ax", "ay", "bx", "by") * side("x2", "y2", "ax", "ay", "bx", "by") > 0) | (side("ax", "ay", "x1", "y1", "x2", "y2") * side("bx", "by", "x1", "y1", "x2", "y2") > 0)
    flat = (side("x1", "y1", "ax", "ay", "bx", "by") == 0) & (side("x2", "y2", "ax", "ay", "bx", "by") == 0)
    return open_.unionByName(few).unionByName(met.where(~apart & ~flat).select("region", "ring", F.lit("self-intersection").alias("reason"))).distinct()


def vertices(rings: DataFrame) -> DataFrame:
    """region, ring, is_hole, points: a ring's vertices in order."""
    p = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("x1").alias("x"), F.col("y1").alias("y")))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    return rings.groupBy("region", "ring", "is_hole").agg(p.alias("points"))


def atoms(rings: DataFrame) -> DataFrame:
    """region, part, ring, is_hole, points: one row for each ring, holes under the part that has their first vertex inside."""
    v = vertices(rings)
    outer, holes = v.where("NOT is_hole"), v.where("is_hole")
    shells = rings.where("NOT is_hole").select(F.concat_ws("#", F.col("region").cast("string"), F.col("ring").cast("string")).alias("shell"), F.col("region").alias("r"), F.col("ring").alias("part"), "x1", "y1", "x2", "y2")
    at = holes.select("region", "ring", F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))
    met = at.join(shells, F.col("region") == F.col("r")).groupBy("region", "ring", "part").agg((F.sum(F.coalesce(crosses_ray("x", "y"), F.lit(False)).cast("int")) % 2 == 1).alias("in"))
    owner = met.where("in").groupBy("region", "ring").agg(F.min("part").alias("part"))
    return outer.select("region", F.col("ring").alias("part"), "ring", "is_hole", "points").unionByName(holes.join(owner, ["region", "ring"]).select("region", "part", "ring", "is_hole", "points"))


def _canonical(points: list[tuple[float, float]], hole: bool) -> list[tuple[float, float]]:
    """A ring from its least vertex on, shells clockwise and holes counter-clockwise, closed."""
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))
    points = points[::-1] if (area > 0) != hole else points
    k = points.index(min(points))
    return [*points[k:], *points[:k], points[k]]


def to_wkb(parts: list[list[list[tuple[float, float]]]]) -> bytes:
    """Little-endian WKB of a MULTIPOLYGON: parts of closed rings, the shell first."""
    ring = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r)
    polygon = lambda p: struct.pack("<BII", 1, 3, len(p)) + b"".join(map(ring, p))
    return struct.pack("<BII", 1, 6, len(parts)) + b"".join(map(polygon, parts))


def from_wkb(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """The parts of a POLYGON or MULTIPOLYGON of either byte order."""
    at = 0

    def take(fmt: str, order: str):
        nonlocal at
        got = struct.unpack_from(order + fmt, data, at)
        at += struct.calcsize(order + fmt)
        return got

    def polygon() -> list:
        order = "<" if take("B", "<")[0] else ">"
        kind, n = take("II", order)
        if kind % 1000 == 6:
            return [x for _ in range(n) for x in polygon()]
        if kind % 1000 != 3:
            raise ValueError(f"no polygon: {kind}")
        return [[[take("dd", order) for _ in range(take("I", order)[0])] for _ in range(n)]]

    return polygon()


REGION_WKB = "region string, wkb binary, sha256 string"


def encoded(rings: DataFrame) -> DataFrame:
    """region, wkb, sha256: each region as canonical WKB: rings from their least vertex, fixed directions, sorted parts. One region fits in a task."""
    rows = atoms(rings).withColumn("region", F.col("region").cast("string"))

    def run(g):
        import pandas as pd

        parts: dict = {}
        for part, hole, points in zip(g["part"], g["is_hole"], g["points"], strict=True):
            parts.setdefault(part, ([], []))[bool(hole)].append(_canonical([(p["x"], p["y"]) for p in points], bool(hole)))
        wkb = to_wkb(sorted([sorted(shells)[0], *sorted(holes)] for shells, holes in parts.values()))
        return pd.DataFrame([(g["region"].iloc[0], wkb, hashlib.sha256(wkb).hexdigest())], columns=["region", "wkb", "sha256"])

    return rows.groupBy("region").applyInPandas(run, REGION_WKB)


def decoded(table: DataFrame) -> DataFrame:
    """Ring segments of a table of region, wkb."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for region, wkb in zip(b["region"], b["wkb"], strict=True):
                k = 0
                for part in from_wkb(bytes(wkb)):
                    for i, ring in enumerate(part):
                        out += [(region, k, i > 0, s, *p, *q) for s, (p, q) in enumerate(zip(ring, ring[1:], strict=False))]
                        k += 1
            yield pd.DataFrame(out, columns=["region", "ring", "is_hole", "seq", "x1", "y1", "x2", "y2"])

    return table.select(F.col("region").cast("string").alias("region"), "wkb").mapInPandas(run, "region string, ring int, is_hole boolean, seq int, x1 double, y1 double, x2 double, y2 double")


def out_of_domain(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row: how many coordinates are null, not finite, or no longitude and latitude."""
    ok = F.coalesce((F.abs(lon) <= 180) & (F.abs(lat) <= 90) & ~F.isnan(lon) & ~F.isnan(lat), F.lit(False))
    return points.agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("outside"))
