"""A vehicle profile as Column rules: what a node, a way and a turn cost, and whether they may be used."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo, tags

#: km/h by class of road.
CLASS_KMH = {
    "motorway": 90.0, "motorway_link": 45.0, "trunk": 85.0, "trunk_link": 40.0, "primary": 65.0, "primary_link": 30.0, "secondary": 55.0, "secondary_link": 25.0,
    "tertiary": 40.0, "tertiary_link": 20.0, "unclassified": 25.0, "residential": 25.0, "living_street": 10.0, "service": 15.0, "winter_road": 20.0, "ice_road": 15.0,
}
#: Caps in km/h by tag and value; a value without a cap is left out.
CAP_KMH = {
    "surface": {
        "cement": 80.0, "compacted": 80.0, "fine_gravel": 80.0, "paving_stones": 60.0, "metal": 60.0, "bricks": 60.0, "grass": 40.0, "wood": 40.0, "sett": 40.0, "grass_paver": 40.0, "gravel": 40.0, "unpaved": 40.0,
        "ground": 40.0, "dirt": 40.0, "pebblestone": 40.0, "tartan": 40.0, "cobblestone": 30.0, "clay": 30.0, "earth": 20.0, "stone": 20.0, "rocky": 20.0, "sand": 20.0, "mud": 10.0, "ice": 20.0, "snow": 30.0,
    },
    "tracktype": {"grade1": 60.0, "grade2": 40.0, "grade3": 30.0, "grade4": 25.0, "grade5": 20.0},
    "smoothness": {"intermediate": 80.0, "bad": 40.0, "very_bad": 20.0, "horrible": 10.0, "very_horrible": 5.0, "impassable": 0.0},
    "bridge": {"movable": 5.0},
}
#: km/h of symbolic limits; the share of a limit that is driven; vehicle sizes; seconds at barriers.
SYMBOL_KMH = {"pl:urban": 50.0, "pl:rural": 100.0, "pl:expressway": 120.0, "pl:motorway": 140.0, "none": 140.0}
OF_LIMIT = 0.8
VEHICLE = {"maxheight": ("length", 2.0), "maxwidth": ("length", 1.9), "maxlength": ("length", 4.8), "maxweight": ("weight", 2000.0)}
BARRIER_S = {"gate": 60.0, "lift_gate": 60.0}
OPEN_BARRIERS = ("cattle_grid", "border_control", "toll_booth", "sally_port", "no", "entrance", "height_restrictor", "arch")
FERRIES = ("ferry", "shuttle_train")
BUILDING = ("", "no", "widening", "minor")


def lookup(table: dict[str, float], key: Column) -> Column:
    """A literal table's value, null for a key that it lacks."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


@dataclass(frozen=True)
class Profile:
    """The rules that a record meets: node(), way() and turn() each give a Column. Other profiles replace its tables."""

    classes: dict = field(default_factory=lambda: CLASS_KMH)
    caps: dict = field(default_factory=lambda: CAP_KMH)
    symbols: dict = field(default_factory=lambda: SYMBOL_KMH)
    of_limit: float = OF_LIMIT
    vehicle: dict = field(default_factory=lambda: VEHICLE)
    barriers: dict = field(default_factory=lambda: BARRIER_S)

    def limit(self, t: Column, direction: str) -> Column:
        """The posted limit in km/h: by direction, in general, or a symbol's."""
        return F.coalesce(tags.numeric_speed(tags.first_tag(t, f"maxspeed:{direction}", "maxspeed")), lookup(self.symbols, F.lower(t["source:maxspeed"])))

    def speed(self, t: Column, direction: str) -> Column:
        """The least of the class's speed, the driven share of the limit and the caps; null for a class that has none."""
        of_class = lookup(self.classes, t["highway"])
        caps = [lookup(table, t[tag]) for tag, table in self.caps.items()]
        return F.when(of_class.isNotNull(), tags.capped_speed(of_class, self.limit(t, direction) * self.of_limit, *caps))

    def fits(self, t: Column, direction: str) -> Column:
        """No dimension of the vehicle is above the way's."""
        out = F.lit(True)
        for tag, (kind, most) in self.vehicle.items():
            out = out & F.coalesce(tags.dimension(tags.first_tag(t, f"{tag}:{direction}", tag), kind) >= most, F.lit(True))
        return out

    def ferry(self, t: Column) -> Column:
        return F.coalesce(t["route"].isin(*FERRIES), F.lit(False))

    def considered(self, t: Column) -> Column:
        """A way of a known class that is no ferry, no area, passable and not being built."""
        no = lambda tag, *values: ~F.coalesce(t[tag].isin(*values), F.lit(False))
        built = F.coalesce(t["construction"].isin(*BUILDING), F.lit(True))
        return ~self.ferry(t) & lookup(self.classes, t["highway"]).isNotNull() & no("area", "yes") & no("impassable", "yes") & no("status", "impassable") & built

    def way(self, t: Column, direction: str) -> Column:
        """A struct for one direction: enabled by one-way rules, access decision, legal, speed."""
        flag = tags.directions(t, t["highway"])["forward" if direction == "forward" else "back"]
        value, speed = tags.access_value(t, direction), self.speed(t, direction)
        legal = flag & tags.is_allowed(value) & self.fits(t, direction) & (speed > 0)
        return F.struct(flag.alias("enabled"), tags.access_decision(value).alias("access"), self.fits(t, direction).alias("fits"), speed.alias("speed_kmh"), F.coalesce(legal, F.lit(False)).alias("legal"))

    def reasons(self, t: Column, direction: str, in_graph: Column) -> Column:
        """Why a direction may not be driven; empty if it may."""
        x, known = self.way(t, direction), lookup(self.classes, t["highway"]).isNotNull()
        rules = (
            (~x["enabled"], F.lit("forbidden_by_oneway_tag")), (~tags.is_allowed(tags.access_value(t, direction)), x["access"]), (~x["fits"], F.lit("forbidden_by_vehicle_dimensions")),
            (~known, F.lit("forbidden_highway_class")), (self.ferry(t), F.lit("forbidden_ferry_or_shuttle_train")), (known & ~(x["speed_kmh"] > 0), F.lit("nonpositive_effective_speed")),
            (~in_graph, F.lit("directed_edge_absent_from_osrm_graph")),
        )
        return F.array_compact(F.array(*[F.when(c, r) for c, r in rules]))

    def blocked_by_limit(self, v: Column) -> Column:
        """A limit whose leading number is not above 0 closes the direction."""
        number = F.regexp_extract(v, r"^\s*([+-]?[0-9.]+)", 1).try_cast("double")
        return F.coalesce(number <= 0, F.lit(False))

    def node(self, t: Column) -> Column:
        """A struct: is the node a barrier, and how many seconds does it cost?"""
        access, kind = tags.first_tag(t, *tags.ACCESS), tags.first_tag(t, "barrier")
        seconds = lookup(self.barriers, kind)
        low = F.coalesce((kind == "height_restrictor") & (tags.dimension(t["maxheight"], "length") < self.vehicle["maxheight"][1]), F.lit(False))
        has = lambda tag, *values: F.coalesce(t[tag].isin(*values), F.lit(False))
        excused = kind.isin(*OPEN_BARRIERS) | has("bollard", "rising") | has("kerb", "lowered", "flush") | ((kind == "kerb") & has("highway", "crossing")) | ((kind == "fence") & has("sensory", "audible", "audio"))
        shut = F.when(access.isNotNull(), ~tags.is_allowed(access)).when(kind.isNull(), False).otherwise(low | ~(excused | seconds.isNotNull()))
        return F.struct(shut.alias("barrier"), F.when(access.isNull(), F.coalesce(seconds, F.lit(0.0))).otherwise(0.0).alias("seconds"))

    def turn(self, angle: Column, roads: Column, u_turn: Column, mode_changes: Column, obstacles: Column) -> Column:
        """Seconds of a turn: its obstacles' seconds (an array), and the angle's penalty where there is a choice of roads."""
        waits = F.aggregate(obstacles, F.lit(0.0), lambda a, x: a + x)
        return waits + F.when((roads > 2) | mode_changes | u_turn, geo.turn_penalty(angle, u_turn)).otherwise(0.0)
