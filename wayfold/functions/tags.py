"""Tag parsing: speeds, dimensions, access, one-way rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MPH = 1.609344
TONNES_KG, FEET_M = 1000.0, 0.3048
ALLOWED = ("yes", "motorcar", "motor_vehicle", "vehicle", "permissive", "designated")
ACCESS = ("motorcar", "motor_vehicle", "vehicle", "access")


def numeric_speed(v: Column) -> Column:
    """The least of a list of speeds in km/h; null if none can be read."""

    def one(x: Column) -> Column:
        mph = F.trim(F.regexp_replace(x, "mph$", "")).try_cast("double") * MPH
        return F.when(F.endswith(x, F.lit("mph")), mph).otherwise(x.try_cast("double"))

    return F.array_min(F.filter(F.transform(F.split(F.lower(F.trim(v)), ";"), lambda x: one(F.trim(x))), lambda x: x.isNotNull()))


def dimension(v: Column, kind: str) -> Column:
    """Metres (kind `length`) or kilograms (kind `weight`); a decimal comma is a point."""
    x = F.replace(F.lower(F.trim(v)), F.lit(","), F.lit("."))
    number = lambda suffix: F.trim(F.regexp_replace(x, f"{suffix}$", "")).try_cast("double")
    if kind == "weight":
        return F.when(F.endswith(x, F.lit("kg")), number("kg")).when(F.endswith(x, F.lit("t")), number("t") * TONNES_KG).otherwise(x.try_cast("double") * TONNES_KG)
    return F.when(F.endswith(x, F.lit("ft")), number("ft") * FEET_M).when(F.endswith(x, F.lit("m")), number("m")).otherwise(x.try_cast("double"))


def first_tag(tags: Column, *names: str) -> Column:
    """The first non-empty tag."""
    return F.coalesce(*[F.nullif(tags[n], F.lit("")) for n in names])


def access_value(tags: Column, direction: str) -> Column:
    return first_tag(tags, *[x for n in ACCESS for x in (f"{n}:{direction}", n)])


def access_decision(value: Column) -> Column:
    """public_default, allowed:x or forbidden:x; what is not listed is forbidden."""
    return F.when(value.isNull(), "public_default").when(value.isin(*ALLOWED), F.concat(F.lit("allowed:"), value)).otherwise(F.concat(F.lit("forbidden:"), value))


def is_allowed(value: Column) -> Column:
    return value.isNull() | value.isin(*ALLOWED)


def directions(tags: Column, highway: Column) -> Column:
    """A struct of forward and back."""
    v = F.coalesce(first_tag(tags, "motorcar:oneway", "motor_vehicle:oneway", "vehicle:oneway", "oneway"), F.lit(""))
    implied = F.coalesce(highway == "motorway", F.lit(False)) | F.coalesce(tags["junction"].isin("roundabout", "circular"), F.lit(False))
    pair = lambda f, b: F.struct(F.lit(f).alias("forward"), F.lit(b).alias("back"))
    return F.when(v == "-1", pair(False, True)).when(v.isin("yes", "true", "1") | ((v != "no") & implied), pair(True, False)).otherwise(pair(True, True))


def capped_speed(*caps: Column) -> Column:
    """The least cap; nulls set none."""
    return F.least(*caps)


def excepted(v: Column, namespaces: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(F.transform(F.split(v, ";"), lambda x: F.trim(x)), F.array(*map(F.lit, namespaces))), F.lit(False))


def expected_duration(length_m: Column, speed_kmh: Column) -> Column:
    """Tenths of seconds, halves to even."""
    return F.bround(length_m / (speed_kmh / 3.6) * 10, 0).cast("bigint")
