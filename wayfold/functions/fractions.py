"""Fractions of an edge, fixed units and intervals."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_fraction(x: Column) -> Column:
    """Clamped to [0, 1], twelve decimal places, halves away from zero."""
    return F.round(F.least(F.lit(1).cast("decimal(30,18)"), F.greatest(F.lit(0).cast("decimal(30,18)"), x.cast("decimal(30,18)"))), 12).cast("decimal(13,12)")


def unit_of(x: Column) -> Column:
    """A double in [0, 1] at twelve decimal places, as SQL casts it: its product with 10^18 is a double, too, and that integer is rounded.

    Spark's own cast goes by the shortest text of a double, which may end in a half that the product does not have."""
    whole = F.rint(x * F.lit(1e18)).cast("bigint") + F.lit(500000)
    return (F.call_function("div", whole, F.lit(1000000).cast("bigint")).cast("decimal(13,0)") * F.lit("0.000000000001").cast("decimal(12,12)")).cast("decimal(13,12)")


def to_units(x: Column, scale: int) -> Column:
    """x times scale as an integer, halves to even."""
    return F.bround(x.cast("decimal(20,6)") * F.lit(scale), 0).cast("bigint")


def containing_interval(starts: Column, x: Column) -> Column:
    """The index of the half-open interval between sorted breaks that holds x; the last one holds the last break.

    What lies outside of the breaks, and breaks that hold no interval, fail."""
    below = F.size(F.filter(starts, lambda s: s <= x)) - 1
    outside = x.isNotNull() & ((x < F.get(starts, F.lit(0))) | (x > F.element_at(starts, -1)) | (F.size(starts) < 2))
    return F.when(outside, F.raise_error(F.concat(F.lit("outside of all intervals: "), x.cast("string")))).otherwise(F.least(below, F.size(starts) - 2))


def shares(total: Column, widths: Column) -> Column:
    """Largest-remainder shares of an integer total for integer widths in an array; ties go to the lower index."""
    whole = F.aggregate(widths, F.lit(0).cast("decimal(38,0)"), lambda a, w: (a + w).cast("decimal(38,0)"))
    floors = F.transform(widths, lambda w, i: F.struct((-(((total.cast("decimal(38,0)") * w) % whole))).alias("rest"), i.alias("i"), F.call_function("div", total.cast("decimal(38,0)") * w, whole).cast("bigint").alias("share")))
    left = total - F.aggregate(floors, F.lit(0).cast("bigint"), lambda a, f: a + f["share"])
    ranked = F.transform(F.array_sort(floors), lambda f, k: F.struct(f["i"].alias("i"), (f["share"] + F.when(k < left, 1).otherwise(0)).alias("share")))
    return F.transform(F.array_sort(ranked), lambda f: f["share"])
