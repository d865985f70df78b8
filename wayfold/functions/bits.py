"""Visit masks: bit i stands for place i."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), i.cast("int"))


def set_bits(mask: Column, n: int) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.call_function("shiftright", mask, b).bitwiseAND(1) == 1)


def names(mask: Column, of: list[str]) -> Column:
    every = F.array(*map(F.lit, of))
    return F.transform(set_bits(mask, len(of)), lambda b: F.get(every, b))


def nested(*masks: Column) -> Column:
    """Each mask is within the next one."""
    out = F.lit(True)
    for inner, outer in zip(masks, masks[1:], strict=False):
        out = out & (inner.bitwiseAND(F.bitwise_not(outer)) == 0)
    return out
