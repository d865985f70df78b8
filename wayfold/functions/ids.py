"""Keys and content-addressed ids."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_key(a: Column, b: Column) -> Column:
    """Two numbers as text that sorts as they do."""
    return F.format_string("%020d/%020d", a, b)


def stable_id(*parts: Column) -> Column:
    return F.concat_ws("/", *[p.cast("string") for p in parts])


def parse_stable_id(text: Column, n: int = 5) -> Column:
    """The n numbers of a stable id; null if it has another form."""
    numbers = F.transform(F.split(text, "/"), lambda x: x.try_cast("bigint"))
    return F.when((F.size(numbers) == n) & ~F.exists(numbers, lambda x: x.isNull()), numbers)


def child_id(parent: Column, ordinal: Column) -> Column:
    return F.concat(parent, F.lit("@"), ordinal.cast("string"))


def content_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def path_hash(path: Column) -> Column:
    return F.sha2(F.array_join(path, "\n"), 256)


def lines_hash(lines: Column) -> Column:
    """Each line ends with a line feed."""
    return F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256)
