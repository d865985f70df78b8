"""Names, labels, timestamps, predicates as text, event documents, and what a process uses."""

from __future__ import annotations

import resource
from xml.sax.saxutils import escape

from pyspark.sql import Column
from pyspark.sql import functions as F


def city_key(name: Column) -> Column:
    """A name in NFC without case: names of one spelling are equal. Unicode normalisation is not a built-in, so this is Arrow code over short texts."""

    @F.udf("string", useArrow=True)
    def key(x):
        import unicodedata

        return None if x is None else unicodedata.normalize("NFC", x).casefold()

    return key(name)


def layer_label(name: Column) -> Column:
    """Letters and digits without accents, anything between them one underscore."""

    @F.udf("string", useArrow=True)
    def plain(x):
        import unicodedata

        return None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    return F.btrim(F.regexp_replace(F.lower(plain(name)), "[^a-z0-9]+", "_"), F.lit("_"))


def local_name(tag: Column) -> Column:
    """An XML name without its namespace, in braces or before a colon."""
    return F.substring_index(F.substring_index(tag, "}", -1), ":", -1)


def unquoted(scalar: Column) -> Column:
    """A plain or quoted scalar."""
    x = F.trim(scalar)
    return F.when(x.rlike("^(\".*\"|'.*')$") & (F.length(x) > 1), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)


def alias(name: Column, of: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[name], name) if of else name


def timestamp_of(document: Column) -> Column:
    """The value of the first timeStamp attribute; null if there is none."""
    return F.nullif(F.regexp_extract(document, 'timeStamp="([^"]*)"', 1), F.lit(""))


def without_timestamp(document: Column, by: str = "NORMALIZED") -> Column:
    """A document whose first timeStamp is replaced, so that two downloads can be compared."""
    at = F.instr(document, 'timeStamp="')
    rest = F.substring(document, at + 11, F.length(document))
    return F.when(at > 0, F.concat(F.substring(document, F.lit(1), at + 10), F.lit(by), F.substring(rest, F.instr(rest, '"'), F.length(rest)))).otherwise(document)


def or_filter(field: str, values: list[str]) -> str:
    """The FES filter for which isin() is the pushed predicate."""
    each = "".join(f"<fes:PropertyIsEqualTo><fes:ValueReference>{escape(field)}</fes:ValueReference><fes:Literal>{escape(v)}</fes:Literal></fes:PropertyIsEqualTo>" for v in values)
    return f'<fes:Filter xmlns:fes="http://www.opengis.net/fes/2.0">{f"<fes:Or>{each}</fes:Or>" if len(values) > 1 else each}</fes:Filter>'


def pair(a: Column, b: Column) -> Column:
    """Two 64-bit numbers as one value: Spark has no number of 128 bits, and joins on structs."""
    return F.struct(a.alias("from_node"), b.alias("to_node"))


def event_json(events: Column) -> Column:
    """A list of structs as compact JSON in canonical order; fields stand as the structs have them, so name them in alphabetical order."""
    return F.to_json(F.array_sort(events))


def order_text(order: Column) -> Column:
    return F.array_join(order, " -> ")


def value_at(document: dict, *path):
    """A value inside nested documents; None where the path ends early."""
    for k in path:
        try:
            document = document[k]
        except (KeyError, IndexError, TypeError):
            return None
    return document


def srs_name(epsg: int) -> str:
    return f"urn:ogc:def:crs:EPSG::{epsg}"


def epsg_of(name: Column) -> Column:
    """The code at the end of a reference system's name; null if it names none."""
    return F.regexp_extract(name, r"EPSG[:/]+(?:[0-9.]*[:/])?([0-9]+)$", 1).try_cast("int")


def is_multipart(wkb: Column) -> Column:
    """Does little- or big-endian WKB hold a MULTIPOLYGON?"""
    little = F.substring(F.hex(wkb), 1, 2) == "01"
    kind = F.when(little, F.substring(F.hex(wkb), 3, 2)).otherwise(F.substring(F.hex(wkb), 9, 2))
    return kind == "06"


def peak_rss_kb() -> int:
    """The driver's highest memory so far."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
