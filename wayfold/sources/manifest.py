"""Manifests, pinned inputs, lineage, checksums and reports: small documents on the driver."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..audit.contracts import pinned
from .tables import checksums, dumps


def load_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    text = re.sub(r"\s+#.*$", "", text)
    if text in ("true", "false"):
        return text == "true"
    if text in ("", "~", "null"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    if text.startswith("["):
        return [_scalar(x) for x in text.strip("[]").split(",") if x.strip()]
    return text


def parse_manifest(text: str) -> dict | list:
    """The part of YAML that manifests use: nested mappings and lists by indentation, plain and quoted scalars, folded texts."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#") and x.strip() != "---"]

    def block(at: int, indent: int):
        if at < len(lines) and lines[at][1].startswith("- ") or at < len(lines) and lines[at][1] == "-":
            out: list = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-"):
                rest = lines[at][1][1:].strip()
                if re.match(r"[\w:.\"'-]+:(\s|$)", rest) and not rest.startswith(("'", '"')):
                    lines[at] = (indent + 2, rest)
                    value, at = block(at, indent + 2)
                elif rest:
                    value, at = _scalar(rest), at + 1
                else:
                    value, at = block(at + 1, lines[at + 1][0])
                out.append(value)
            return out, at
        result: dict = {}
        while at < len(lines) and lines[at][0] == indent and not lines[at][1].startswith("- "):
            m = re.match(r"(\"[^\"]*\"|'[^']*'|.+?):(?:\s+(.*))?$", lines[at][1])
            if not m:
                raise ValueError(f"not a mapping: {lines[at][1]}")
            key, rest, at = str(_scalar(m[1])), (m[2] or "").strip(), at + 1
            if rest in (">", ">-", "|", "|-"):
                texts = []
                while at < len(lines) and lines[at][0] > indent:
                    texts.append(lines[at][1])
                    at += 1
                result[key] = (" " if rest[0] == ">" else "\n").join(texts)
            elif rest:
                result[key] = _scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- ")):
                result[key], at = block(at, lines[at][0])
            else:
                result[key] = None
        return result, at

    return block(0, lines[0][0])[0] if lines else {}


def load_manifest(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return parse_manifest(f.read())


def target_faults(targets: list[dict], n: int, lon: tuple[float, float] = (-180, 180), lat: tuple[float, float] = (-90, 90)) -> list[str]:
    """What is wrong with a manifest's targets (bit, city, code, unit, lon, lat): their number, bits 0 to n - 1, unique codes and names, code prefixes, coordinates."""
    out = []
    if len(targets) != n:
        out.append(f"{len(targets)} targets, not {n}")
    if sorted(t["bit"] for t in targets) != list(range(len(targets))):
        out.append("bits are not 0 to n - 1")
    for k in ("code", "city"):
        if len({t[k] for t in targets}) != len(targets):
            out.append(f"{k} is not unique")
    out += [f"{t['city']}: code {t['code']} is not of unit {t['unit']}" for t in targets if t.get("unit") and not str(t["code"]).startswith(str(t["unit"]))]
    out += [f"{t['city']}: coordinates" for t in targets if not (lon[0] <= t["lon"] <= lon[1] and lat[0] <= t["lat"] <= lat[1])]
    return out


def pinned_file(path: str, sha256: str, label: str, size: int | None = None) -> bytes:
    with open(path, "rb") as f:
        return pinned(f.read(), sha256, label, size)


def materialised(packed: str, path: str, packed_sha256: str, sha256: str) -> str:
    """Unpacks a pinned zstd file: digests are checked before and after, and the file appears at once and whole."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompressobj().decompress(pinned_file(packed, packed_sha256, packed))
    pinned(raw, sha256, path)
    with open(f"{path}.partial", "wb") as f:
        f.write(raw)
    os.replace(f"{path}.partial", path)
    return path


def sums_text(spark: SparkSession, root: str) -> str:
    """The lines of a checksum file for every file below a folder, in the order of their paths."""
    top = os.path.abspath(root).rstrip("/") + "/"
    rows = checksums(spark, root).select(F.substring_index("path", top, -1).alias("path"), "sha256").orderBy("path")
    return "".join(f"{r['sha256']}  {r['path']}\n" for r in rows.toLocalIterator())


def lineage(products: DataFrame, inputs: dict[str, str], generator_sha256: str) -> DataFrame:
    """products (name, sha256) beside the digests of what they were made from, and by."""
    each = F.map_from_arrays(F.array(*map(F.lit, sorted(inputs))), F.array(*[F.lit(inputs[k]) for k in sorted(inputs)]))
    return products.select("name", "sha256", each.alias("inputs"), F.lit(generator_sha256).alias("generator_sha256"))


def contract(classes: tuple[str, ...], models: dict[str, float], tables: dict[str, str]) -> str:
    """The frozen contract of the products: categories, models with their depths, columns."""
    return dumps({"classes": list(classes), "models": models, "tables": tables})


def report(title: str, sections: dict[str, dict | list]) -> str:
    """A report: a heading for each section, with a table of its metrics or a list of its lines."""
    out = [f"# {title}", ""]
    for name, body in sections.items():
        out += [f"## {name}", ""]
        if isinstance(body, dict):
            out += ["| Metric | Value |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in body.items()], ""]
        else:
            out += [*[f"* {x}" for x in body], ""]
    return "\n".join(out)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table with a header; a row that does not fit the schema fails the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def write_inventory(rows: DataFrame, folder: str, order: str) -> None:
    """A small inventory as CSV and as a document of sorted keys."""
    rows = rows.orderBy(order)
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/inventory-csv")
    rows.coalesce(1).select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("overwrite").text(f"{folder}/inventory-json")


def read_maybe_packed(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """A table of tabs at path, or at path.zst where that is what there is."""
    from .tables import read_tsv

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return read_tsv(spark, path if there else f"{path}.zst", schema, header)
