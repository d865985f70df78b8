"""Feature collections and their descriptions: XML geometry, capabilities, schemas, GeoPackages, GeoJSON."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import epsg_of, layer_label, local_name
from ..operators.planar import from_wkb
from .tables import positions, read_features


def read_geometries(spark: SparkSession, path: str, tag: str, targets: dict[str, str], epsg: int, key: str = "key", name: str = "name") -> DataFrame:
    """key, name, id, ring, is_hole, points of the targets' features; fails unless each target has one feature with its name, id and reference system.

    The features hold `key`, `name`, `id`, `srs` and lists of positions `exterior` and `interior`."""
    schema = f"{key} string, {name} string, id string, srs string, exterior array<string>, interior array<string>"
    rows = read_features(spark, path, tag, schema).where(F.col(key).isin(*targets))
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first(name).alias("name"), F.count("id").alias("ids"), F.min(epsg_of(F.col("srs"))).alias("lo"), F.max(epsg_of(F.col("srs"))).alias("hi")).collect()
    got = {r[key]: r for r in n}
    for k, want in targets.items():
        r = got.get(k)
        if r is None or r["n"] != 1 or r["name"] != want or r["ids"] != 1 or (r["lo"], r["hi"]) != (epsg, epsg):
            raise ValueError(f"feature {k}: expected one named {want} in EPSG:{epsg}, found {r}")
    ring = lambda c, hole: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(positions(x).alias("points"), F.lit(hole).alias("is_hole")))
    each = rows.select(F.col(key).alias("key"), F.col(name).alias("name"), "id", F.posexplode(F.concat(ring(F.col("exterior"), False), ring(F.col("interior"), True))).alias("ring", "r"))
    return each.select("key", "name", "id", "ring", "r.is_hole", "r.points")


def layers(spark: SparkSession, path: str, tag: str = "FeatureType") -> DataFrame:
    """name, title, label of the feature types that a service lists."""
    rows = read_features(spark, path, tag, "Name string, Title string")
    return rows.select(F.col("Name").alias("name"), F.col("Title").alias("title"), layer_label(local_name(F.col("Name"))).alias("label"))


def only_layer(spark: SparkSession, path: str, label: str, tag: str = "FeatureType") -> str:
    """The name of the one feature type with a label."""
    got = [r["name"] for r in layers(spark, path, tag).where(F.col("label") == label).limit(2).collect()]
    if len(got) != 1:
        raise ValueError(f"feature types with label {label}: {len(got)}")
    return got[0]


def fields(spark: SparkSession, path: str, required: tuple[str, ...] = (), tag: str = "element") -> dict[str, str]:
    """The fields of an XML schema with their types; fails if a required one is missing."""
    rows = read_features(spark, path, tag, "_name string, _type string").where("_name IS NOT NULL").select("_name", local_name(F.col("_type")).alias("type"))
    found = {r["_name"]: r["type"] for r in rows.collect()}
    if missing := sorted(set(required) - found.keys()):
        raise ValueError(f"missing fields: {', '.join(missing)}")
    return found


def _gpkg_wkb(blob: bytes) -> bytes:
    """The WKB behind a GeoPackage header, whose envelope has a length by its flags."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    return blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7] :]


def read_geopackage(spark: SparkSession, path: str, layer: str, key: str, geometry: str = "geom", batch: int = 500) -> DataFrame:
    """region, wkb of a layer. The file is one SQLite database, so one task reads it, a batch of rows at a time; `path` is a file that the executors see."""

    def run(batches) -> Iterator:
        import pandas as pd

        for b in batches:
            for p in b["path"]:
                with sqlite3.connect(f"file:{p}?mode=ro", uri=True) as db:
                    rows = db.execute(f'SELECT "{key}", "{geometry}" FROM "{layer}" ORDER BY 1')
                    while got := rows.fetchmany(batch):
                        yield pd.DataFrame([(str(k), _gpkg_wkb(g)) for k, g in got], columns=["region", "wkb"])

    return spark.createDataFrame([(path,)], "path string").mapInPandas(run, "region string, wkb binary")


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, order: str, parts: int = 8) -> DataFrame:
    """A table of a SQLite file, by ranges of its rowid, one task for each: point and range lookups are filters and joins of it."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches) -> Iterator:
        import pandas as pd

        for b in batches:
            for lo, hi in zip(b["lo"], b["hi"], strict=True):
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    rows = db.execute(f"SELECT {', '.join(names)} FROM {table} WHERE rowid >= ? AND rowid < ?", (int(lo), int(hi)))
                    while got := rows.fetchmany(10_000):
                        yield pd.DataFrame(got, columns=names)

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        lo, hi = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) + 1 FROM {table}").fetchone()
    step = max(1, -(-(hi - lo) // parts))
    ranges = [(x, min(x + step, hi)) for x in range(lo, hi, step)] or [(0, 0)]
    return spark.createDataFrame(ranges, "lo bigint, hi bigint").repartition(len(ranges)).mapInPandas(run, schema).orderBy(order)


def geojson(key: Column, points: Column, properties: Column) -> Column:
    """A feature of one ring as GeoJSON."""
    ring = F.transform(points, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), key.cast("string").alias("id"), properties.alias("properties"), geometry.alias("geometry")))


def write_geojson(features: DataFrame, path: str) -> None:
    """A collection of a few features (a column `feature`) as one document in the driver's file system."""
    rows = [json.loads(r["feature"]) for r in features.orderBy("feature").toLocalIterator()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"type": "FeatureCollection", "features": rows}, f, ensure_ascii=False, sort_keys=True)
        f.write("\n")


def wkb_hex(df: DataFrame) -> DataFrame:
    """The geometry table with hexadecimal WKB."""
    return df.select(*[F.hex(c).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes])


def part_count(wkb: bytes) -> int:
    return len(from_wkb(wkb))
