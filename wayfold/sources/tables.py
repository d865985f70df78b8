"""Readers and writers of the road-graph tables: TSV, XML features, GeoJSON, logs, checksums, restrictions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "edge_id string, from_node bigint, to_node bigint, from_lon double, from_lat double, to_lon double, to_lat double, length_m decimal(18,3), duration_s decimal(18,1), highway string, speed_kmh double, access string, ferry string"
TURNS = "in_edge string, out_edge string, turn_s decimal(18,1), status string"
SEGMENTS = "ebn bigint, ordinal int, from_node bigint, to_node bigint, from_lon double, from_lat double, to_lon double, to_lat double, length_m decimal(18,3), duration_ds bigint"


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """A table of tabs; a row that does not fit the schema fails the read. Compressed files are read as they are."""
    return spark.read.schema(schema).option("sep", "\t").option("header", header).option("mode", "FAILFAST").csv(path)


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.option("sep", "\t").option("header", header).option("compression", "gzip").csv(path)


def write_table(df: DataFrame, path: str, key: str, parts: int, partition_by: str | None = None) -> None:
    """Parquet clustered by a key: what takes the place of an index."""
    out = df.repartition(parts, key).sortWithinPartitions(key).write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)


def read_features(spark: SparkSession, path: str, tag: str, schema: str | None = None) -> DataFrame:
    """One row for each XML element of a name."""
    reader = spark.read.format("xml").option("rowTag", tag)
    return (reader.schema(schema) if schema else reader).load(path)


def positions(text: Column) -> Column:
    """A list of coordinates as pairs."""
    n = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    every = F.filter(F.sequence(F.lit(0), F.greatest(F.size(n), F.lit(2)) - 2), lambda i: (i % 2 == 0) & (i + 1 < F.size(n)))
    return F.transform(every, lambda i: F.struct(F.get(n, i).alias("x"), F.get(n, i + 1).alias("y")))


def ring_segments(rings: DataFrame, key: list[str], points: str) -> DataFrame:
    """Segments x1, y1, x2, y2 of closed rings given as arrays of points."""
    p = F.col(points)
    pair = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.struct(i.alias("seq"), F.get(p, i)["x"].alias("x1"), F.get(p, i)["y"].alias("y1"), F.get(p, i + 1)["x"].alias("x2"), F.get(p, i + 1)["y"].alias("y2")))
    return rings.where(F.size(p) > 1).select(*key, F.explode(pair).alias("s")).select(*key, "s.*")


def geojson_coordinates(text: Column) -> Column:
    """The pairs of a Polygon or MultiPolygon, flat."""
    multi = F.from_json(F.get_json_object(text, "$.coordinates"), "array<array<array<array<double>>>>")
    single = F.from_json(F.get_json_object(text, "$.coordinates"), "array<array<array<double>>>")
    return F.when(F.get_json_object(text, "$.type") == "MultiPolygon", F.flatten(F.flatten(multi))).otherwise(F.flatten(single))


def required_counts(spark: SparkSession, path: str, patterns: dict[str, str], total: str | None = None, parts: tuple[str, ...] = ()) -> dict[str, int]:
    """Each pattern's number; fails unless every pattern stands in exactly one line, and the parts add up to the total."""
    got = {r["name"]: r for r in log_counts(spark, path, patterns).collect()}
    if wrong := sorted(k for k, r in got.items() if r["n"] != 1):
        raise ValueError(f"not in exactly one line: {', '.join(wrong)}")
    values = {k: r["value"] for k, r in got.items()}
    if total and values[total] != sum(values[p] for p in parts):
        raise ValueError(f"{total} is not the sum of {', '.join(parts)}")
    return values


def log_counts(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """name, n, value: for each pattern how many lines have it, and the number it holds."""
    lines = spark.read.text(path)
    found = [F.struct(F.lit(k).alias("name"), F.regexp_extract("value", p, 1).alias("v")) for k, p in patterns.items()]
    each = lines.select(F.explode(F.array(*found)).alias("x")).where("x.v <> ''")
    names = spark.createDataFrame([(k,) for k in patterns], "name string")
    got = each.groupBy("x.name").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("x.v").try_cast("bigint")).alias("value"))
    return F.broadcast(names).join(got, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), "value")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 and md5 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def verified(spark: SparkSession, path: str, sums: DataFrame) -> DataFrame:
    """The files whose digest differs from the listed one, or that only one side has."""
    got = checksums(spark, path).select(F.substring_index("path", "/", -1).alias("name"), F.col("sha256").alias("got"))
    return got.join(sums, "name", "full_outer").where(~F.col("got").eqNullSafe(F.col("sha256")))


def dumps(document: dict) -> str:
    """A document with sorted keys and a final line feed."""
    return json.dumps(document, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def segments_of(ways: DataFrame) -> DataFrame:
    """way_id, ordinal, from_node, to_node of ways (way_id, nodes)."""
    n = F.col("nodes")
    pair = F.transform(F.sequence(F.lit(0), F.size(n) - 2), lambda i: F.struct(i.alias("ordinal"), F.get(n, i).alias("from_node"), F.get(n, i + 1).alias("to_node")))
    return ways.where(F.size("nodes") > 1).select("way_id", F.explode(pair).alias("s")).select("way_id", "s.*")


def directed(records: DataFrame) -> DataFrame:
    """Directed turns of records that hold both directions (source, target, forward, backward, seconds)."""
    both = F.array(F.when(F.col("forward"), F.struct(F.col("source").alias("in_edge"), F.col("target").alias("out_edge"))), F.when(F.col("backward"), F.struct(F.col("target").alias("in_edge"), F.col("source").alias("out_edge"))))
    return records.select(F.explode(F.array_compact(both)).alias("t"), "seconds").select("t.*", "seconds")


def restriction_shape(members: Column, kind: Column) -> Column:
    """A struct of the from, to and via ids of a relation, whether it prohibits or prescribes, and whether its members fit."""
    of = lambda role, type_: F.array_distinct(F.transform(F.filter(members, lambda m: (m["role"] == role) & (m["type"] == type_)), lambda m: m["ref"]))
    rule = F.when(F.startswith(kind, F.lit("no_")) & ~F.endswith(kind, F.lit("_on_red")), "no").when(F.startswith(kind, F.lit("only_")), "only")
    fits = (F.size(of("from", "w")) > 0) & (F.size(of("to", "w")) > 0) & (F.size(of("via", "n")) + F.size(of("via", "w")) > 0) & rule.isNotNull()
    return F.struct(of("from", "w").alias("from_ways"), of("to", "w").alias("to_ways"), of("via", "n").alias("via_nodes"), of("via", "w").alias("via_ways"), rule.alias("rule"), fits.alias("fits"))


def via_path(a: Column, b: Column, via: Column) -> Column:
    """From, via and to nodes of two ways that meet at a node, by the pairs at their ends: first ends are tried first, and
    ways of less than two nodes have none. Null if they do not meet."""
    end = lambda w, i: F.try_element_at(w, F.lit(i))
    stop = F.when(end(b, 1) == via, end(b, 2)).when(end(b, -1) == via, end(b, -2))
    start = F.when(end(a, 1) == via, end(a, 2)).when(end(a, -1) == via, end(a, -2))
    return F.when((F.size(a) > 1) & (F.size(b) > 1) & start.isNotNull() & stop.isNotNull(), F.struct(start.alias("from_node"), via.alias("via_node"), stop.alias("to_node")))
