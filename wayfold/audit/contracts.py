"""Contracts of tables as one pass of counters each, rules over the counters, and the decisions they lead to."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids, tags
from ..operators.relational import digest, version_diff


def not_finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def edges(df: DataFrame) -> DataFrame:
    """One row of counters for base edges: ids, their parts, costs, speed, access, ferry; with rows, distinct ids and a digest."""
    p = ids.parse_stable_id(F.col("edge_id"))
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    legal = F.coalesce((F.col("access") == "public_default") | (F.startswith("access", F.lit("allowed:")) & F.substring("access", 9, 99).isin(*tags.ALLOWED)), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("edge_id").alias("n_ids"), bad(p.isNull()).alias("bad_id"), bad((p[3] != F.col("from_node")) | (p[4] != F.col("to_node"))).alias("bad_ends"),
        F.count_if(not_finite("length_m") | not_finite("duration_s") | not_finite("speed_kmh")).alias("not_finite"), F.count_if((F.col("length_m") < 0) | (F.col("duration_s") < 0)).alias("negative"),
        bad(F.col("speed_kmh") <= 0).alias("no_speed"), F.count_if(~legal).alias("illegal_access"), F.count_if(~F.col("ferry").eqNullSafe("not_ferry")).alias("ferries"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("digest"),
    )


def turns(df: DataFrame) -> DataFrame:
    """One row of counters for turns: ids, whether the edges meet, costs, status."""
    a, b = ids.parse_stable_id(F.col("in_edge")), ids.parse_stable_id(F.col("out_edge"))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("in_edge", "out_edge").alias("n_pairs"), F.count_if(a.isNull() | b.isNull()).alias("bad_id"), F.count_if(F.coalesce(a[4] != b[3], F.lit(False))).alias("broken"),
        F.count_if(not_finite("turn_s")).alias("not_finite"), F.count_if(F.col("turn_s") < 0).alias("negative"), F.count_if(~F.col("status").eqNullSafe("allowed")).alias("not_allowed"),
    )


def loaded(edge_rows: DataFrame, turn_rows: DataFrame, bit_count: int, expected: dict[str, int]) -> dict:
    """The audit of a loaded graph: counts against the expected ones, dangling turns on both sides, costs, places that no edge visits."""
    e = edge_rows.agg(F.count(F.lit(1)).alias("edges"), F.count_if(not_finite("cost") | not_finite("length")).alias("not_finite"), F.count_if((F.col("cost") < 0) | (F.col("length") < 0)).alias("negative"), F.bit_or("mask").alias("mask")).first()
    known = edge_rows.select("edge_id").distinct()
    side = lambda c: turn_rows.join(known, F.col(c) == F.col("edge_id"), "left_anti").agg(F.count(F.lit(1)).alias("n")).first()["n"]
    t = turn_rows.agg(F.count(F.lit(1)).alias("turns"), F.count_if(not_finite("turn_cost") | (F.col("turn_cost") < 0)).alias("bad")).first()
    got = {"edges": e["edges"], "turns": t["turns"], "edge_not_finite": e["not_finite"], "edge_negative": e["negative"], "turn_bad": t["bad"], "dangling_in": side("in_edge"), "dangling_out": side("out_edge"), "missing_places": bit_count - ((e["mask"] or 0) & ((1 << bit_count) - 1)).bit_count()}
    return judged(got, [Rule(k, lambda m, k=k, v=v: m[k] == v) for k, v in expected.items()] + [Rule(k, lambda m, k=k: m[k] == 0) for k in got if k not in ("edges", "turns")])


@dataclass(frozen=True)
class Rule:
    name: str
    holds: Callable[[dict], bool]


def judged(metrics: dict, rules: list[Rule]) -> dict:
    """Metrics, each rule's verdict and the whole's. A rule over a metric that is missing does not hold."""

    def holds(r: Rule) -> bool:
        try:
            return bool(r.holds(metrics))
        except (KeyError, TypeError):
            return False

    checks = {r.name: holds(r) for r in rules}
    return {"metrics": metrics, "checks": checks, "status": "PASS" if all(checks.values()) else "FAIL"}


def metrics(row: DataFrame) -> dict:
    """A one-row table of counters as a document."""
    return {k: int(v) if isinstance(v, int) or hasattr(v, "as_integer_ratio") and v == int(v) else v for k, v in row.first().asDict().items()}


EDGE_RULES = [Rule("unique", lambda m: m["n"] == m["n_ids"])] + [Rule(k, lambda m, k=k: m[k] == 0) for k in ("bad_id", "bad_ends", "not_finite", "negative", "no_speed", "illegal_access", "ferries")]
TURN_RULES = [Rule("unique", lambda m: m["n"] == m["n_pairs"])] + [Rule(k, lambda m, k=k: m[k] == 0) for k in ("bad_id", "broken", "not_finite", "negative", "not_allowed")]


def certified(edge_rows: DataFrame, turn_rows: DataFrame, more: dict | None = None, more_rules: list[Rule] = ()) -> dict:
    """A stage's certificate: both contracts, and what else is measured, under one status."""
    parts = {"edges": judged(metrics(edges(edge_rows)), EDGE_RULES), "turns": judged(metrics(turns(turn_rows)), TURN_RULES), "stage": judged(more or {}, list(more_rules))}
    return parts | {"status": "PASS" if all(p["status"] == "PASS" for p in parts.values()) else "FAIL"}


def outcomes(df: DataFrame, expected_rows: int, categories: tuple[str, ...], terminals: int | None = None, fixed: tuple[str, ...] = ()) -> dict:
    """The validator of a search's results: rows, known categories, costs exactly where feasible, unique routes, evidence for each fixed route."""
    feasible = F.col("category") == "FEASIBLE"
    c = [
        F.count(F.lit(1)).alias("rows"), F.count_distinct("route").alias("routes"), F.count_if(~F.col("category").isin(*categories)).alias("unknown"), F.count_if(feasible & F.col("cost").isNull()).alias("no_cost"),
        F.count_if(~feasible & F.col("cost").isNotNull()).alias("odd_cost"), F.count_if(~feasible & F.col("reason").isNull()).alias("no_reason"), F.count_if(F.col("route").isin(*fixed)).alias("fixed"),
    ]
    m = metrics(df.agg(*c, *([F.count_distinct(F.when(feasible, F.element_at("order", -1))).alias("terminals")] if terminals is not None else [])))
    rules = [Rule("rows", lambda m: m["rows"] == expected_rows), Rule("unique", lambda m: m["rows"] == m["routes"]), Rule("fixed", lambda m: m["fixed"] == len(fixed))]
    rules += [Rule(k, lambda m, k=k: m[k] == 0) for k in ("unknown", "no_cost", "odd_cost", "no_reason")]
    return judged(m, rules + ([Rule("terminals", lambda m: m["terminals"] <= terminals)] if terminals is not None else []))


def same_build(a: DataFrame, b: DataFrame) -> bool:
    """Do two builds of a table have the same rows, in whatever order?"""
    return sorted(a.columns) == sorted(b.columns) and digest(a).first() == digest(b.select(*a.columns)).first()


def ordered_digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row: a SHA-256 of the sorted lines of a small table, each line ended by a line feed."""
    line = F.concat(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]), F.lit("\n"))
    return df.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("sha256"))


def documents_differ(a: dict, b: dict, path: str = "") -> list[str]:
    """The keys at which two documents differ."""
    out = []
    for k in sorted(a.keys() | b.keys()):
        at, x, y = f"{path}/{k}", a.get(k), b.get(k)
        if isinstance(x, dict) and isinstance(y, dict):
            out += documents_differ(x, y, at)
        elif (k in a) != (k in b) or x != y:
            out.append(at)
    return out


def turn_versions(old: DataFrame, new: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """in_edge, out_edge, change, kind (u_turn or ordinary_turn), relations: the difference of two turn tables with what may have caused it."""
    from ..operators.turns import u_turn

    key = ["in_edge", "out_edge"]
    diff = version_diff(old, new, key)
    a, b = ids.parse_stable_id(F.col("in_edge")), ids.parse_stable_id(F.col("out_edge"))
    diff = diff.withColumn("kind", u_turn(a[3], a[4], b[3], b[4]))
    if relations is None:
        return diff.withColumn("relations", F.array().cast("array<bigint>"))
    return diff.join(relations.select(*key, "relations"), key, "left").withColumn("relations", F.coalesce("relations", F.array().cast("array<bigint>")))


def causes(diff: DataFrame) -> dict:
    """The cause document of a version difference: counts by change, kind and whether a relation explains it."""
    rows = diff.groupBy("change", "kind", (F.size("relations") > 0).alias("explained")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {f"{r['change']}/{r['kind']}/{'relation' if r['explained'] else 'unexplained'}": r["n"] for r in rows}


def has_schema(df: DataFrame, schema: str | T.StructType) -> list[str]:
    """How a table departs from its contract: missing, additional and differently typed columns."""
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    a, b = {f.name: f.dataType for f in want}, {f.name: f.dataType for f in df.schema}
    return [f"missing {n}" for n in a if n not in b] + [f"additional {n}" for n in b if n not in a] + [f"{n} is {b[n].simpleString()}" for n in a if n in b and a[n] != b[n]]


def same_features(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys on one side only, and keys whose other columns differ (nulls are equal)."""
    rest = [c for c in a.columns if c != key]
    both = a.select(key, F.struct(*rest).alias("_a")).join(b.select(key, F.struct(*rest).alias("_b")), key, "full_outer")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("differ"))


def one_match(targets: DataFrame, features: DataFrame, on: list[str]) -> DataFrame:
    """Each target with its only feature; none or several fail the query."""
    n = features.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*[c for c in features.columns if c not in on])).alias("feature"))
    ok = F.when(F.col("_n").eqNullSafe(1), True).otherwise(F.raise_error(F.concat(F.lit("features of a target: "), F.coalesce(F.col("_n").cast("string"), F.lit("0")))))
    return targets.join(n, on, "left").where(ok).drop("_n")


def pinned(content: bytes, sha256: str, label: str, size: int | None = None) -> bytes:
    """Bytes that have the digest, and size, they should have; else an error that names them."""
    if (got := hashlib.sha256(content).hexdigest()) != sha256:
        raise ValueError(f"{label}: SHA-256 is {got}, not {sha256}")
    if size is not None and len(content) != size:
        raise ValueError(f"{label}: {len(content)} bytes, not {size}")
    return content


def within_budget(sizes: DataFrame, most: int) -> DataFrame:
    """One row for products (name, bytes): their number, bytes, and whether a budget holds them."""
    return sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).withColumn("fits", F.col("bytes") <= most)
