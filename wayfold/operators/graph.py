"""Iterative graph operators: each round is a join and a minimum; long loops cut their lineage by written tables."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUT_EVERY = 8


def cut(df: DataFrame, round_: int) -> DataFrame:
    """A checkpoint in the session's shared folder every few rounds; none where the session has no folder."""
    return df.checkpoint() if round_ % CUT_EVERY == CUT_EVERY - 1 and df.sparkSession.sparkContext.getCheckpointDir() else df


def reachable(pairs: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node, hops: the fewest hops from a seed, up to a bound. pairs: from_node, to_node. Reverse them for the way back."""
    found = seeds.select("node").distinct().withColumn("hops", F.lit(0))
    frontier = found
    for h in range(1, hops + 1):
        new = frontier.join(pairs, F.col("node") == F.col("from_node")).select(F.col("to_node").alias("node")).distinct()
        frontier = cut(new.join(found, "node", "left_anti").withColumn("hops", F.lit(h)), h)
        found = cut(found.unionByName(frontier), h)
    return found


def shortest(pairs: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node, cost: the least cost from a seed over at most `hops` pairs. pairs: from_node, to_node, cost."""
    labels = seeds.select("node", F.lit(0).cast("bigint").alias("cost")).distinct()
    for h in range(hops):
        step = labels.withColumnRenamed("cost", "_c").join(pairs, F.col("node") == F.col("from_node")).select(F.col("to_node").alias("node"), (F.col("_c") + F.col("cost")).alias("cost"))
        labels = cut(labels.unionByName(step).groupBy("node").agg(F.min("cost").alias("cost")), h)
    return labels


def fixed_order(pairs: DataFrame, marks: DataFrame, seeds: DataFrame, order: list[int], hops: int) -> DataFrame:
    """node, progress, cost: cheapest walks that meet the marks of `order` first in that order.

    marks: node, bit. A state is a node and how much of the order is done, not a set of visited marks: a
    walk that meets a later mark too early is dropped, so what it has visited follows from its progress."""
    index = F.create_map(*[x for i, b in enumerate(order) for x in (F.lit(b), F.lit(i))])
    target = marks.select(F.col("node").alias("_m"), index[F.col("bit")].alias("_i")).where("_i IS NOT NULL")
    labels = seeds.select("node", F.lit(0).alias("progress"), F.lit(0).cast("bigint").alias("cost"))
    stepped = pairs.join(target, F.col("to_node") == F.col("_m"), "left").select("from_node", "to_node", F.col("cost").alias("_c"), F.coalesce("_i", F.lit(-1)).alias("_i"))
    for h in range(hops):
        step = labels.join(stepped, F.col("node") == F.col("from_node")).where(F.col("_i") <= F.col("progress"))
        step = step.select(F.col("to_node").alias("node"), (F.col("progress") + (F.col("_i") == F.col("progress")).cast("int")).alias("progress"), (F.col("cost") + F.col("_c")).alias("cost"))
        labels = cut(labels.unionByName(step).groupBy("node", "progress").agg(F.min("cost").alias("cost")), h)
    return labels


def candidate_orders(cities: list[str], fixed: list[list[str]], seed: int, shuffles: int = 8, swaps: int = 15) -> list[tuple[str, list[str]]]:
    """Named visiting orders: the fixed ones, the given one, its reverse, seeded shuffles, and adjacent swaps of the fixed ones.

    All begin where the given one does: only what follows is turned round, shuffled or swapped, and the last two stay."""
    start, *rest = cities
    out = [(f"fixed-{i}", list(o)) for i, o in enumerate(fixed)] + [("given", list(cities)), ("reversed", [start, *rest[::-1]])]
    source = random.Random(seed)
    for i in range(shuffles):
        tail = list(rest)
        source.shuffle(tail)
        out.append((f"shuffle-{i}", [start, *tail]))
    for i, o in enumerate(fixed):
        out += [(f"fixed-{i}-swap-{k}", [*o[:k], o[k + 1], o[k], *o[k + 2 :]]) for k in range(1, min(swaps, len(o) - 3) + 1)]
    return out


def ending_at(candidates: list[tuple[str, list[str]]], terminal: str) -> list[tuple[str, list[str]]]:
    """The candidates with a place moved to their end; those that end there already, or lack it, stay as they are."""
    move = lambda n, o: (n, o) if terminal not in o or o[-1] == terminal else (f"{n}-end-{terminal}", [c for c in o if c != terminal] + [terminal])
    return [move(n, o) for n, o in candidates]


def schedule(spark, cities: list[str], fixed: list[list[str]], seed: int, first: int = 8) -> DataFrame:
    """route, source, order: the fixed orders, all candidates, then for each last city the first candidates with it moved to the end."""
    candidates = candidate_orders(cities, fixed, seed)
    rows = [(f"mandatory-{i}", "fixed", list(o)) for i, o in enumerate(fixed)] + [(n, "candidate", o) for n, o in candidates]
    rows += [(f"end-{t}-{i}", "terminal", o) for t in cities[1:] for i, (_, o) in enumerate(ending_at(candidates, t)[:first])]
    return spark.createDataFrame(rows, "route string, source string, order array<string>")
