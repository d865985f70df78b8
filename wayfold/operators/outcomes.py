"""Outcome tables of route searches: writing, ranking, zero-filled counts, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import unmatched
from .search import CATEGORIES


def histogram(df: DataFrame, column: str, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """category, n for every known category; a row of an unknown one fails the query."""
    spark = df.sparkSession
    every = spark.createDataFrame([(c,) for c in categories], "category string")
    known = F.col(column).isin(*categories)
    checked = df.select(F.when(known, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce(F.col(column), F.lit("null"))))).alias("category"))
    return F.broadcast(every).join(checked.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def unknown_keys(df: DataFrame, column: str, categories: tuple[str, ...]) -> DataFrame:
    """The values that an enumeration lacks."""
    every = df.sparkSession.createDataFrame([(c,) for c in categories], f"{column} string")
    return unmatched(df.select(column).distinct(), every, column)


def joined_order(order: Column) -> Column:
    return F.array_join(order, " -> ")


def write_outcomes(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Outcomes as CSV with a header; with partition_by each model is a part of its own that can be written again alone."""
    flat = df.select(*[joined_order(F.col(c).cast("array<string>")).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    if partition_by:
        flat.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).option("header", True).csv(path)
    else:
        flat.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def finishes(df: DataFrame, terminal: str = "terminal") -> DataFrame:
    """The cheapest feasible row of each terminal, with its provenance as JSON and its order as text."""
    best = df.where("category = 'FEASIBLE'").groupBy(terminal).agg(F.min(F.struct("cost", "route", "order", "length")).alias("x"))
    provenance = F.to_json(F.struct(F.col("x.route").alias("route"), F.col("x.cost").alias("cost")))
    return best.select(terminal, F.col("x.route").alias("route"), F.col("x.cost").alias("cost"), F.col("x.length").alias("length"), joined_order(F.col("x.order").cast("array<string>")).alias("order"), provenance.alias("provenance"))


def best_failed(df: DataFrame, group: str) -> DataFrame:
    """Of each group's failed attempts the one whose category ranks first, then the longest order reached, then the least route."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    key = F.struct(rank.alias("rank"), (-F.col("reached")).alias("short"), F.col("route").alias("id"))
    return df.where("category <> 'FEASIBLE'").groupBy(group).agg(F.min_by(F.struct("route", "category", "reached"), key).alias("x")).select(group, "x.*")


def longest(df: DataFrame, group: str) -> DataFrame:
    """The longest order that any attempt of a group reached."""
    return df.groupBy(group).agg(F.max("reached").alias("reached"), F.max_by("route", F.struct("reached", "route")).alias("route"))


def ranked_terminals(df: DataFrame) -> DataFrame:
    """Terminals by cost, with the second's distance from the best."""
    w = W.orderBy("cost", "terminal")
    return df.groupBy("terminal").agg(F.min("cost").alias("cost")).where("cost IS NOT NULL").withColumn("rank", F.row_number().over(w)).withColumn("gap", F.col("cost") - F.min("cost").over(W.partitionBy())).where("rank <= 2")


def first_per(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group: the schedule's candidates for each terminal."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def any_row(df: DataFrame) -> bool:
    return not df.isEmpty()


def status(counts: dict[str, int], expected: int) -> str:
    """What a run as a whole has shown."""
    if sum(counts.values()) != expected or counts.get("CHECKER_MISMATCH") or counts.get("EXCEPTION"):
        return "VALIDATION_FAILURE"
    return "SUCCESS" if counts.get("FEASIBLE") else "NO_FEASIBLE_ROUTE"
