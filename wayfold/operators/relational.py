"""Resolving, collapsing, allocating and comparing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def argmin_join(left: DataFrame, right: DataFrame, on: list[str], rank: list[Column], keep: str) -> DataFrame:
    """For each row of left (by its columns), the row of right that ranks first, as a struct `keep`.

    One shuffle on the join key; the minimum is combined before the second one."""
    own = left.columns
    best = F.min_by(F.struct(*[F.col(c) for c in right.columns if c not in on]), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)]))
    return left.join(right, on).groupBy(*own).agg(best.alias(keep))


def unmatched(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


def with_default(left: DataFrame, right: DataFrame, on: str, column: str, default) -> DataFrame:
    return left.join(right, on, "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def first_last(df: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    at = F.struct(*order)
    return df.groupBy(group).agg(F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"), F.count(F.lit(1)).alias("n"))


def unique_continuation(edges: DataFrame) -> DataFrame:
    """a, b: nodes of which exactly one edge leads on and exactly one leads in, apart from turning back.

    edges: from_node, to_node, distinct pairs."""
    pairs = edges.select("from_node", "to_node").where("from_node <> to_node").distinct()
    out = pairs.groupBy(F.col("from_node").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("to_node").alias("next")).where("n = 1")
    into = pairs.groupBy(F.col("to_node").alias("next")).agg(F.count(F.lit(1)).alias("m")).where("m = 1")
    return out.join(into, "next").select(F.col("node").alias("a"), F.col("next").alias("b"))


def collapsed(df: DataFrame, group: str, order: list[str], real: Column, amount: str, strict: bool = False) -> DataFrame:
    """Rows that are not real give their amount to the previous real row, or to the first one before there is any.

    With `strict`, a group without a real row fails the query when it is read; else it is left out."""
    running = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    numbered = df.withColumn("_real", real).withColumn("_g", F.greatest(F.lit(1), F.sum(F.col("_real").cast("int")).over(running)))
    agg = numbered.groupBy(group, "_g").agg(F.sum(amount).alias(amount), F.sum((~F.col("_real")).cast("long")).alias("folded"), F.max("_real").alias("_any"))
    if strict:
        agg = agg.withColumn("_any", F.when(F.col("_any"), True).otherwise(F.raise_error(F.concat(F.lit("no real row in group "), F.col(group).cast("string")))))
    return agg.where("_any").select(group, F.col("_g").alias("ordinal"), amount, "folded")


def allocated(df: DataFrame, group: str, order: list[str], total: str, weight: str) -> DataFrame:
    """Largest-remainder shares of a group's integer total by integer weights; ties go to the earlier row."""
    w = W.partitionBy(group)
    # products of two 64-bit numbers need wider decimals than the columns have
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    out = df.withColumn("_w", F.sum(wide(weight)).over(w).cast("decimal(19,0)"))
    product = wide(total) * wide(weight)
    out = out.withColumn("_floor", F.when(F.col("_w") > 0, F.floor(F.try_divide(product - product % F.col("_w"), F.col("_w")))).otherwise(0).cast("bigint"))
    out = out.withColumn("_rest", F.when(F.col("_w") > 0, product % F.col("_w")).otherwise(0).cast("decimal(19,0)"))
    out = out.withColumn("_left", F.col(total) - F.sum("_floor").over(w)).withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_rest"), *order)))
    return out.withColumn("share", F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("bigint")).drop("_w", "_floor", "_rest", "_left", "_rank")


def one_per_key(df: DataFrame, key: list[str]) -> DataFrame:
    """Of rows with equal keys the least one, by all columns."""
    rest = [c for c in df.columns if c not in key]
    least = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_x"))
    return least.select(*key, *[F.col("_x")[c].alias(c) for c in rest])


def version_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key, change: added, removed or changed (any other column differs)."""
    rest = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("_a"))
    b = new.select(*key, F.struct(*rest).alias("_b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(*key, change.alias("change")).where("change IS NOT NULL")


def digest(df: DataFrame) -> DataFrame:
    """Rows and an order-insensitive digest, to compare two builds of a table."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("digest"))


def first_hits(df: DataFrame, group: str, position: str, mask: str, bits: int) -> DataFrame:
    """group, bits in the order in which their first occurrence stands; at one position in ascending order."""
    from ..functions.bits import set_bits

    each = df.select(group, position, F.explode(set_bits(F.col(mask), bits)).alias("bit"))
    first = each.groupBy(group, "bit").agg(F.min(position).alias("at"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bit"))), lambda x: x["bit"]).alias("order"))


def top_with_gap(df: DataFrame, group: str, cost: str, tie: str, n: int) -> DataFrame:
    w = W.partitionBy(group).orderBy(cost, tie)
    ranked = df.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.lead(cost).over(w) - F.col(cost))
    return ranked.where(F.col("rank") <= n)


def sorted_unique(df: DataFrame, order: list[str], key: list[str]) -> DataFrame:
    """One row: rows, distinct keys and whether they agree."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*key).alias("n_keys")).withColumn("is_unique", F.col("n") == F.col("n_keys"))


def strictly_ascending(df: DataFrame, key: str, position: str, parts: int = 64) -> DataFrame:
    """n, disorder: pairs of neighbours by position whose keys do not ascend. Positions are dealt by ranges; what ends a range is compared with the next one's first row."""
    from pyspark.sql import Window as W

    w = W.partitionBy("_p").orderBy(position)
    dealt = df.select(F.col(key).alias("_k"), F.col(position)).repartitionByRange(parts, position).withColumn("_p", F.spark_partition_id())
    inner = dealt.withColumn("_before", F.lag("_k").over(w))
    each = inner.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_before") >= F.col("_k")).alias("bad"), F.min_by("_k", position).alias("first"), F.max_by("_k", position).alias("last"), F.min(position).alias("at"))
    seams = each.withColumn("_last", F.lag("last").over(W.partitionBy(F.lit(0)).orderBy("at")))
    return seams.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("bad") + F.coalesce((F.col("_last") >= F.col("first")).cast("long"), F.lit(0))), F.lit(0)).alias("disorder"))


def gaps(df: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys, the least and greatest, and whether they leave none out."""
    out = df.agg(F.count_distinct(key).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    return out.withColumn("is_dense", (F.col("lo") == 0) & (F.col("hi") + 1 == F.col("n")))
