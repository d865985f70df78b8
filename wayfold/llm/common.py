"""Shared helpers: the shared work folder, written tables, ASCII word columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: spark.checkpoint.dir, or a local one where it is unset."""
    key = "spark.checkpoint.dir"
    top = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not top:
        top = f"file://{tempfile.mkdtemp(prefix='wayfold-')}"
        spark.conf.set(key, top)
    return top.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more: its cleaner waits for the driver's garbage collection."""
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, and a lost executor costs no recomputation."""
    spark, schema, path = df.sparkSession, df.schema, new_path(df.sparkSession, name)
    # of the step before: what has only just ended is still in the queue of Spark's listeners
    release(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def small(df: DataFrame, most: int) -> DataFrame:
    """df, marked for broadcast only if it has at most `most` rows; otherwise Spark joins by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column, separators: str = SPACE) -> Column:
    """Maximal runs without a separator; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; clashing extra columns of an input never reach a join."""
    return df.select(*[df[n] for n in names])


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once.

    Catalyst may copy the expression behind a column into a filter it pushes down,
    and a copy inside a lambda is evaluated for each element. A value bound by a
    lambda of its own is safe from that."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ship(spark: SparkSession) -> None:
    """Puts this package on the executors' Python path, once for each Spark application."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_wayfold_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="wayfold-"), "wayfold.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(top):
            for f in (f for f in files if f.endswith(".py")):
                path = os.path.join(folder, f)
                z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(name)
    sc._wayfold_shipped = True
