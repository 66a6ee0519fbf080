"""Choosing rows for review: best of each frame in turn over classes, strides, seeded samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, bucket: Column, *order: str, name: str = "rank") -> DataFrame:
    """Ranks from 1 by bucket, then by ``order``: only one row a bucket goes through a global ordering.

    ``bucket`` must follow the order, as a day follows its timestamps; the largest bucket is sorted by one task.
    """
    df = df.withColumn("_bucket", bucket)
    upto = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    before = df.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", (upto - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return df.withColumn("_place", place).join(before, "_bucket").withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_bucket", "_place", "_before")


def at_places(df: DataFrame, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row: the values at places (from 0, made from the number of rows) of a table sorted by value; only distinct values are ordered globally."""
    upto = F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    steps = df.groupBy(value).agg(F.count("*").alias("n")).withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return steps.agg(*[F.min(F.when(F.col("upto") > at(F.col("all")), F.col(value))).alias(name) for name, at in places.items()])


def round_robin(df: DataFrame, frame: str, group: str, score: Column, tie: str, k: int) -> DataFrame:
    """The best row of each frame, dealt out over groups in turn (larger groups first): the first k."""
    df = df.withColumn("score", score)
    best = df.withColumn("r", F.row_number().over(Window.partitionBy(frame).orderBy(F.col("score").desc(), tie))).where("r = 1").drop("r")
    turn = best.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(F.col("score").desc(), frame, tie))).where(F.col("turn") <= k)
    sizes = best.groupBy(group).agg(F.count("*").alias("group_size"))
    return turn.join(sizes, group).orderBy("turn", F.col("group_size").desc(), group).limit(k)


def stride(df: DataFrame, order: str, wanted: int, bucket: Column) -> DataFrame:
    """Every (n / wanted)-th row in order, as floor(i * n / wanted) for i under wanted; bucket: see ranked."""
    placed = ranked(df, bucket, order, name="at").withColumn("at", F.col("at") - 1).crossJoin(df.agg(F.count("*").alias("n")))  # one row
    i = F.ceil(F.col("at") * wanted / F.col("n"))
    return placed.where((F.col("n") <= wanted) | ((F.floor(i * F.col("n") / wanted) == F.col("at")) & (i < wanted))).drop("at", "n")


def sampled(df: DataFrame, k: int, seed: int, key: str, *by: str) -> DataFrame:
    """k rows of each group in a seeded order: Spark keeps only k rows a group and task before it shuffles."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), key), key))).where(F.col("r") <= k).drop("r")
