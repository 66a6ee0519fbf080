"""Health of a run: degenerate replies, frame status, monitors, process sessions, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import degenerate

WINDOW, MAX_RATE, LEAST_SAMPLES, EXIT_CODE = 200, 0.35, 60, 42


def frame_status(replies: Column) -> Column:
    """no-discovery, corrupt (all degenerate), partial (some) or clean, from an array of replies."""
    return F.when(F.size(replies) == 0, "no-discovery").when(F.forall(replies, degenerate), "corrupt").when(F.exists(replies, degenerate), "partial").otherwise("clean")


def failed_signals(parse_failed: Column) -> Column:
    """Names of signals whose reply was degenerate, from a map of signal to struct(degenerate, raw)."""
    return F.map_keys(F.map_filter(parse_failed, lambda _, v: v["degenerate"]))


def monitor(df: DataFrame, order: str, bad: Column, *keys: str, window: int = WINDOW, max_rate_percent: int = 35, least: int = LEAST_SAMPLES) -> DataFrame:
    """Sliding count window over each monitor's answers: bad and total in the window, tripped (latched)."""
    w = Window.partitionBy(*keys).orderBy(order)
    recent = w.rowsBetween(-(window - 1), 0)
    out = df.withColumn("window_bad", F.sum(bad.cast("long")).over(recent)).withColumn("window_calls", F.count("*").over(recent))
    over = (F.col("window_calls") >= least) & (100 * F.col("window_bad") >= max_rate_percent * F.col("window_calls"))
    return out.withColumn("tripped", F.max(over).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def sessions(df: DataFrame, key: str, order: str, calls: str) -> DataFrame:
    """Process runs by key: a counter under half of its running peak (above 200) starts a new one."""
    start = F.struct(F.lit(0).cast("long").alias("session"), F.lit(0).cast("long").alias("peak"))

    def step(a: Column, x: Column) -> Column:
        fresh = (a["peak"] > 200) & (2 * x["calls"] < a["peak"])
        return F.struct((a["session"] + fresh.cast("long")).alias("session"), F.when(fresh, x["calls"]).otherwise(F.greatest(a["peak"], x["calls"])).alias("peak"))

    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(calls).cast("long").alias("calls")))).alias("rows"))
    return rows.select(key, (F.aggregate("rows", start, step)["session"] + 1).alias("sessions"), F.size("rows").cast("long").alias("snapshots"))


def pruned(results: DataFrame, tainted: DataFrame, key: str = "frame_id") -> DataFrame:
    """Results without tainted frames, for an overwrite; nothing is deleted in place."""
    return results.join(tainted.select(key).distinct(), key, "left_anti")


def resume(wanted: DataFrame, done: DataFrame, key: str = "frame_id") -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_anti")
