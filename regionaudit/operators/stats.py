"""Resampling by clusters: Spark sums the terms of each cluster, tasks draw blocks of clusters, Spark adds the blocks up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITERATIONS, EPS = 10_000, 1e-6
#: Clusters of a block (a task holds a block's sums at a time), and hash buckets, of which blocks are made.
BLOCK, BUCKETS = 1 << 13, 1 << 14
#: Counts that a task holds at a time.
HELD = 1 << 20


def block_draws(before: np.ndarray, block: int, iterations: int, seed: list[int]) -> np.ndarray:
    """How many clusters each resample takes from ``block``; ``before``: clusters before each block, and all at its end.

    The blocks form a binary tree; every node's draws are split between its halves by a generator seeded with the
    node, so that any task gets its own block's share of the multinomial law alone, and a rerun gets the same.
    """
    low, high = 0, len(before) - 1
    draws = np.full(iterations, before[-1], np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        share = (before[middle] - before[low]) / max(1, before[high] - before[low])
        left = np.random.default_rng([*seed, low, high]).binomial(draws, share)
        low, high, draws = (low, middle, left) if block < middle else (middle, high, draws - left)
    return draws


def block_sums(table: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(resamples, terms) sums of rows of ``table``, of which resample i takes draws[i] with replacement."""
    n, out = len(table), np.empty((len(draws), table.shape[1]))
    step = max(1, HELD // n)
    for low in range(0, len(draws), step):
        some = draws[low : low + step]
        at = np.repeat(np.arange(len(some)) * n, some) + rng.integers(0, n, int(some.sum()))
        out[low : low + step] = np.bincount(at, minlength=len(some) * n).reshape(len(some), n) @ table
    return out


def resampled(sums: DataFrame, group: str, cluster: str, names: list[str], iterations: int = ITERATIONS, seed: int = 42) -> DataFrame:
    """group, draw and the sums of each term over every resample of a group's clusters; draw -1 is the table itself.

    ``sums`` has one row a group and cluster.  As many clusters as the group has are drawn with replacement, and all
    terms of a cluster go together, so that columns of one table are paired.  Whole sums stay exact, in any order.
    """
    bucket = F.pmod(F.xxhash64(cluster), F.lit(BUCKETS)).cast("int")
    counts: dict = {}
    for r in sums.groupBy(group, bucket.alias("bucket")).count().collect():
        counts.setdefault(r[group], np.zeros(BUCKETS, np.int64))[r.bucket] = r["count"]
    most = max((int(c.sum()) for c in counts.values()), default=0)
    blocks = 1
    while blocks < BUCKETS and blocks * BLOCK < most:
        blocks *= 2
    order = sorted(counts, key=lambda g: (g is None, g))
    plan = {g: (i, np.concatenate([[0], np.cumsum(counts[g].reshape(blocks, -1).sum(axis=1))])) for i, g in enumerate(order)}
    shared = sums.sparkSession.sparkContext.broadcast(plan)
    kind = sums.schema[group].dataType.simpleString()

    def work(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        number, before = shared.value[key[0]]
        block = int(key[1])
        if len(g) != before[block + 1] - before[block]:
            raise RuntimeError(f"block {block} of {key[0]} has {len(g)} clusters; {before[block + 1] - before[block]} were counted before")
        table = g.sort_values(cluster)[names].to_numpy(float)
        draws = block_draws(before, block, iterations, [seed, number])
        out = block_sums(table, draws, np.random.default_rng([seed, number, block]))
        out = pd.DataFrame(np.concatenate([table.sum(axis=0, keepdims=True), out]), columns=names)
        out.insert(0, "draw", np.arange(-1, iterations))
        out.insert(0, group, key[0])
        return out

    tasks = min(max(1, blocks * len(plan)), int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = sums.withColumn("block", F.floor(bucket / (BUCKETS // blocks)).cast("int")).repartition(tasks, group, "block")
    drawn = placed.groupBy(group, "block").applyInPandas(work, f"{group} {kind}, draw int, " + ", ".join(f"{n} double" for n in names))
    return drawn.groupBy(group, "draw").agg(*[F.sum(n).alias(n) for n in names])


def bounds(draws: np.ndarray) -> tuple[float | None, float | None]:
    """2.5 and 97.5 percentiles; none where under half of the resamples are finite."""
    finite = draws[np.isfinite(draws)]
    return tuple(np.percentile(finite, [2.5, 97.5]).tolist()) if len(finite) >= max(1, len(draws) // 2) else (None, None)


def paired_miou(df: DataFrame, stratum: str, cluster: str, label: str, labels: list[str], overlap: dict[str, Column], union: Column, iterations: int = ITERATIONS, seed: int = 0) -> DataFrame:
    """Intervals of the mIoU of two variants and of their difference: estimate, clusters, point, mean, low, high, share_le_0.

    Clusters are resampled within each stratum, by the same draws for both variants; the mean of overlap / (union + EPS)
    over ``labels`` is averaged over strata.  ``overlap`` has the two variants by name; the last row is the first less the
    second.  point is of the table itself, mean that of the resamples, share_le_0 the share of resamples not over 0.
    """
    a, b = overlap
    terms = {"n": F.lit(1)} | {f"{n}{i}": F.sum(F.when(F.col(label) == c, e).otherwise(0)) for i, c in enumerate(labels) for n, e in ((a, overlap[a]), (b, overlap[b]), ("union", union))}
    sums = df.groupBy(stratum, cluster).agg(*[e.cast("double").alias(n) for n, e in terms.items()])
    means = [(sum(F.col(f"{v}{i}") / (F.col(f"union{i}") + EPS) for i in range(len(labels))) / len(labels)).alias(v) for v in (a, b)]
    drawn = resampled(sums, stratum, cluster, list(terms), iterations, seed).select(stratum, "draw", "n", *means)

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["draw", stratum]).groupby("draw", sort=True)[["n", a, b]].agg({"n": "sum", a: "mean", b: "mean"})
        rows = []
        for name, value in ((a, g[a]), (b, g[b]), (f"{a}-{b}", g[a] - g[b])):
            draws = value.to_numpy()[1:]
            rows.append([name, int(g["n"].iloc[0]), value.iloc[0], draws.mean(), *bounds(draws), (draws <= 0).mean()])
        return pd.DataFrame(rows, columns=["estimate", "clusters", "point", "mean", "low", "high", "share_le_0"])

    return drawn.groupBy().applyInPandas(work, "estimate string, clusters long, point double, mean double, low double, high double, share_le_0 double")


def cluster_interval(df: DataFrame, cluster: str, terms: dict[str, Column], statistic: Callable[[np.ndarray], np.ndarray], group: str, iterations: int = ITERATIONS, seed: int = 42) -> DataFrame:
    """Percentile interval (2.5 to 97.5) by group of a statistic of additive terms, resampling whole clusters.

    Null bounds where under half of the resamples give a finite statistic.
    """
    sums = df.groupBy(group, cluster).agg(F.lit(1.0).alias("clusters"), *[F.sum(e).cast("double").alias(n) for n, e in terms.items()])
    kind, names = sums.schema[group].dataType.simpleString(), list(terms)

    def work(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("draw")
        values = statistic(g[names].to_numpy())
        low, high = bounds(values[1:])
        return pd.DataFrame({group: [key[0]], "clusters": [int(g["clusters"].iloc[0])], "point": [values[0]], "low": [low], "high": [high]})

    drawn = resampled(sums, group, cluster, ["clusters", *names], iterations, seed)
    return drawn.groupBy(group).applyInPandas(work, f"{group} {kind}, clusters long, point double, low double, high double")


def f1(sums: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return 2 * sums[:, 0] / (2 * sums[:, 0] + sums[:, 1] + sums[:, 2])


def f1_difference(sums: np.ndarray) -> np.ndarray:
    """F1 of the first three terms less that of the last three, made from the same resample."""
    return f1(sums[:, :3]) - f1(sums[:, 3:])


def rate(sums: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return sums[:, 0] / sums[:, 1]


def alignment(a: DataFrame, b: DataFrame, stratum: str, cluster: str) -> DataFrame:
    """By stratum: frames of two dumps, those that only one has, and whether there are none such."""
    left, right = (d.select(stratum, cluster).distinct().withColumn(n, F.lit(1)) for d, n in ((a, "in_a"), (b, "in_b")))
    both = left.join(right, [stratum, cluster], "full").groupBy(stratum)
    out = both.agg(F.count("in_a").alias("frames_a"), F.count("in_b").alias("frames_b"), F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("apart"))
    return out.withColumn("aligned", F.col("apart") == 0)


def separable(low: Column, high: Column) -> Column:
    return low * high > 0
