"""Scoring against human verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import ranked


def count_if(condition: Column, weight: Column | int = 1) -> Column:
    return F.sum(F.when(condition, weight).otherwise(0)).cast("long")


def confusion(df: DataFrame, keeps: Column, correct: Column, *by: str, weight: Column | int = 1) -> DataFrame:
    """Counts of kept and deleted regions against the human verdict; ``weight``: for how many regions a row stands."""
    cells = {"tp": keeps & correct, "fp": keeps & ~correct, "fn": ~keeps & correct, "tn": ~keeps & ~correct}
    return df.groupBy(*by).agg(*[count_if(c, weight).alias(n) for n, c in cells.items()])


def rates(counts: DataFrame, zeros: bool = False) -> DataFrame:
    """accuracy, precision, recall, f1, bad_kept, good_lost from counts.

    Without zeros, precision, recall and f1 are null where a denominator or tp is 0; with zeros they are 0.
    """
    c = F.col
    total = c("tp") + c("fp") + c("fn") + c("tn")
    fill = (lambda x: F.coalesce(x, F.lit(0.0))) if zeros else (lambda x: F.when(c("tp") > 0, x))
    return counts.select(
        "*",
        F.try_divide(c("tp") + c("tn"), total).alias("accuracy"),
        fill(F.try_divide(c("tp"), c("tp") + c("fp"))).alias("precision"),
        fill(F.try_divide(c("tp"), c("tp") + c("fn"))).alias("recall"),
        fill(F.try_divide(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"))).alias("f1"),
        F.try_divide(c("fp"), c("fp") + c("tn")).alias("bad_kept"),
        F.try_divide(c("fn"), c("tp") + c("fn")).alias("good_lost"),
    )


def fold(long: DataFrame, keys: list[str], ordinal: str, labeler: str, verdict: str, first: list[str]) -> DataFrame:
    """One row for each key: the first row's metadata, and the last verdict of each labeler (see verdicts)."""
    meta = long.groupBy(*keys).agg(F.min_by(F.struct(*first), ordinal).alias("meta"))
    return meta.join(verdicts(long, keys, ordinal, labeler, verdict), keys, "left").select(*keys, "meta.*", "labelers")


def verdicts(long: DataFrame, keys: list[str], ordinal: str, labeler: str, verdict: str) -> DataFrame:
    """The last verdict of each labeler as a map, in the order of the labelers' first rows, for keys that have a labeler."""
    last = long.where(F.col(labeler).isNotNull()).groupBy(*keys, labeler).agg(F.min(ordinal).alias("since"), F.max_by(verdict, ordinal).alias("v"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("since", labeler, "v"))), lambda e: F.struct(e[labeler], e["v"]))
    return last.groupBy(*keys).agg(F.map_from_entries(entries).alias("labelers"))


def consensus(labelers: Column) -> Column:
    """The verdict most labelers gave; null without verdicts and where the two most frequent tie."""
    given = F.filter(F.map_values(labelers), lambda v: v.isNotNull() & (v != ""))
    counts = F.transform(F.array_distinct(given), lambda v: F.struct(F.size(F.filter(given, lambda x: x == v)).alias("n"), v.alias("v")))
    ranked = F.reverse(F.array_sort(counts))
    return F.when((F.size(ranked) == 1) | (F.get(ranked, 0)["n"] > F.get(ranked, 1)["n"]), F.get(ranked, 0)["v"])


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two columns: n, agreed, kappa (null under two pairs or where chance explains all)."""
    n, agreed = F.count("*"), count_if(F.col(a) == F.col(b))
    total = pairs.agg(n.alias("n"), agreed.alias("agreed"))
    left, right = pairs.groupBy(F.col(a).alias("v")).agg(n.alias("na")), pairs.groupBy(F.col(b).alias("v")).agg(n.alias("nb"))
    chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("products"))
    c = F.col
    out = total.crossJoin(chance)  # one row each
    return out.select("n", "agreed", F.when((c("n") >= 2) & (c("n") * c("n") > c("products")), (c("n") * c("agreed") - c("products")) / (c("n") * c("n") - c("products"))).alias("kappa"))


def labelling_order(df: DataFrame, frame: str = "frame_id", stamp: str = "answered_at", verdict: str = "human", ordinal: str = "ord") -> DataFrame:
    """Frames with a verdict, ranked from 1 by their earliest stamp, equal ones by their first row with a verdict.

    Days are ordered globally, frames within their day.
    """
    firsts = df.where(F.col(verdict).isNotNull()).groupBy(frame).agg(F.min(stamp).alias("stamp"), F.min(ordinal).alias("_first"))
    return ranked(firsts, F.substring("stamp", 1, 10), "stamp", "_first", frame).drop("_first")


def targeting(df: DataFrame, key: Column, bad: Column, tie: str, part: Column) -> DataFrame:
    """A review queue in ascending order of a key, equal ones in the order of ``tie``: n, bad, bad_in_fifth, queue_for_half.

    bad_in_fifth are the bad rows in the first fifth (a half rounded to even), queue_for_half the rows that hold half of
    them.  Only one row for each key value is ordered globally, and one for each ``part`` (which must follow tie) of the
    two values where the places lie; rows are ordered within the part that holds a place.
    """
    c, whole = F.col, Window.partitionBy()
    df = df.select(key.alias("key"), F.struct(F.col(tie)).alias("tie"), part.alias("part"), bad.cast("long").alias("bad"))

    def upto(rows: DataFrame, level: str) -> DataFrame:
        """Per value of a level, in each group of those before: rows and bad rows up to its end, counted from the table's start."""
        by = {"key": [], "part": ["what", "key"], "tie": ["what", "key", "part"]}[level]
        steps = rows.groupBy(*by, level).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), *([F.first(x).alias(x) for x in ("n0", "bad0", "fifth", "half")] if by else []))
        w = Window.partitionBy(*by).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
        start = (c("n0"), c("bad0")) if by else (F.lit(0), F.lit(0))
        return steps.withColumn("n_to", start[0] + F.sum("n").over(w)).withColumn("bad_to", start[1] + F.sum("bad").over(w))

    steps = upto(df, "key").withColumn("n_all", F.sum("n").over(whole)).withColumn("bad_all", F.sum("bad").over(whole))
    steps = steps.withColumn("fifth", F.bround(0.2 * c("n_all")).cast("long")).withColumn("half", c("bad_all") / 2)
    total = steps.agg(F.max("n_all").alias("n"), F.max("bad_all").alias("bad"))
    held = (F.col("what") == "fifth") & (c("n_to") >= c("fifth")) & (c("n_to") - c("n") < c("fifth")) | (F.col("what") == "half") & (c("bad_to") >= c("half")) & (c("bad_to") - c("bad") < c("half"))
    goals = F.explode(F.array(F.lit("fifth"), F.lit("half")))
    place = [(c("n_to") - c("n")).alias("n0"), (c("bad_to") - c("bad")).alias("bad0"), "fifth", "half"]
    found = steps.withColumn("what", goals).where(held).select("what", "key", *place)
    rows = upto(df.join(found, "key"), "part").where(held).select("what", "key", "part", *place)
    ends = upto(df.join(rows, ["key", "part"]), "tie").where(held)
    out = ends.agg(F.max(F.when(c("what") == "fifth", c("bad_to"))).alias("bad_in_fifth"), F.min(F.when(c("what") == "half", c("n_to"))).alias("queue_for_half"))
    return total.crossJoin(out).select("n", "bad", F.coalesce("bad_in_fifth", F.lit(0)).cast("long").alias("bad_in_fifth"), "queue_for_half")  # one row each
