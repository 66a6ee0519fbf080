"""Mixing sources to target weights, in DataFrame operations only.

Targets come from capped water-filling: each source gets its share of the mix by weight, sources are clamped
at a maximum number of epochs, and what they leave is shared out by weight.  The fixed point is closed-form:
with sources in the order of cap / weight, the level is the greatest of (budget - caps before) / (weights from
here on).  A document is taken as many whole times as its source is repeated; the fractional repetition goes
to documents in a seeded order until the source's words reach its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import written
from .quality_rules import n_words

WEIGHTS = (3, 1, 2)
SHARE_PERCENT, MAX_EPOCHS, SEED = 150, 2, 42
#: A source's seeded order is cut into so many buckets, and the one that holds the target's end into so many again; only one of those is ever sorted.
BUCKETS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds target to a table of sources (source, source_size), one row each; the windows hold one row a source."""
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    budget = F.sum("source_size").over(Window.partitionBy()) * share_percent / F.lit(100.0)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", (budget - before) / left).withColumn("level", F.max("level").over(Window.partitionBy()))
    return ranked.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = SEED) -> DataFrame:
    """docs as a struct column ``row``, with size, source_size, target (of its source) and copies.

    A null text has size 0.  Null is a source of its own, the last one.  Documents of size 0 follow their
    source's repetitions; a source without words has target 0 and no copies.  Equal rows come next to each
    other in the seeded order and are taken equally often, so that they may leave the target by half of their words.  Reruns on the same rows agree.  An empty table gives an empty
    result; texts may be of any length.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    draw = F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column))
    sized = docs.select(row, F.col(source_column).alias("source"), n_words(F.coalesce(F.col(text_column), F.lit(""))).alias("size"), draw.alias("draw"))
    # places in the seeded order: bucket, part of it, draw
    bucket, part = F.pmod("draw", F.lit(BUCKETS)).cast("int"), F.pmod(F.shiftright("draw", 32), F.lit(BUCKETS)).cast("int")
    narrow = written(sized.select("source", "size", "draw")).withColumn("bucket", bucket).withColumn("part", part)
    by_bucket = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.withColumn("whole", rate).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = _cut(plan, by_bucket, "bucket", "cut")
    plan = _cut(plan, _of(narrow, plan).where("bucket = cut").groupBy("source", "part").agg(F.sum("size").alias("words")), "part", "cut_part")
    last = _of(narrow, plan).where("bucket = cut AND part = cut_part").groupBy("source", "draw", "left").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("upto", upto).where(F.col("upto") - F.col("words") / 2 <= F.col("left")).groupBy("source").agg(F.max("draw").alias("cut_draw"))
    plan = written(_of(plan, last, "left"))
    taken = (F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & ((F.col("part") < F.col("cut_part")) | ((F.col("part") == F.col("cut_part")) & (F.col("draw") <= F.col("cut_draw")))))
    placed = _of(sized.withColumn("bucket", bucket).withColumn("part", part), plan)
    return placed.select("row", "size", "source_size", "target", (F.col("whole") + F.coalesce(taken, F.lit(False)).cast("long")).cast("long").alias("copies"))


def _of(df: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """df with what a plan, a row a source, says of each row's source.  Plans are written, so that Spark knows when to broadcast them."""
    other = plan.withColumnRenamed("source", "_source")
    return df.join(other, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _cut(plan: DataFrame, words: DataFrame, level: str, name: str) -> DataFrame:
    """The plan with the value of ``level`` in which each source's target ends, as ``name``, and what is left of the target there."""
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, 0))
    ends = _of(words.withColumn("upto", upto), plan.select("source", "left")).where(F.col("upto") - F.col("words") < F.col("left"))
    ends = ends.groupBy("source").agg(F.max(F.struct(F.col(level), (F.col("left") - F.col("upto") + F.col("words")).alias("rest"))).alias("end"))
    out = _of(plan, ends, "left").withColumn(name, F.coalesce(f"end.{level}", F.lit(-1)))
    return written(out.withColumn("left", F.coalesce("end.rest", F.lit(0.0))).drop("end"))


def mix_report(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each document: id_column, size, source_size, target and taken, the words that the mix takes."""
    return mixed(docs, id_column).select(F.col(f"row.{id_column}").alias(id_column), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken (see mixed); an empty table gives an empty result."""
    return mixed(docs).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
