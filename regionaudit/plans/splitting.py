"""Splits of frames by stratum, forced test sets, cached analyses, metric dumps and mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import stats
from ..operators.integrity import resume
from ..operators.select import round_robin
from ..operators.splits import stratified
from ..session import ship
from ..sources.fixtures import REGIONS, regions
from .registry import query

LEAST_TEST = 30

_FRAMES = f"""WITH {REGIONS}, frames AS (SELECT frame_id, weather, weather || CASE WHEN bool_or(class_name = 'cyclist') THEN '__rare' ELSE '__common' END AS stratum, sum(pixel_count)::BIGINT AS px FROM regions GROUP BY frame_id, weather)"""


def _frames(spark, sf_dir) -> DataFrame:
    """Frames with their weather and stratum: whether they hold the rare class."""
    rare = F.when(F.bool_or(F.col("class_name") == "cyclist"), "rare").otherwise("common")
    return regions(spark, sf_dir).groupBy("frame_id", "weather").agg(rare.alias("rare"), F.sum("pixel_count").alias("px")).withColumn("stratum", F.concat_ws("__", "weather", "rare"))


@query(f"""{_FRAMES}, s AS (SELECT stratum, weather, count(*) AS n FROM frames GROUP BY ALL), w AS (SELECT weather, least(greatest(round_even(sum(n) * 0.25, 0), {LEAST_TEST}), sum(n) - 2) AS least FROM s GROUP BY weather),
 a AS (SELECT s.*, least, row_number() OVER (PARTITION BY s.weather ORDER BY stratum) AS i FROM s JOIN w USING (weather)),
 b AS (SELECT *, greatest(1, least(greatest(round_even(n * 0.25, 0), least), n - 2)) AS first_test FROM a),
 q AS (SELECT stratum, n, CASE WHEN i = 1 THEN first_test ELSE greatest(1, least(greatest(round_even(n * 0.25, 0), least - lag(first_test) OVER (PARTITION BY weather ORDER BY i)), n - 2)) END AS n_test, greatest(1, round_even(n * 0.1, 0)) AS n_val FROM b),
 f AS (SELECT frame_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('7' || frame_id), frame_id) AS r FROM frames)
 SELECT frame_id, stratum, CASE WHEN r <= n_test THEN 'test' WHEN r <= n_test + n_val THEN 'validation' ELSE 'train' END AS split FROM f JOIN q USING (stratum)""")
def stratified_split(spark, sf_dir):
    """Train, validation and test within each weather and presence of the rare class, with a least number of test frames a weather."""
    return stratified(_frames(spark, sf_dir), "weather", "stratum", 0.1, 0.25, LEAST_TEST, seed=7).select("frame_id", "stratum", "split")


@query(f"""{_FRAMES}, c AS (SELECT frame_id, px FROM frames WHERE substr(frame_id, -1) <> '3'), m AS (SELECT frames.frame_id, frames.px FROM frames ANTI JOIN c USING (frame_id))
 SELECT cached, count(*) AS frames, sum(px)::BIGINT AS px FROM (SELECT px, true AS cached FROM c UNION ALL SELECT px, false FROM m) GROUP BY cached""")
def cached_analysis(spark, sf_dir):
    """Analyses that exist are used again, only the others are made."""
    frames = _frames(spark, sf_dir).select("frame_id", "px")
    cached = frames.where("substr(frame_id, -1) <> '3'")
    both = cached.withColumn("cached", F.lit(True)).unionByName(resume(frames, cached).withColumn("cached", F.lit(False)), allowMissingColumns=True)
    return both.groupBy("cached").agg(F.count("*").alias("frames"), F.sum("px").alias("px"))


_FORCED = "forced AS (SELECT DISTINCT frame_id FROM frames WHERE substr(frame_id, -2) = '07' UNION SELECT 'frame_unseen_' || i FROM range(3) t(i))"


@query(f"""{_FRAMES}, {_FORCED} SELECT CASE WHEN f.frame_id IS NULL THEN 'unseen' WHEN t.frame_id IS NULL THEN 'free' ELSE 'test' END AS part, count(*) AS frames FROM frames f FULL JOIN forced t USING (frame_id) GROUP BY ALL""")
def forced_test(spark, sf_dir):
    """A given test set: its frames, those left to deal, and ids that no frame has."""
    frames = _frames(spark, sf_dir).select("frame_id", F.lit(True).alias("known"))
    listed = frames.where("substr(frame_id, -2) = '07'").select("frame_id").union(spark.range(3).select(F.concat(F.lit("frame_unseen_"), "id"))).withColumn("listed", F.lit(True))
    part = F.when(F.col("known").isNull(), "unseen").when(F.col("listed").isNull(), "free").otherwise("test")
    return frames.join(listed, "frame_id", "full").groupBy(part.alias("part")).agg(F.count("*").alias("frames"))


# --- metrics of variants -----------------------------------------------------------------------------------


def _dump(spark, sf_dir, run: str) -> DataFrame:
    """A variant's counts by condition, frame and class; run b lacks some frames."""
    df = regions(spark, sf_dir).groupBy("weather", "frame_id", "class_name").agg(F.sum("pixel_count").alias("union"), F.sum(F.when(F.col(f"stored_{run}") != "reject", F.col("pixel_count")).otherwise(0)).alias("overlap"))
    return df if run == "a" else df.where("substr(frame_id, -2) <> '11'")


@query(f"""WITH {REGIONS}, a AS (SELECT DISTINCT weather, frame_id FROM regions), b AS (SELECT DISTINCT weather, frame_id FROM regions WHERE substr(frame_id, -2) <> '11')
 SELECT weather, count(a.frame_id) AS frames_a, count(b.frame_id) AS frames_b, count(*) FILTER (a.frame_id IS NULL OR b.frame_id IS NULL) AS apart, count(*) FILTER (a.frame_id IS NULL OR b.frame_id IS NULL) = 0 AS aligned FROM a FULL JOIN b USING (weather, frame_id) GROUP BY weather""")
def dump_alignment(spark, sf_dir):
    """Whether two dumps have the same frames in each condition; only then do paired intervals mean anything."""
    return stats.alignment(_dump(spark, sf_dir, "a"), _dump(spark, sf_dir, "b"), "weather", "frame_id")


@query(f"""WITH {REGIONS}, s AS (SELECT class_name, sum(pixel_count) AS u, sum(pixel_count) FILTER (stored_a <> 'reject') AS o, sum(pixel_count) FILTER (human = 'correct') AS l FROM regions GROUP BY ALL)
 SELECT class_name, o / (u + 1e-6) AS iou, l / sum(l) OVER () AS frequency, sum(l / (SELECT sum(l) FROM s) * o / (u + 1e-6)) OVER () AS weighted FROM s""")
def iou_by_class(spark, sf_dir):
    """IoU by class over all conditions, each class's share of the labels, and the mean by that share."""
    c = F.col
    kept, labels = F.when(c("stored_a") != "reject", c("pixel_count")), F.when(c("human") == "correct", c("pixel_count"))
    sums = regions(spark, sf_dir).groupBy("class_name").agg(F.sum("pixel_count").alias("u"), F.sum(kept).alias("o"), F.sum(labels).alias("l"))
    whole = Window.partitionBy()  # one row a class
    out = sums.withColumn("iou", c("o") / (c("u") + stats.EPS)).withColumn("frequency", c("l") / F.sum("l").over(whole))
    return out.select("class_name", "iou", "frequency", F.sum(c("frequency") * c("iou")).over(whole).alias("weighted"))


@query()
def bootstrap_rate(spark, sf_dir):
    """Intervals of the share of correct masks by class, resampling frames."""
    df = regions(ship(spark), sf_dir).where("human IS NOT NULL")
    return stats.cluster_interval(df, "frame_id", {"yes": (F.col("human") == "correct").cast("int"), "n": F.lit(1)}, stats.rate, "class_name")


@query()
def bootstrap_f1_difference(spark, sf_dir):
    """Intervals of the F1 of run a less that of run b over the same masks by class, and whether they exclude zero."""
    df, ok = regions(ship(spark), sf_dir).where("human IS NOT NULL"), F.col("human") == "correct"
    terms = {}
    for run in "ab":
        keep = F.col(f"stored_{run}") != "reject"
        terms |= {f"tp_{run}": (keep & ok).cast("int"), f"fp_{run}": (keep & ~ok).cast("int"), f"fn_{run}": (~keep & ok).cast("int")}
    out = stats.cluster_interval(df, "frame_id", terms, stats.f1_difference, "class_name")
    return out.withColumn("separable", stats.separable(F.col("low"), F.col("high")))


# --- mining ----------------------------------------------------------------------------------------------------

_MINED = {
    "hallucination": ("bbox_a = 'background'", "pixel_count"),
    "boundary_drift": ("bbox_a = 'valid' AND quality = 'good' AND consistency = 'fail'", "pixel_count"),
    "depth_support": ("consistency = 'fail' AND stored_a = 'reject'", "pixel_count"),
    "human_review": ("stored_a = 'human_review'", "pixel_count * (CASE WHEN bbox_a = 'invalid' AND quality = 'good' THEN 2 ELSE 1 END) * (CASE WHEN class_name IN ('cyclist', 'pedestrian') THEN 2 ELSE 1 END)"),
}


@query(f"WITH {REGIONS}, m AS (" + " UNION ALL ".join(f"SELECT '{n}' AS category, class_name, {s} AS score FROM regions WHERE {t}" for n, (t, s) in _MINED.items()) + ") SELECT category, class_name, count(*) AS n, max(score)::BIGINT AS best FROM m GROUP BY ALL")
def mined_categories(spark, sf_dir):
    """Masks worth showing, by category; one mask may be in several."""
    entries = F.array_compact(F.array(*[F.when(F.expr(t), F.struct(F.lit(n).alias("category"), F.expr(s).cast("long").alias("score"))) for n, (t, s) in _MINED.items()]))
    mined = regions(spark, sf_dir).select("class_name", F.inline(entries))
    return mined.groupBy("category", "class_name").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query(f"""WITH {REGIONS}, b AS (SELECT class_name, frame_id, mask_id, pixel_count, row_number() OVER (PARTITION BY frame_id ORDER BY pixel_count DESC, mask_id) AS r FROM regions WHERE bbox_a = 'background' AND substr(frame_id, -1) <> '5'),
 t AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY pixel_count DESC, frame_id, mask_id) AS turn, count(*) OVER (PARTITION BY class_name) AS size FROM b WHERE r = 1)
 SELECT class_name, frame_id, mask_id FROM t ORDER BY turn, size DESC, class_name LIMIT 12""")
def mined_frames(spark, sf_dir):
    """The best of a category without frames that are used already, a frame once, classes in turn."""
    df = regions(spark, sf_dir)
    used = df.where("substr(frame_id, -1) = '5'").select("frame_id")
    pool = resume(df.where("bbox_a = 'background'"), used)
    return round_robin(pool, "frame_id", "class_name", F.col("pixel_count"), "mask_id", 12).select("class_name", "frame_id", "mask_id")


@query("SELECT raw, time_of_day, category, count(*) AS n FROM (SELECT ['clear-day', 'partly-cloudy-day', 'cloudy', 'wind', 'fog', 'clear-night', 'partly-cloudy-night', 'snow', 'rain', 'sleet'][(o_orderkey % 10 + 1)::INT] AS raw, [NULL, 'day', 'night'][(o_custkey % 3 + 1)::INT] AS time_of_day, CASE WHEN o_orderkey % 10 <= 4 THEN 'day_fair' WHEN o_orderkey % 10 <= 6 THEN 'night_fair' WHEN o_orderkey % 10 = 7 THEN 'snow' WHEN o_custkey % 3 = 2 THEN 'night_rain' ELSE 'day_rain' END AS category FROM orders) GROUP BY ALL")
def weather_categories(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    raw = F.element_at(F.array(*[F.lit(x) for x in (*R.WEATHER, "sleet")]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    time = F.element_at(F.array(F.lit(None).cast("string"), F.lit("day"), F.lit("night")), (F.col("o_custkey") % 3 + 1).cast("int"))
    df = df.select(raw.alias("raw"), time.alias("time_of_day"))
    return df.groupBy("raw", "time_of_day", R.weather(F.col("raw"), F.col("time_of_day")).alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {REGIONS} SELECT class_name, count(*) AS masks, count(*) FILTER (stored_a = 'accept') AS accept, count(*) FILTER (stored_a = 'reject') AS reject, count(*) FILTER (stored_a = 'human_review') AS human_review FROM regions GROUP BY ROLLUP (class_name)")
def run_summary(spark, sf_dir):
    from ..sources.sinks import summary

    return summary(regions(spark, sf_dir), "stored_a")
