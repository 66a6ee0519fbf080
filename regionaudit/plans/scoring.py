"""Human verdicts: folding, coverage, agreement, order of labelling, intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import human as H
from ..operators import stats
from ..operators.select import at_places
from ..session import ship
from ..sources.fixtures import REGIONS, regions
from .registry import query


def _long(spark, sf_dir):
    """Three labelers by turns, some answering twice; the ordinal orders a mask's rows."""
    df = regions(spark, sf_dir).where("human IS NOT NULL").select("frame_id", "mask_id", "class_name", "human", "alpha_bp", "lidar_pm", F.explode(F.sequence(F.lit(0), (F.col("lidar_pm") % 4).cast("int"))).alias("ord"))
    said = F.when((F.col("alpha_bp") + F.col("ord")) % 5 == 0, F.when(F.col("human") == "correct", "incorrect").otherwise("correct")).otherwise(F.col("human"))
    return df.select("frame_id", "mask_id", "class_name", "ord", F.concat(F.lit("labeler"), F.col("ord") % 3).alias("labeler"), said.alias("verdict"))


_LONG = f"""WITH {REGIONS}, long AS (SELECT frame_id, mask_id, class_name, ord, 'labeler' || (ord % 3) AS labeler,
 CASE WHEN (alpha_bp + ord) % 5 = 0 THEN CASE WHEN human = 'correct' THEN 'incorrect' ELSE 'correct' END ELSE human END AS verdict FROM regions, range(4) t(ord) WHERE human IS NOT NULL AND ord <= lidar_pm % 4),
 last AS (SELECT frame_id, mask_id, labeler, arg_max(verdict, ord) AS verdict, min(ord) AS since FROM long GROUP BY ALL)"""


@query(f"{_LONG} SELECT labeler, verdict, count(*) AS n FROM last GROUP BY ALL")
def fold_export(spark, sf_dir):
    folded = H.fold(_long(spark, sf_dir), ["frame_id", "mask_id"], "ord", "labeler", "verdict", ["class_name"])
    return folded.select(F.explode("labelers").alias("labeler", "verdict")).groupBy("labeler", "verdict").agg(F.count("*").alias("n"))


@query(f"""{_LONG}, c AS (SELECT frame_id, mask_id, count(*) FILTER (verdict = 'correct') AS y, count(*) FILTER (verdict = 'incorrect') AS x FROM last GROUP BY ALL)
 SELECT CASE WHEN y > x THEN 'correct' WHEN x > y THEN 'incorrect' END AS consensus, count(*) AS n FROM c GROUP BY ALL""")
def consensus(spark, sf_dir):
    folded = H.fold(_long(spark, sf_dir), ["frame_id", "mask_id"], "ord", "labeler", "verdict", ["class_name"])
    return folded.groupBy(H.consensus(F.col("labelers")).alias("consensus")).agg(F.count("*").alias("n"))


@query(f"""{_LONG}, q AS (SELECT arg_min(verdict, since) AS a, arg_max(verdict, since) AS b FROM last GROUP BY frame_id, mask_id HAVING count(*) = 2),
 m AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS agreed, count(*) FILTER (a = 'correct') * count(*) FILTER (b = 'correct') + count(*) FILTER (a = 'incorrect') * count(*) FILTER (b = 'incorrect') AS products FROM q)
 SELECT n, agreed, (n * agreed - products) / (n * n - products) AS kappa FROM m""")
def cohen_kappa(spark, sf_dir):
    """Over masks that exactly two labelers judged, the earlier labeler's verdict first."""
    folded = H.verdicts(_long(spark, sf_dir), ["frame_id", "mask_id"], "ord", "labeler", "verdict")
    said = F.map_values("labelers")
    return H.kappa(folded.where(F.size("labelers") == 2).select(F.get(said, 0).alias("a"), F.get(said, 1).alias("b")), "a", "b")


@query(f"WITH {REGIONS} SELECT class_name, count(DISTINCT frame_id) AS frames, count(*) AS regions, count(*) FILTER (human IS NULL) AS pending, count(human) AS scored FROM regions GROUP BY ALL")
def coverage(spark, sf_dir):
    return regions(spark, sf_dir).groupBy("class_name").agg(F.count_distinct("frame_id").alias("frames"), F.count("*").alias("regions"), H.count_if(F.col("human").isNull()).alias("pending"), F.count("human").alias("scored"))


@query(f"""WITH {REGIONS} SELECT class_name, count(*) FILTER (human = 'incorrect' AND stored_a <> 'reject' AND stored_b <> 'reject') AS bad_both_kept, count(*) FILTER (human = 'incorrect' AND stored_a <> 'reject' AND stored_b = 'reject') AS bad_only_a_kept,
 count(*) FILTER (human = 'incorrect' AND stored_a = 'reject' AND stored_b <> 'reject') AS bad_only_b_kept, count(*) FILTER (human = 'correct' AND stored_a = 'reject' AND stored_b = 'reject') AS good_both_lost FROM regions GROUP BY ALL""")
def attribution(spark, sf_dir):
    c = F.col
    bad, good, a, b = c("human") == "incorrect", c("human") == "correct", c("stored_a") != "reject", c("stored_b") != "reject"
    return regions(spark, sf_dir).groupBy("class_name").agg(H.count_if(bad & a & b).alias("bad_both_kept"), H.count_if(bad & a & ~b).alias("bad_only_a_kept"), H.count_if(bad & ~a & b).alias("bad_only_b_kept"), H.count_if(good & ~a & ~b).alias("good_both_lost"))


@query(f"""WITH {REGIONS} SELECT stored_a, stored_b, count(*) AS n, count(*) FILTER ((stored_a <> 'reject') = (human = 'correct')) AS a_right, count(*) FILTER ((stored_b <> 'reject') = (human = 'correct')) AS b_right FROM regions WHERE human IS NOT NULL AND stored_a <> stored_b GROUP BY ALL""")
def contested(spark, sf_dir):
    c = F.col
    right = lambda run: (c(f"stored_{run}") != "reject") == (c("human") == "correct")
    return regions(spark, sf_dir).where("human IS NOT NULL AND stored_a <> stored_b").groupBy("stored_a", "stored_b").agg(F.count("*").alias("n"), H.count_if(right("a")).alias("a_right"), H.count_if(right("b")).alias("b_right"))


_KEYS = {"agreement": "alpha_bp", "combined": "alpha_bp - 1500 * (consistency = 'fail')::INT - 2000 * (bbox_a = 'invalid')::INT", "crop_only": "(bbox_a <> 'invalid')::INT"}
_QUEUES = " UNION ALL ".join(f"SELECT '{n}' AS ordering, row_number() OVER (ORDER BY {k}, frame_id, mask_id) AS pos, (human = 'incorrect')::INT AS bad FROM regions WHERE human IS NOT NULL AND bbox_a IS NOT NULL" for n, k in _KEYS.items())


@query(f"""WITH {REGIONS}, q AS ({_QUEUES}), w AS (SELECT *, sum(bad) OVER (PARTITION BY ordering ORDER BY pos) AS bad_to, count(*) OVER (PARTITION BY ordering) AS n_all, sum(bad) OVER (PARTITION BY ordering) AS bad_all FROM q)
 SELECT ordering, max(n_all) AS n, max(bad_all)::BIGINT AS bad, coalesce(max(bad_to) FILTER (pos = round_even(0.2 * n_all, 0)), 0)::BIGINT AS bad_in_fifth, min(pos) FILTER (2 * bad_to >= bad_all) AS queue_for_half FROM w GROUP BY ordering""")
def targeting_mask(spark, sf_dir):
    """Wrong masks early in a queue, by three orderings; equal keys in the order of the table."""
    c = F.col
    df = regions(spark, sf_dir).where("human IS NOT NULL AND bbox_a IS NOT NULL")
    df = df.withColumn("tie", F.struct("frame_id", "mask_id"))
    keys = {"agreement": c("alpha_bp"), "combined": c("alpha_bp") - 1500 * R.is_("consistency", "fail").cast("int") - 2000 * R.is_("bbox_a", "invalid").cast("int"), "crop_only": (c("bbox_a") != "invalid").cast("int")}
    out = None
    for name, key in keys.items():
        one = H.targeting(df, key, c("human") == "incorrect", "tie", F.substring("frame_id", 1, 14)).select(F.lit(name).alias("ordering"), "*")
        out = one if out is None else out.unionAll(one)
    return out


@query(f"""WITH {REGIONS}, f AS (SELECT frame_id, min(alpha_bp) AS k, count(*) FILTER (human = 'incorrect') AS bad FROM regions WHERE human IS NOT NULL GROUP BY frame_id),
 s AS (SELECT k, count(*) AS n, sum(bad)::BIGINT AS bad FROM f GROUP BY k) SELECT k, n, bad, sum(n) OVER (ORDER BY k)::BIGINT AS n_to, sum(bad) OVER (ORDER BY k)::BIGINT AS bad_to FROM s""")
def targeting_frame(spark, sf_dir):
    frames = regions(spark, sf_dir).where("human IS NOT NULL").groupBy("frame_id").agg(F.min("alpha_bp").alias("k"), H.count_if(F.col("human") == "incorrect").alias("bad"))
    steps = frames.groupBy("k").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("n_to", F.sum("n").over(w)).withColumn("bad_to", F.sum("bad").over(w))


_ORDER = f"WITH {REGIONS}, o AS (SELECT frame_id, min(answered_at) AS stamp, min(elapsed_ms) AS ord FROM regions WHERE human IS NOT NULL GROUP BY frame_id), r AS (SELECT frame_id, stamp, row_number() OVER (ORDER BY stamp, ord, frame_id) AS rank FROM o)"


def _order(df):
    """Labelling order, the export's rows being taken in the order of their time."""
    return H.labelling_order(df.withColumn("ord", F.col("elapsed_ms")))



@query(f"{_ORDER} SELECT frame_id, stamp, rank FROM r")
def labelling_order(spark, sf_dir):
    return _order(regions(spark, sf_dir))


@query(f"{_ORDER} SELECT human, count(*) AS n FROM regions JOIN (SELECT frame_id FROM r WHERE rank > (SELECT max(rank) FROM r) - 400) USING (frame_id) GROUP BY human")
def last_n_frames(spark, sf_dir):
    df = regions(spark, sf_dir)
    late = _order(df).orderBy(F.col("rank").desc()).limit(400).select("frame_id")
    return df.join(late, "frame_id", "left_semi").groupBy("human").agg(F.count("*").alias("n"))


@query(f"""{_ORDER}, p AS (SELECT min(elapsed_ms) AS ms, rank FROM regions JOIN r USING (frame_id) GROUP BY frame_id, rank), n AS (SELECT *, count(*) OVER () AS n FROM p),
 l AS (SELECT ms, row_number() OVER (ORDER BY ms) AS pos, n FROM n), q AS (SELECT ms, row_number() OVER (ORDER BY ms) AS pos, count(*) OVER () AS m FROM n WHERE rank > n - greatest(n // 4, 1))
 SELECT (SELECT count(*) FROM p) AS frames, (SELECT sum(ms)::BIGINT FROM p) AS total_ms, (SELECT ms FROM l WHERE pos = n // 2 + 1) AS median_ms, (SELECT ms FROM q WHERE pos = m // 2 + 1) AS late_median_ms,
  (SELECT count(DISTINCT frame_id) FROM regions) - (SELECT count(*) FROM p) AS left_frames, ((SELECT count(DISTINCT frame_id) FROM regions) - (SELECT count(*) FROM p)) * (SELECT ms FROM q WHERE pos = m // 2 + 1) AS left_ms""")
def pace(spark, sf_dir):
    """Time by judged frame (the time is a frame's, repeated on its rows): total, upper median, upper median of the last quarter, and what the rest will take."""
    df = regions(spark, sf_dir)
    frames = df.groupBy("frame_id").agg(F.min("elapsed_ms").alias("ms")).join(_order(df).select("frame_id", "rank"), "frame_id", "left")
    judged = frames.where("rank IS NOT NULL")
    totals = frames.agg(F.count("rank").alias("frames"), F.sum(F.when(F.col("rank").isNotNull(), F.col("ms"))).alias("total_ms"), H.count_if(F.col("rank").isNull()).alias("left_frames"))
    late = judged.crossJoin(totals.select("frames")).where(F.col("rank") > F.col("frames") - F.greatest(F.floor(F.col("frames") / 4), F.lit(1)))  # one row
    upper = lambda d, name: at_places(d, "ms", {name: lambda n: F.floor(n / 2)})
    out = totals.crossJoin(upper(judged, "median_ms")).crossJoin(upper(late, "late_median_ms"))  # one row each
    return out.select("frames", "total_ms", "median_ms", "late_median_ms", "left_frames", (F.col("left_frames") * F.col("late_median_ms")).alias("left_ms"))


@query(f"{_ORDER}, a AS (SELECT frame_id, avg((human = 'correct')::INT) AS rate FROM regions WHERE human IS NOT NULL GROUP BY frame_id) SELECT count(*) AS n, round(regr_slope(rate, rank) * 1e9)::BIGINT AS slope_e9, round(corr(rate, rank) * 1e6)::BIGINT AS corr_e6 FROM a JOIN r USING (frame_id)")
def drift(spark, sf_dir):
    df = regions(spark, sf_dir)
    rate = df.where("human IS NOT NULL").groupBy("frame_id").agg(F.avg((F.col("human") == "correct").cast("int")).alias("rate")).join(_order(df), "frame_id")
    return rate.agg(F.count("*").alias("n"), F.round(F.regr_slope("rate", "rank") * 1e9).cast("long").alias("slope_e9"), F.round(F.corr("rate", "rank") * 1e6).cast("long").alias("corr_e6"))


@query(f"""WITH {REGIONS}, f AS (SELECT frame_id, bool_and(human IS NOT NULL) AS complete FROM regions GROUP BY frame_id)
 SELECT class_name, CASE human WHEN 'correct' THEN 'kept' ELSE 'erased' END AS outcome, count(*) AS n, sum(pixel_count)::BIGINT AS px FROM regions JOIN f USING (frame_id) WHERE complete GROUP BY ALL""")
def human_clean_frames(spark, sf_dir):
    df = regions(spark, sf_dir)
    complete = df.groupBy("frame_id").agg(F.bool_and(F.col("human").isNotNull()).alias("complete")).where("complete")
    return df.join(complete, "frame_id", "left_semi").groupBy("class_name", F.when(F.col("human") == "correct", "kept").otherwise("erased").alias("outcome")).agg(F.count("*").alias("n"), F.sum("pixel_count").alias("px"))


@query(f"""WITH {REGIONS}, o AS (SELECT DISTINCT frame_id, elapsed_ms FROM regions), p AS (SELECT elapsed_ms, row_number() OVER (ORDER BY elapsed_ms) - 1 AS pos, count(*) OVER () AS n FROM o)
 SELECT max(n) AS frames, max(elapsed_ms) FILTER (pos = n // 2) AS p50, max(elapsed_ms) FILTER (pos = least(n - 1, n * 9 // 10)) AS p90 FROM p""")
def timing_quantiles(spark, sf_dir):
    frames = regions(spark, sf_dir).select("frame_id", "elapsed_ms").distinct()
    places = at_places(frames, "elapsed_ms", {"p50": lambda n: F.floor(n / 2), "p90": lambda n: F.least(n - 1, F.floor(n * 9 / 10))})
    return frames.agg(F.count("*").alias("frames")).crossJoin(places)  # one row each


@query(f"""WITH {REGIONS}, s AS (SELECT weather, class_name, sum(pixel_count) AS u, sum(pixel_count) FILTER (stored_a <> 'reject') AS o FROM regions GROUP BY ALL)
 SELECT weather, avg(coalesce(o, 0) / (u + 1e-6)) AS miou, sum(coalesce(o, 0))::BIGINT AS overlap, sum(u)::BIGINT AS total FROM s GROUP BY weather""")
def miou_point(spark, sf_dir):
    sums = regions(spark, sf_dir).groupBy("weather", "class_name").agg(F.sum("pixel_count").alias("u"), F.sum(F.when(F.col("stored_a") != "reject", F.col("pixel_count")).otherwise(0)).alias("o"))
    return sums.groupBy("weather").agg(F.avg(F.col("o") / (F.col("u") + 1e-6)).alias("miou"), F.sum("o").alias("overlap"), F.sum("u").alias("total"))


@query()
def bootstrap_f1(spark, sf_dir):
    """Frame-clustered intervals of the F1 of run a by class."""
    keep, ok = F.col("stored_a") != "reject", F.col("human") == "correct"
    terms = {"tp": (keep & ok).cast("int"), "fp": (keep & ~ok).cast("int"), "fn": (~keep & ok).cast("int")}
    return stats.cluster_interval(regions(ship(spark), sf_dir).where("human IS NOT NULL"), "frame_id", terms, stats.f1, "class_name")


@query()
def bootstrap_miou(spark, sf_dir):
    """Intervals of the mIoU of both runs' kept pixels and of their paired difference, resampling frames within weather."""
    kept = {run: F.when(F.col(f"stored_{run}") != "reject", F.col("pixel_count")).otherwise(0) for run in "ab"}
    return stats.paired_miou(regions(ship(spark), sf_dir), "weather", "frame_id", "class_name", list(R.CLASSES), kept, F.col("pixel_count"))
